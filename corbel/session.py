"""Session helpers: checkpoint folder, lineage cuts, table loading."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the shared folder the cluster names in ``spark.checkpoint.dir``.

    Without that setting, as in tests, a temporary folder is taken where Spark runs in one process; a cluster
    must name one, as a folder of one machine can't be read by the others.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not (sc.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corbel-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder; readers survive the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    """One Parquet table of the data folder.

    ``wide`` is for expensive work on each row: a table of fewer files (or row groups) than the cluster has cores is
    dealt out to all of them first. Larger tables are read as they are.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if wide and df.rdd.getNumPartitions() * 2 <= cores else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitioned by ``keys`` into as many parts as the session shuffles into, whatever their size now.

    For the small side of a join that makes many rows of few bytes: adaptive execution would put it into one task.
    What is grouped by these keys (and others) afterwards needs no further exchange. (One part more than usual: a
    repartitioning that equals the child's own would be dropped, and the child's be coalesced.)
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, *keys)
