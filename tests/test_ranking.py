from collections import Counter

from pyspark.sql import functions as F

from corbel.operators.ranking import competition_ranks, double_cell, group_positions


def test_cells_keep_the_order_of_doubles(spark):
    values = [-1e300, -5.5, -5.4, -1e-300, 0.0, 1e-12, 0.5, 0.99, 1.0, 1.01, 2.0, 3.9, 4.0, 1e9, float("inf")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").orderBy("v").select(double_cell(F.col("v"))).collect()]
    assert got == sorted(got)


def test_group_positions_number_every_group_completely(spark):
    rows = [("a" if i % 3 else "b", i * 7919 % 101, i) for i in range(300)] + [(None, 1, 1), (None, 2, 2)]
    df = spark.createDataFrame(rows, "k string, v long, id long")
    got = group_positions(df, ["k"], [F.col("v"), F.col("id")], F.floor(F.col("v") / 10)).collect()
    assert len(got) == len(rows)
    for k in ("a", "b", None):
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))
        assert [(r.v, r.id) for r in mine] == sorted((r.v, r.id) for r in mine)


def test_competition_ranks_share_the_mean_of_ties(spark):
    rows = [("q", v) for v in [3.0, 1.0, 1.0, 2.0, None, None, -7.5]] + [("p", 0.0)] * 4
    got = Counter((r.k, r.v, r.rank, r.group_size) for r in competition_ranks(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect())
    assert got == Counter({("q", -7.5, 1.0, 7): 1, ("q", 1.0, 2.5, 7): 2, ("q", 2.0, 4.0, 7): 1, ("q", 3.0, 5.0, 7): 1, ("q", None, 6.5, 7): 2, ("p", 0.0, 2.5, 4): 4})


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert competition_ranks(empty, ["k"], "v").count() == 0
    assert group_positions(empty, ["k"], [F.col("v")], F.lit(0)).count() == 0
