import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corbel.api import Session
from corbel.plans.indexing import Indexer
from corbel.sources.store import Store
from corbel.streaming.incremental import start
from corbel.streaming.sessions import session_log

FOO = "class Greeter:\n    def greet(self):\n        return 'hi'\n\ndef make():\n    return Greeter()\n"
BAR = "from foo import Greeter, make\n\ndef use():\n    g = Greeter()\n    make()\n    return g.greet()\n"


def _files(spark, files):
    rows = [(p, "python" if p.endswith(".py") else "text", t.encode(), p.removesuffix(".py").replace("/", ".") if p.endswith(".py") else "") for p, t in files.items()]
    df = spark.createDataFrame(rows, "path string, language string, content binary, module_name string")
    return df.withColumn("content_hash", F.sha2("content", 256))


def _names(df, column="qualified_name"):
    return {r[column] for r in df.collect()}


def test_index_query_and_bring_up_to_date(spark, tmp_path):
    store, said = Store(spark, str(tmp_path)), []
    ix = Indexer(store, 1, progress=lambda phase, seconds: said.append(phase))
    ix.full(_files(spark, {"foo.py": FOO, "bar.py": BAR, "notes.md": "# Greeter notes\n\nHow to greet.\n"}))
    Indexer(store, 2).full(_files(spark, {"foo.py": "def other(): pass\n"}))
    assert said == ["files", "symbols", "facts", "edges", "unresolved_refs", "chunks", "vectors", "postings", "doc_stats"]
    s = Session(spark, store, 1)
    assert _names(s.find_definition("foo.make")) == {"foo.make"}
    assert _names(s.callers("foo.make")) == {"bar.use"} and _names(s.references("greet")) == {"bar.use"}
    assert _names(s.callees("bar.use")) == {"foo.Greeter", "foo.make", "foo.Greeter.greet"}
    assert _names(s.dependencies("bar", 1)) >= {"foo"}
    near, depths = s.blast_radius("foo.Greeter")
    assert _names(near) == {"foo.make", "bar.use"} and depths.collect()[0].reached == 2
    assert s.cycles().count() == 0
    assert {r.file_id for r in s.blast_radius_of_file("foo.py").collect()}
    hits = s.search("greet greeter", 3).orderBy("rank").collect()
    assert hits and hits[0].path in ("foo.py", "notes.md", "bar.py") and {x.retriever for h in hits for x in h.sources} >= {"bm25"}
    pack = s.context("who greets").first()
    assert pack.evidence[0].id == "e1" and pack.evidence[0].sources
    with pytest.raises(LookupError, match="did you mean foo.make"):
        s.resolve("mak")
    before = {r.qualified_name: r.id for r in s.symbols.collect()}
    chunks = {(r.file_id, r.start_line): r.id for r in s.chunks.collect()}
    foo_id = {r.path: r.id for r in s.files.collect()}["foo.py"]

    more = {"foo.py": FOO.replace("return 'hi'", "return 'hello'"), "bar.py": BAR, "notes.md": "# Greeter notes\n\nHow to greet.\n", "baz.py": "import foo\n\ndef third():\n    foo.make()\n"}
    assert ix.incremental(_files(spark, more)) == {"added": 1, "changed": 1, "deleted": 0, "unchanged": 2}
    s = Session(spark, store, 1)
    assert _names(s.callers("foo.make")) == {"bar.use", "baz.third"}
    after = {r.qualified_name: r.id for r in s.symbols.collect()}
    assert after["bar.use"] == before["bar.use"] and after["foo.make"] != before["foo.make"]
    assert {r.path: r.id for r in s.files.collect()}["foo.py"] == foo_id
    kept = {r.id for r in s.chunks.collect()}
    assert any(i in kept for i in chunks.values()) and s.vectors.count() == s.chunks.join(s.files.where("language = 'python'").select(F.col("id").alias("file_id")), "file_id", "left_semi").count()
    assert s.postings.select("chunk_id").distinct().join(s.chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti").count() == 0

    assert ix.incremental(_files(spark, more)) == {"added": 0, "changed": 0, "deleted": 0, "unchanged": 4}
    del more["foo.py"]
    assert ix.incremental(_files(spark, more))["deleted"] == 1
    s = Session(spark, store, 1)
    assert s.find_definition("foo.make").count() == 0 and s.edges.where("kind = 'calls'").count() == 0
    assert any(r.name == "foo.make" or r.name == "make" for r in s.unresolved.collect())
    assert _names(store.read("symbols", 2)) == {"foo", "foo.other"}
    repos = spark.createDataFrame([(1, "v", "m")], "id long, embedding_provider string, embedding_model string")
    with pytest.raises(ValueError, match="embedded by"):
        ix.incremental(_files(spark, more), repos)


def test_versions_as_a_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    t0 = datetime(2026, 1, 1)

    def version(repo, path, text, minute):
        return (repo, path, "python", None if text is None else text.encode(), None, path[:-3], t0 + timedelta(minutes=minute))

    schema = "repo_id long, path string, language string, content binary, content_hash string, module_name string, indexed_at timestamp"

    def land(name, rows):
        df = spark.createDataFrame(rows, schema).withColumn("content_hash", F.sha2("content", 256))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def drain():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = start(stream, store, str(tmp_path / "ck"))
        q.awaitTermination(300)
        assert q.exception() is None

    land("a", [version(1, "foo.py", FOO, 0), version(1, "bar.py", BAR, 0), version(1, "bar.py", "x = 1\n", -5), version(2, "z.py", "def z(): pass\n", 0)])
    drain()
    assert _names(Session(spark, store, 1).callers("foo.make")) == {"bar.use"} and store.read("symbols", 2).count() == 2
    land("b", [version(1, "bar.py", None, 9)])
    drain()
    assert _names(Session(spark, store, 1).files, "path") == {"foo.py"} and store.read("symbols", 2).count() == 2


def test_session_log_keeps_a_bounded_tail_and_expires(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    schema = "session_id string, id long, payload string, created_at timestamp"
    folder = str(tmp_path / "in")

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)

    def run(name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        q = session_log(stream, keep=3, ttl="1 hour", late="1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
        return [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]

    land([("a", i, f"p{i}", t0 + timedelta(minutes=i)) for i in range(5)])
    land([("a", 4, "p4", t0 + timedelta(minutes=4)), ("b", 1, "x", t0 + timedelta(minutes=6))])
    land([("b", 2, "y", t0 + timedelta(hours=9))])
    land([("b", 3, "z", t0 + timedelta(hours=9, minutes=1))])
    rows = run("x")
    assert ("a", 3, 4, "p4", False) in rows and ("b", 1, 1, "x", False) in rows
    assert ("a", 3, 4, "p4", True) in rows
