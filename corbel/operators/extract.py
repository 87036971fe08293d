"""Python source facts as tables: symbols, diagnostics, chunks, and the resolved reference graph.

Files are read and parsed where they lie, one at a time; only small rows move afterwards.
"""

from __future__ import annotations

from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from corbel.operators.ingest import global_ids
from corbel.operators.python_chunks import FileChunker, text_chunks
from corbel.operators.python_source import decode, parse, references, symbols
from corbel.operators.resolve import MANY, by_bare_name, resolve_all

SYMBOLS = "file_id bigint, temp_id int, kind string, name string, qualified_name string, temp_parent int, start_line int, end_line int, signature string, docstring string"
CHUNKS = "file_id bigint, place int, temp_symbol int, start_line int, end_line int, text string, context_header string, token_count int"
#: What resolution needs of a file; see :func:`corbel.operators.python_source.references`.
FACTS = (
    "file_id bigint, repo_id bigint, path string, module_name string, symbols array<struct<temp:int,kind:string,name:string,parent:int,start:int>>, "
    "imports array<struct<form:string,level:int,written:string,alias:string,names:array<struct<name:string,alias:string>>,star:boolean>>, "
    "scopes array<struct<id:int,form:string,symbol:int,up:array<int>,cls:int,me:string>>, binds array<struct<scope:int,name:string,ctor:array<string>>>, "
    "bases array<struct<symbol:int,scope:int,parts:array<string>>>, calls array<struct<scope:int,form:string,parts:array<string>>>"
)


def is_python(path: Column) -> Column:
    """By the extension; the recorded language may be missing or wrong."""
    return F.lower(F.coalesce(path, F.lit(""))).rlike(r"\.pyi?\z")


def _sources(files: DataFrame, *more: str) -> DataFrame:
    """Python files with content, once each."""
    keep = files.where(is_python(F.col("path")) & F.col("content").isNotNull() & F.col("id").isNotNull())
    return keep.select("id", "path", F.coalesce("module_name", F.lit("")).alias("module_name"), "content", *more)


def _rows(b: pa.RecordBatch) -> list[dict]:
    return b.to_pylist()


def extract_symbols(files: DataFrame, recover: bool = True) -> DataFrame:
    """Symbols of all Python files, ids local to their file, parents first. A file that can't be decoded has none.

    Where a file as a whole does not parse, ``recover`` takes the top-level blocks that do; otherwise it has its module
    symbol only.
    """

    def run(batches):
        for b in batches:
            out = []
            for r in _rows(b):
                text = decode(r["content"])
                if text is not None:
                    found, _ = symbols(parse(text, recover), r["module_name"])
                    out += [{"file_id": r["id"], **asdict(s)} for s in found]
            cols = [[s["file_id"] for s in out], [s["id"] for s in out], *[[s[k] for s in out] for k in ("kind", "name", "qualified_name", "parent", "start_line", "end_line", "signature", "docstring")]]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SYMBOLS.split(", ")])

    return _sources(files).mapInArrow(run, SYMBOLS)


def diagnostics(files: DataFrame) -> DataFrame:
    """``(file_id, line, message)`` of syntax errors; a file goes on being extracted around them."""

    def run(batches):
        for b in batches:
            out = []
            for r in _rows(b):
                text = decode(r["content"])
                out += [(r["id"], 1, "encoding")] if text is None else [(r["id"], *e) for e in parse(text).errors]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.string())], names=["file_id", "line", "message"])

    return _sources(files).mapInArrow(run, "file_id bigint, line int, message string")


def number_symbols(extracted: DataFrame) -> DataFrame:
    """Extracted symbols with global, deterministic ids and ``parent_id``."""
    numbered = global_ids(extracted, ["file_id", "temp_id"])
    parents = numbered.select("file_id", F.col("temp_id").alias("temp_parent"), F.col("id").alias("parent_id"))
    return numbered.join(parents, ["file_id", "temp_parent"], "left").select("id", "file_id", "kind", "name", "qualified_name", "parent_id", "start_line", "end_line", "signature", "docstring", "temp_id")


def extract_chunks(files: DataFrame) -> DataFrame:
    """Chunks of all files: along definitions for Python, by lines for the rest; none for what is not text."""

    def run(batches):
        for b in batches:
            out = []
            for r in _rows(b):
                path, data = r["path"] or "", r["content"]
                text = decode(data) if path.lower().endswith((".py", ".pyi")) else None
                if text is not None:
                    parsed = parse(text)
                    found = FileChunker(path, parsed, symbols(parsed, r["module_name"])[0]).chunks() if text else []
                else:
                    found = text_chunks(path, data) or []
                out += [(r["id"], i, c["symbol"], c["start_line"], c["end_line"], c["text"], c["context_header"], c["token_count"]) for i, c in enumerate(found, 1)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in CHUNKS.split(", ")])

    keep = files.where(F.col("content").isNotNull() & F.col("id").isNotNull())
    return keep.select("id", "path", F.coalesce("module_name", F.lit("")).alias("module_name"), "content").mapInArrow(run, CHUNKS)


def number_chunks(extracted: DataFrame, numbered: DataFrame) -> DataFrame:
    """Extracted chunks with global ids and their symbol's id."""
    ids = numbered.select("file_id", F.col("temp_id").alias("temp_symbol"), F.col("id").alias("symbol_id"))
    c = global_ids(extracted, ["file_id", "place"]).join(ids, ["file_id", "temp_symbol"], "left")
    return c.select("id", "symbol_id", "file_id", "start_line", "end_line", "text", "context_header", "token_count")


def _arrow(kind: DataType) -> pa.DataType:
    if isinstance(kind, ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind])
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[kind.simpleString()]


def extract_facts(files: DataFrame) -> DataFrame:
    """What resolution needs of each Python file: a few hundred bytes of nested rows; its source stays where it lies."""
    schema = StructType.fromDDL(FACTS)
    kinds = {f.name: _arrow(f.dataType) for f in schema}

    def run(batches):
        for b in batches:
            out = []
            for r in _rows(b):
                text = decode(r["content"])
                if text is None:
                    continue
                parsed = parse(text)
                found, of = symbols(parsed, r["module_name"])
                brief = [{"temp": s.id, "kind": s.kind, "name": s.name, "parent": s.parent, "start": s.start_line} for s in found]
                out.append({"file_id": r["id"], "repo_id": r["repo_id"], "path": r["path"], "module_name": r["module_name"], "symbols": brief, **references(parsed, of)})
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in kinds.items()], names=list(kinds))

    return _sources(files, "repo_id").mapInArrow(run, schema)


def resolve_snapshots(facts: DataFrame) -> DataFrame:
    """Everything resolution finds in each repository snapshot; see :func:`corbel.operators.resolve.resolve_all`."""
    return resolve_all(facts)


def edges_of(resolved: DataFrame, numbered: DataFrame) -> DataFrame:
    """``(id, src, dst, kind, confidence)`` with global symbol ids."""
    ids = numbered.select("file_id", "temp_id", "id")
    e = resolved.where("what = 'edge'")
    e = e.join(ids.select(F.col("file_id").alias("src_file"), F.col("temp_id").alias("src_temp"), F.col("id").alias("src")), ["src_file", "src_temp"])
    e = e.join(ids.select(F.col("file_id").alias("dst_file"), F.col("temp_id").alias("dst_temp"), F.col("id").alias("dst")), ["dst_file", "dst_temp"])
    return global_ids(e.select("src", "dst", "kind", "confidence"), ["src", "dst", "kind"]).select("id", "src", "dst", "kind", "confidence")


def unresolved_of(resolved: DataFrame, numbered: DataFrame) -> DataFrame:
    """``(src, name, kind, external)``: references kept as they were written."""
    ids = numbered.select(F.col("file_id").alias("src_file"), F.col("temp_id").alias("src_temp"), F.col("id").alias("src"))
    m = resolved.where("what = 'missing'").join(ids, ["src_file", "src_temp"])
    return m.select("src", "name", "kind", (F.col("label") == "external").alias("external"))


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """``(repo_id, kind, resolved, external, unresolved, ratio)``: per reference; the ratio leaves external code out."""
    n = lambda label: F.coalesce(F.sum(F.when(F.col("label") == label, F.col("n"))), F.lit(0))
    out = resolved.where("what = 'count'").groupBy("repo_id", "kind").agg(n("resolved").alias("resolved"), n("external").alias("external"), n("unresolved").alias("unresolved"))
    inside = F.col("resolved") + F.col("unresolved")
    return out.withColumn("ratio", F.when(inside > 0, F.col("resolved") / inside).otherwise(F.lit(0.0)))


def edge_histogram(edges: DataFrame) -> DataFrame:
    """Deduplicated edges by kind and confidence."""
    return edges.groupBy("kind", "confidence").agg(F.count(F.lit(1)).alias("edges"))


def name_fallback(methods: DataFrame, calls: DataFrame, many: int = MANY) -> DataFrame:
    """``(repo_id, src, dst, confidence)``: calls on receivers of unknown type, bound by the method's name alone, by the
    resolver's own rule. ``methods(repo_id, id, name)``, ``calls(repo_id, src, name)``."""
    bare = by_bare_name(methods.select("repo_id", "name", F.col("id").alias("dst")), calls, many)
    return calls.select("repo_id", "src", "name").distinct().join(bare, ["repo_id", "name"]).select("repo_id", "src", "dst", "confidence")
