"""Evaluation sets from YAML: strict loading, as two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Closed sets of an evaluation file.
TYPES = ["structural", "semantic", "identifier"]
VERIFICATIONS = ["source", "ide"]
LEAST_QUERIES = 20
_QUERY = {"id", "type", "query", "labels", "verification", "evidence"}
_LABEL = {"path", "start_line", "end_line", "symbol"}


def validate(data: dict, least: int = LEAST_QUERIES) -> list[str]:
    """What is wrong with an evaluation set; empty if nothing is."""
    if not isinstance(data, dict) or not isinstance(data.get("queries"), list):
        return ["queries must be a list"]
    out, seen = [], set()
    queries = data["queries"]
    if len(queries) < least:
        out.append(f"{len(queries)} queries; at least {least} are needed")
    for i, q in enumerate(queries):
        name = q.get("id") or f"query {i + 1}"
        if not q.get("id") or q["id"] in seen:
            out.append(f"{name}: id is missing or repeated")
        seen.add(q.get("id"))
        out += [f"{name}: unknown field {k}" for k in sorted(set(q) - _QUERY)]
        if q.get("type") not in TYPES:
            out.append(f"{name}: type must be one of {TYPES}")
        if q.get("verification") not in VERIFICATIONS:
            out.append(f"{name}: verification must be one of {VERIFICATIONS}")
        if not str(q.get("query") or "").strip():
            out.append(f"{name}: query is empty")
        if not q.get("labels"):
            out.append(f"{name}: no labels")
        for label in q.get("labels") or []:
            out += [f"{name}: unknown label field {k}" for k in sorted(set(label) - _LABEL)]
            a, b = label.get("start_line"), label.get("end_line")
            if not label.get("path") or not isinstance(a, int) or not isinstance(b, int) or a < 1 or b < a:
                out.append(f"{name}: label needs a path and lines in order")
    return out


def load(spark: SparkSession, path: str, least: int = LEAST_QUERIES) -> tuple[DataFrame, DataFrame]:
    """``(queries, labels)`` of a YAML file; anything wrong with it raises, all faults together."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f)
    if wrong := validate(data, least):
        raise ValueError("; ".join(wrong))
    queries = [(q["id"], q["type"], q["query"], q["verification"], q.get("evidence")) for q in data["queries"]]
    labels = [(q["id"], i, x["path"], x["start_line"], x["end_line"], x.get("symbol"), q["verification"]) for q in data["queries"] for i, x in enumerate(q["labels"], 1)]
    return (
        spark.createDataFrame(queries, "query_id string, query_type string, query_text string, verification string, evidence string"),
        spark.createDataFrame(labels, "query_id string, label int, path string, start_line int, end_line int, symbol string, verification string"),
    )
