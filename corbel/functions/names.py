"""Column functions over paths, module names, URLs, and citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def module_from_path(path: Column) -> Column:
    """``a/b.py`` -> ``a.b``, ``a/__init__.py`` -> ``a``, by the path alone."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.py\z", ""), r"(?:\A|/)__init__\z", ""), F.lit("/"), F.lit("."))


def module_paths(module: Column) -> Column:
    """Where a module may live, in order of lookup."""
    base = F.replace(module, F.lit("."), F.lit("/"))
    return F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))


def top_level(module: Column) -> Column:
    return F.substring_index(module, ".", 1)


def parent_module(module: Column) -> Column:
    """All but the last segment; '' for a top-level module."""
    return F.regexp_extract(module, r"\A(.*)\.[^.]*\z", 1)


def absolute_module(module: Column, is_package: Column, level: Column, written: Column) -> Column:
    """Target of an import with ``level`` leading dots in ``module``; null where it leads out of the root."""
    steps = F.when(is_package, level - 1).otherwise(level)
    segments = F.when(module == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(module, r"\."))
    base = F.array_join(F.slice(segments, F.lit(1), F.greatest(F.size(segments) - steps, F.lit(0))), ".")
    joined = F.concat_ws(".", F.when(base != "", base), F.when(written != "", written))
    anchored = (module != "") & (steps <= F.size(segments)) & (joined != "")
    return F.when(level == 0, written).when(anchored, joined)


def snapshot_id(root: Column) -> Column:
    """Stand-in for a commit of a tree without version control: 40 digits of the root's hash."""
    return F.substring(F.sha2(root, 256), 1, 40)


def canonical_repository_url(raw: Column, host: str = "github.com") -> Column:
    """``https://host/owner/name.git`` of a public repository address, null for anything else (credentials, queries, other hosts)."""
    t = F.trim(raw)
    prefix = f"git@{host}:"
    t = F.when(t.startswith(prefix), F.concat(F.lit(f"https://{host}/"), F.substring(t, len(prefix) + 1, 1 << 20))).otherwise(t)
    h = host.replace(".", r"\.")
    pattern = rf"\A(?i:https)://(?:www\.)?{h}/+([^/?#@\s]+)/([^/?#@\s]+?)(?:\.git)?/*\z"
    owner, name = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)
    fine = (owner != "") & (name != "") & ~owner.isin(".", "..") & ~name.isin(".", "..")
    return F.when(fine, F.concat(F.lit(f"https://{host}/"), owner, F.lit("/"), name, F.lit(".git")))


def unknown_citations(answer: Column, fields: Column, allowed: Column) -> Column:
    """Cited ids, in the answer's text as ``[eN]`` or in ``fields``, that are not among ``allowed``."""
    inline = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(e[0-9]+)\]"), F.lit(1))
    return F.array_except(F.array_union(inline, F.coalesce(fields, F.expr("cast(array() as array<string>)"))), allowed)


def or_unknown(value: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit("unknown"))
