"""Problem 9: long exact spans that records share, by relative Lempel-Ziv parsing against indexed blocks of all records.

The reference is the collection itself, in blocks. Anchors choose the blocks a record must be parsed against: of every
``window`` consecutive ``gram``-character strings the ones with the smallest hash, so any two records that share
``span = gram + window - 1`` characters also share an anchor inside them, and around it a block of ``span - gram``
characters to either side. Equal blocks are one reference block. A block is factored greedily, from left to right,
relative to another: each factor is the longest piece of the other block that begins there, found in the block's index
of substrings, and the search goes on a span before the factor's end, so that no span is lost at a border. Factors of at
least ``span`` characters are shared spans; as an anchor starts in every ``window`` characters of a shared stretch,
factors clipped at block borders join without gaps in the record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corbel.session import cut

SALTS = 16
LEAD = "struct<doc:bigint,first:int>"
_BASE = 0x5851F42D4C957F2D  # odd multiplier of the rolling hash, modulo 2**64
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=_U)


_known: dict[str, np.ndarray] = {}


def _cached_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_known.get("up", ())) < n:
        _known["up"], _known["down"] = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
    return _known["up"][:n], _known["down"][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


class Rolling:
    """Hashes of substrings of one sequence of code points, from prefix sums."""

    def __init__(self, points: np.ndarray) -> None:
        up, self.down = _cached_powers(len(points) + 1)
        self.sums = np.zeros(len(points) + 1, _U)
        np.cumsum((points.astype(_U) + _U(1)) * up[:-1], out=self.sums[1:])

    def grams(self, at: np.ndarray | slice, length: int) -> np.ndarray:
        """Hash of the ``length`` characters from each place on."""
        if isinstance(at, slice):
            n = len(self.sums) - length
            return _mix((self.sums[length:] - self.sums[:n]) * self.down[:n])
        return _mix((self.sums[at + length] - self.sums[at]) * self.down[at])


def _window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values: minima from the left and from the right inside blocks of ``w``."""
    n = len(h)
    padded = np.full(-(-n // w) * w, np.iinfo(_U).max, _U)
    padded[:n] = h
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(texts: list[str], gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, hash, first place, last place)`` of the anchors of texts of at least gram + window - 1 characters.

    All places that share a window's minimum are taken, so the choice depends on the window's content alone. Places of
    one text with the same anchor and the same block around it, each within a span of the one before, are one row.
    """
    span = gram + window - 1
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    rolling = Rolling(points)
    h = rolling.grams(slice(None), gram)
    low = _window_minima(h, window)
    start = ends - sizes
    # Windows that lie inside one text; a run of equal minima needs a look at each of its windows' new places only.
    owner_of_window = np.repeat(np.arange(len(texts)), sizes)[: len(low)]
    inside = np.arange(len(low)) + span <= ends[owner_of_window]
    chosen = np.zeros(len(h), bool)
    fresh = inside.copy()
    fresh[1:] &= ~(inside[:-1] & (low[1:] == low[:-1]))
    first = np.nonzero(fresh)[0]
    for lo in range(0, len(first), 1 << 15):
        at = first[lo : lo + (1 << 15), None] + np.arange(window)
        chosen[at[h[at] == low[at[:, :1]]]] = True
    # Inside a run of equal minima, a place that enters at the right end with the same value is chosen as well.
    entering = np.nonzero(inside & ~fresh)[0]
    entering = entering[h[entering + window - 1] == low[entering]] + window - 1
    chosen[entering] = True
    at = np.nonzero(chosen)[0]
    owner = np.searchsorted(ends, at, side="right")
    key, place = h[at], at - start[owner]
    last = place.copy()
    # Repetitive texts: chain places with equal anchors and blocks.
    order = np.lexsort((place, key, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (key[order][1:] == key[order][:-1])
    if same.any():
        reach = span - gram
        whole = (place >= reach) & (place + gram + reach <= sizes[owner])
        block = np.zeros(len(at), _U)
        block[whole] = rolling.grams(at[whole] - reach, gram + 2 * reach)
        order = np.lexsort((place, block, key, owner))
        o, k, b, p, ok = owner[order], key[order], block[order], place[order], whole[order]
        joined = np.zeros(len(order), bool)
        joined[1:] = (o[1:] == o[:-1]) & (k[1:] == k[:-1]) & (b[1:] == b[:-1]) & ok[1:] & ok[:-1] & (p[1:] - p[:-1] <= span)
        heads = np.nonzero(~joined)[0]
        tails = np.append(heads[1:], len(order)) - 1
        owner, key, place, last = o[heads], k[heads], p[heads], p[tails]
    return owner, key, place, last


def _anchor_rows(docs: DataFrame, gram: int, window: int) -> DataFrame:
    """``(anchor, salt, doc, first, last)`` of all texts of at least a span; the salt goes by the document."""
    span = gram + window - 1

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            lo = 0
            while lo < len(texts):  # in parts of about a million characters
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= 1 << 20):
                    chars += len(texts[hi])
                    hi += 1
                owner, key, first, last = anchors(texts[lo:hi], gram, window)
                ids = b.column(0).take(pa.array(owner + lo))
                salt = pa.array(((ids.to_numpy().view(_U) * _U(_BASE)) >> _U(40)).astype(np.int32) % SALTS)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), salt, ids, pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["anchor", "salt", "doc", "first", "last"])
                lo = hi

    return docs.where(F.length("text") >= span).select("doc", "text").mapInArrow(run, "anchor bigint not null, salt int not null, doc bigint not null, first int not null, last int not null")


def _shared_places(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """Rows of anchors that stand in several documents.

    Counted by anchor and salt first, so an anchor in a third of all documents is spread over tasks. One exchange of the
    rows serves both the count and the choice, as both ask for all of their columns.
    """
    salted = rows.repartition("anchor", "salt")
    part = salted.groupBy("anchor", "salt").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.max(F.col("last") - F.col("first")).alias("run"))
    several = part.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("run").alias("run")).where("lo < hi AND run >= 0")
    wanted = several.select("anchor", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return salted.join(wanted, ["anchor", "salt"]).drop("salt")


def _blocks(places: DataFrame, docs: DataFrame, gram: int, reach: int, bound: int = 1 << 17) -> DataFrame:
    """The text around each place: ``(anchor, doc, first, last, at, block)``; the anchor begins ``at`` characters into it.

    ``places`` are stored; up to ``bound`` of them (some MB) go to the texts by broadcast, more meet them by shuffle.
    """
    few = places.limit(bound + 1).count() <= bound
    lists = places.groupBy("doc").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("a"))
    both = docs.select("doc", "text").join(F.broadcast(lists) if few else lists, "doc")

    def run(batches):
        for b in batches:
            docs_, texts, lists_ = b.column("doc"), b.column("text").to_pylist(), b.column("a")
            flat, offsets = lists_.flatten(), lists_.offsets.to_numpy()
            owner = np.repeat(np.arange(len(texts)), np.diff(offsets - offsets[0]))
            first = flat.field("first").to_numpy()
            start = np.maximum(first - reach, 0)
            text = [texts[o][lo : p + gram + reach] for o, lo, p in zip(owner.tolist(), start.tolist(), first.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [flat.field("anchor"), docs_.take(pa.array(owner)), flat.field("first"), flat.field("last"), pa.array((first - start).astype(np.int32)), pa.array(text, pa.string())],
                names=["anchor", "doc", "first", "last", "at", "block"],
            )

    return both.mapInArrow(run, "anchor bigint, doc bigint, first int, last int, at int, block string")


def _cuts(contents: DataFrame, span: int) -> DataFrame:
    """Every span-long substring of each block: ``(anchor, place, cut, previous, lead, lo, hi)``, the index that chooses
    which blocks are parsed against each other. ``place`` counts from the anchor; ``previous`` is the substring before."""

    def run(batches):
        for b in batches:
            rows, places, cuts, before = [], [], [], []
            for i, (at, block) in enumerate(zip(b.column("at").to_pylist(), b.column("block").to_pylist(), strict=True)):
                n = len(block) - span + 1
                if n > 0:
                    h = Rolling(np.frombuffer(block.encode("utf-32-le", "surrogatepass"), np.uint32)).grams(slice(None), span).view(np.int64)
                    rows.append(np.full(n, i))
                    places.append(np.arange(n) - at)
                    cuts.append(h)
                    before.append(np.concatenate([[0], h[:-1]]))
            if not rows:
                continue
            row = pa.array(np.concatenate(rows))
            head = np.concatenate([np.arange(len(x)) == 0 for x in cuts])
            mine = [pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(cuts)), pa.array(np.concatenate(before), mask=head)]
            yield pa.RecordBatch.from_arrays([b.column("anchor").take(row), *mine, b.column("lead").take(row), b.column("lo").take(row), b.column("hi").take(row)], names=["anchor", "place", "cut", "previous", "lead", "lo", "hi"])

    return contents.select("anchor", "at", "block", "lead", "lo", "hi").mapInArrow(run, f"anchor bigint, place int, cut bigint, previous bigint, lead {LEAD}, lo bigint, hi bigint")


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    if a == b:
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def block_index(block: str, seed: int) -> dict[str, list[int]]:
    """Places of each substring of ``seed`` characters."""
    out: dict[str, list[int]] = {}
    for j in range(len(block) - seed + 1):
        out.setdefault(block[j : j + seed], []).append(j)
    return out


def factors(record: str, block: str, index: dict[str, list[int]], seed: int, span: int) -> list[tuple[int, int, int]]:
    """``(start, end, source)`` of the factors of ``record`` relative to ``block`` with at least ``span`` characters.

    Greedy from left to right: at each place the longest piece of the block that begins there, by the block's ``index``.
    A factor shorter than a span is a literal. Behind a factor the search begins again a span less one before its end,
    where only a factor that goes beyond it counts; so every span that the block holds lies in one of the factors.
    """
    out: list[tuple[int, int, int]] = []
    at, end, last = 0, 0, len(record) - span
    while at <= last:
        best, source = 0, 0
        for j in index.get(record[at : at + seed], ()):
            n = seed + _common(record[at + seed :], block[j + seed :])
            if n > best:
                best, source = n, j
        if best >= span and at + best > end:
            end = at + best
            out.append((at, end, source))
            at = max(at + 1, end - span + 1)
        else:
            at += 1
    return out


def _parsed(pairs: DataFrame, contents: DataFrame, span: int) -> DataFrame:
    """``(anchor, lead, start, end, source, source_start)``: factors of block ``lead`` relative to block ``source``."""
    seed = span // 2
    text = contents.select("anchor", "lead", "block")
    both = pairs.join(text, ["anchor", "lead"]).join(text.withColumnsRenamed({"lead": "source", "block": "other"}), ["anchor", "source"])

    def run(batches):
        for b in batches:
            known: dict[str, dict] = {}
            rows, cols = [], []
            for i, (record, block) in enumerate(zip(b.column("block").to_pylist(), b.column("other").to_pylist(), strict=True)):
                if block not in known:
                    known[block] = block_index(block, seed)
                found = factors(record, block, known[block], seed, span)
                rows += [i] * len(found)
                cols += found
            row = pa.array(rows, pa.int64())
            start, end, source = ([c[k] for c in cols] for k in range(3))
            yield pa.RecordBatch.from_arrays([b.column("anchor").take(row), b.column("lead").take(row), pa.array(start, pa.int32()), pa.array(end, pa.int32()), b.column("source").take(row), pa.array(source, pa.int32())], names=["anchor", "lead", "start", "end", "source", "source_start"])

    return both.select("anchor", "lead", "source", "block", "other").mapInArrow(run, f"anchor bigint, lead {LEAD}, start int, end int, source {LEAD}, source_start int")


class SharedSpans:
    """The relative parse of a collection ``docs(id, text)``. The blocks around shared anchors, a few hundred bytes for each
    place that some other text shares, are computed once into the shared checkpoint folder; results are lazy from there.

    Null ids are left out (a pair can't name them), null and short texts share nothing, repeated rows count once (of an
    id with several texts, lengths and copies go by the smallest). Equal texts form a class that is parsed once, under
    its smallest id. An empty table gives empty results.

    Work is in proportion to the text: equal blocks are parsed once, and a block is parsed against the first and the last
    block of the index that share a substring with it, which decides what it shares with anything at all. Only ``pairs``,
    which must name every pair, parses all pairs of different blocks that share one. Anchors and substrings that are
    frequent are counted with partial sums; joins on them stream, and adaptive execution splits their partitions.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 200) -> None:
        if span < 8:
            raise ValueError("span must be at least 8")
        gram = span // 2
        window, reach = span - gram + 1, span - gram
        self.span, self.docs = span, docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text")).where(F.col("doc").isNotNull())
        keyed = self.docs.select("doc", F.length("text").alias("chars"), F.sha2("text", 256).alias("key"))
        keyed = cut(keyed.groupBy("doc").agg(F.min_by(F.struct("chars", "key"), F.struct(F.col("key").isNull(), "key")).alias("t")).select("doc", "t.chars", F.when(F.col("t.chars") >= span, F.unhex("t.key")).alias("key")))
        classes = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("members")).where("members > 1")
        #: (doc, chars) of all; (doc, rep, members) of texts that have copies.
        self.all = keyed.select("doc", "chars")
        self.copied = cut(keyed.join(classes, "key").select("doc", "rep", "members"))
        copies = self.copied.where("doc <> rep").select("doc")
        few = copies.limit((1 << 20) + 1).count() <= 1 << 20  # 8 MB of ids; more are taken out by shuffle
        ones = self.docs.where(F.length("text") >= span).join(F.broadcast(copies) if few else copies, "doc", "left_anti")
        places = cut(_shared_places(_anchor_rows(ones, gram, window)).distinct())
        self.blocks = blocks = cut(_blocks(places, ones, gram, reach).where(F.length("block") >= span))
        #: Reference blocks: each distinct text around an anchor, named by the first place it stands at.
        grouped = blocks.groupBy("anchor", "at", "block").agg(F.min(F.struct("doc", "first")).alias("lead"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
        self.contents = cut(grouped)
        varied = self.contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("least"), F.max("hi").alias("most")).where("n > 1 AND least < most").select("anchor")
        self.cuts = _cuts(self.contents.join(varied, "anchor", "left_semi"), span)

    def factors(self) -> DataFrame:
        """``(anchor, lead, start, end, source, source_start)``: each block's factors relative to the index. A block that
        stands in several documents is its own source."""
        whole = self.contents.where("lo < hi").select("anchor", "lead", F.lit(0).alias("start"), F.length("block").alias("end"), F.col("lead").alias("source"), F.lit(0).alias("source_start"))
        key = ["anchor", "place", "cut"]
        ends = self.cuts.groupBy(*key).agg(F.min(F.struct("lo", "lead")).alias("a"), F.max(F.struct("hi", "lead")).alias("b")).where("a.lo < b.hi")
        alone = self.cuts.where("lo = hi").join(ends, key)
        links = alone.select("anchor", "lead", F.when(F.col("a.lo") != F.col("lo"), F.col("a.lead")).otherwise(F.col("b.lead")).alias("source")).distinct()
        return whole.unionByName(_parsed(links, self.contents, self.span))

    def _members(self) -> DataFrame:
        """``(anchor, lead, doc, first, last, at)``: the places of each reference block."""
        return self.blocks.join(self.contents.select("anchor", "at", "block", "lead"), ["anchor", "at", "block"]).select("anchor", "lead", "doc", "first", "last", "at")

    def class_pairs(self) -> DataFrame:
        """``(a, b)``, a < b: representatives of classes of equal texts that share a span."""
        x, y = self.cuts.alias("x"), self.cuts.alias("y")
        # Of a run of common substrings only the first speaks.
        new = F.col("x.previous").isNull() | F.col("y.previous").isNull() | (F.col("x.previous") != F.col("y.previous"))
        meet = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("anchor", "place", "cut")] + [F.col("x.lead") < F.col("y.lead"), F.least("x.lo", "y.lo") < F.greatest("x.hi", "y.hi"), new])
        pairs = meet.select("x.anchor", F.col("x.lead").alias("lead"), F.col("y.lead").alias("source")).distinct()
        linked = _parsed(pairs, self.contents, self.span).select("anchor", "lead", "source").distinct()
        own = self.contents.where("lo < hi").select("anchor", "lead", F.col("lead").alias("source"))
        m = self._members().select("anchor", "lead", "doc").distinct()
        both = linked.unionByName(own).join(m.withColumnRenamed("doc", "x"), ["anchor", "lead"]).join(m.withColumnsRenamed({"lead": "source", "doc": "y"}), ["anchor", "source"]).where("x <> y")
        return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def pairs(self) -> DataFrame:
        """``(doc_id_a, doc_id_b)``, a < b: all pairs of documents that share a span, those of equal texts included."""
        c = self.copied.select("doc", "rep")
        p = self.class_pairs()
        for side in ("a", "b"):
            p = p.join(c.select(F.col("rep").alias(side), F.col("doc").alias("__d")), side, "left").withColumn(side, F.coalesce("__d", side)).drop("__d")
        between = p.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
        within = c.select("rep", F.col("doc").alias("doc_id_a")).join(c.select("rep", F.col("doc").alias("doc_id_b")), "rep").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")
        return between.unionByName(within)

    def span_classes(self) -> DataFrame:
        """``(doc_id, start, end, members, links)``: reference blocks as classes, without any pairs: the place of the block
        in the document that leads it, the documents whose factors lie in it (its own too), and the blocks linked to it."""
        f, m = self.factors(), self._members().select("anchor", "lead", "doc").distinct()
        both = f.join(m, ["anchor", "lead"]).select("anchor", "source", "lead", "doc")
        both = both.unionByName(f.select("anchor", "source").distinct().join(m.withColumnRenamed("lead", "source"), ["anchor", "source"]).select("anchor", "source", F.col("source").alias("lead"), "doc"))
        n = both.groupBy("anchor", "source").agg(F.countDistinct("doc").alias("members"), (F.countDistinct("lead") - 1).alias("links"))
        where = self.contents.select("anchor", F.col("lead").alias("source"), F.col("lead.doc").alias("doc_id"), (F.col("lead.first") - F.col("at")).alias("start"), F.length("block").alias("n_chars"))
        return n.join(where, ["anchor", "source"]).select("doc_id", "start", (F.col("start") + F.col("n_chars")).alias("end"), "members", "links")

    def spans(self) -> DataFrame:
        """``(doc_id, spans, shared_chars, share)`` for every id: where its text also stands in another row.

        ``spans`` are disjoint ``(start, end)`` in code points, 0-based, end exclusive, each a union of shared spans;
        ``share`` is their part of the text, 0.0 for null, empty and short texts.
        """
        found = self._members().join(self.factors().select("anchor", "lead", F.col("start").alias("s"), F.col("end").alias("e")), ["anchor", "lead"])
        ends = found.groupBy("doc", (F.col("first") - F.col("at") + F.col("s")).alias("start")).agg(F.max(F.col("last") - F.col("at") + F.col("e")).alias("end"))
        w = Window.partitionBy("doc").orderBy("start")
        ends = ends.withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        islands = ends.withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0)).over(w))
        merged = islands.groupBy("doc", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        by_doc = merged.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("found"))
        # A text with copies is shared as a whole.
        own = self.all.join(self.copied.select("doc", F.lit(True).alias("copied")), "doc", "left").join(by_doc, "doc", "left")
        whole = F.array(F.struct(F.lit(0).alias("start"), F.col("chars").alias("end")))
        none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
        out = own.select("doc", "chars", F.when(F.col("copied"), whole).otherwise(F.coalesce("found", none)).alias("spans"))
        shared = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
        return out.select(F.col("doc").alias("doc_id"), "spans", shared.alias("shared_chars"), F.when(F.col("chars") > 0, shared / F.col("chars")).otherwise(F.lit(0.0)).alias("share"))
