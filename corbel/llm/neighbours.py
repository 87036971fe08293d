"""Problem 2: the most similar vectors of every vector, by shifted space-filling curves.

Unit vectors are projected on a few random directions, shifted, cut into levels and ordered along a Hilbert curve;
several such orderings differ in directions and shifts. Cells that hold more vectors than a window are ordered further,
by levels of their own. Spark range-partitions each ordering; in a partition every vector is compared with the vectors of
a window of fixed size around its place. The best of all orderings are merged, and the merged lists improve each other:
a vector is compared with the neighbours of its neighbours, round by round, until the lists settle. Vectors travel in half precision until then; what is
left is ranked by exact cosines. Equal vectors take part once and are put back in the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corbel.session import cut

_U = np.uint64


def hilbert(levels: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points ``levels[i, axis]`` with ``bits`` bits for each axis."""
    x = [levels[:, i].astype(_U) for i in range(levels.shape[1])]
    axes, q = len(x), 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the top bit down
        low, top = _U(q - 1), _U(q)
        for i in range(axes):
            flip = (x[i] & top) != 0
            swap = np.where(flip, _U(0), (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(flip, low, swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, axes):  # Gray code
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & _U(q)) != 0, t ^ _U(q - 1), t)
        q >>= 1
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            place = place << _U(1) | ((x[i] ^ t) >> _U(bit)) & _U(1)
    return place


class Curves:
    """``count`` orderings of unit vectors of ``dim`` numbers: random orthonormal directions, random shifts, Hilbert keys."""

    def __init__(self, dim: int, count: int, axes: int = 12, bits: int = 2, seed: int = 17) -> None:
        rng = np.random.default_rng(seed)
        axes = min(axes, dim, 31 // bits)  # keys of two levels fit one number
        self.bits, self.count, self.width = bits, count, axes * bits
        self.axes = [np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :axes].astype(np.float32) for _ in range(count)]
        # A coordinate of a random unit vector is close to normal with deviation dim ** -0.5; levels hold equal shares.
        cuts = np.quantile(np.random.default_rng(0).normal(size=1 << 16), np.arange(1, 1 << bits) / (1 << bits)) / np.sqrt(dim)
        self.cuts, self.shifts = cuts.astype(np.float32), (rng.uniform(-0.5, 0.5, (count, axes)) / np.sqrt(dim)).astype(np.float32)

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        levels = np.searchsorted(self.cuts, vectors @ self.axes[curve] + self.shifts[curve])
        return hilbert(levels, self.bits).astype(np.int64)

    def dense_cells(self, sample: np.ndarray, crowd: int, depth: int = 2) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """For each curve and depth the cells with more than ``crowd`` vectors of the sample, and their own cuts.

        Cells are sorted numbers: at the first depth keys, then ``place of the outer cell << width | inner key``. Cuts
        are quantiles of the cell's members on each axis, so a tight group is spread over all levels again.
        """
        shares = np.arange(1, 1 << self.bits) / (1 << self.bits)
        out = []
        for c in range(self.count):
            seen, path, curve = sample @ self.axes[c], self.keys(sample, c), []
            for _ in range(depth):
                cells, counts = np.unique(path, return_counts=True)
                cells = cells[counts > crowd]
                if not len(cells):
                    break
                cuts = np.stack([np.quantile(seen[path == cell], shares, axis=0).T for cell in cells]).astype(np.float32)
                curve.append((cells, cuts))
                at, inside, inner = self._inner(seen, path, cells, cuts)
                seen, path = seen[inside], (at[inside] << self.width) | inner[inside]
            out.append(curve)
        return out

    def _inner(self, seen: np.ndarray, path: np.ndarray, cells: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each row's cell among ``cells``, whether it is one of them, and the key inside it (0 elsewhere)."""
        at = np.minimum(np.searchsorted(cells, path), len(cells) - 1)
        inside = cells[at] == path
        inner = np.zeros(len(path), np.int64)
        if inside.any():
            levels = (seen[inside][:, :, None] > cuts[at[inside]]).sum(axis=2)
            inner[inside] = hilbert(levels, self.bits).astype(np.int64)
        return at, inside, inner

    def fine_keys(self, vectors: np.ndarray, curve: int, keys: np.ndarray, dense: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Order inside dense cells (see :meth:`dense_cells`); 0 in all others."""
        fine, rows, path = np.zeros(len(keys), np.int64), np.arange(len(keys)), keys
        if dense:
            seen = vectors @ self.axes[curve]
        for depth, (cells, cuts) in enumerate(dense):
            at, inside, inner = self._inner(seen[rows], path, cells, cuts)
            rows, path = rows[inside], (at[inside] << self.width) | inner[inside]
            fine[rows] |= inner[inside] << (self.width if depth == 0 else 0)
        return fine


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the k largest of each row; the width is a multiple of 32 and above 32 * k, or anything small.

    Maxima of strided groups of 32 columns are taken first; the k largest lie in the k groups with the largest maxima.
    """
    rows, width = sims.shape
    if width <= 64 * k:
        cols = np.argpartition(sims, width - k, axis=1)[:, width - k :]
        return cols, np.take_along_axis(sims, cols, 1)
    g = width // 32
    groups = np.argpartition(sims.reshape(rows, 32, g).max(axis=1), g - k, axis=1)[:, g - k :]
    cols = (groups[:, :, None] + g * np.arange(32)).reshape(rows, 32 * k)
    values = np.take_along_axis(sims, cols, 1)
    at = np.argpartition(values, 31 * k, axis=1)[:, 31 * k :]
    return np.take_along_axis(cols, at, 1), np.take_along_axis(values, at, 1)


def best_in_windows(x: np.ndarray, ids: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` (in curve order) ids and cosines of the best k in its window; -1 and -inf fill up."""
    n, block = len(x), 256
    out_ids, out_sims = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf, np.float32)
    for a in range(0, n, block):
        b = min(n, a + block)
        lo, hi = max(0, a - window), min(n, b + window)
        width = max(-(-(hi - lo) // 32) * 32, k)
        other = np.zeros((width, x.shape[1]), np.float32)
        other[: hi - lo] = x[lo:hi]
        sims = x[a:b] @ other.T
        sims[:, hi - lo :] = -np.inf
        sims[np.arange(b - a), np.arange(a, b) - lo] = -np.inf
        cols, values = _best(sims, k)
        real = values > -np.inf
        out_ids[a:b] = np.where(real, ids[lo + np.minimum(cols, hi - lo - 1)], -1)
        out_sims[a:b] = values
    return out_ids, out_sims


def unit_vectors(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """``(model, chunk_id, unit binary)``: usable vectors, normalised, once for each model and chunk.

    Usable: chunk and model not null, exactly ``dim`` finite numbers, not all zero. Of different vectors under one key
    the bytewise smallest is kept.
    """

    def run(batches):
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            top = np.abs(x).max(axis=1, initial=0, keepdims=True)
            with np.errstate(all="ignore"):
                x = x / top
                x = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)
            ok = np.isfinite(x).all(axis=1)
            units = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), int(ok.sum()), [None, pa.py_buffer(np.ascontiguousarray(x[ok]))]).cast(pa.binary())
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), units], names=["model", "chunk_id", "unit"])

    sized = vectors.where(F.col("chunk_id").isNotNull() & F.col("model").isNotNull() & (F.size("embedding") == dim)).select("model", "chunk_id", F.col("embedding").cast("array<float>"))
    units = sized.mapInArrow(run, "model string, chunk_id bigint, unit binary")
    return units.groupBy("model", "chunk_id").agg(F.min("unit").alias("unit"))


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary column whose rows are runs of ``counts`` items."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _rows_of(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """Matrix of a binary column with rows of equal size."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


LISTS = "model string, chunk_id bigint, ids binary, sims binary"


def _coded(units: DataFrame, dim: int) -> DataFrame:
    """``(model, chunk_id, code)``: vectors as 16-bit numbers of their own scale, which is the code's last four bytes.
    Half of their size, and fine enough to tell the members of a group at cosine 0.999 apart."""

    def run(batches):
        for b in batches:
            x = _rows_of(b.column(2), np.float32, dim)
            top = np.abs(x).max(axis=1, keepdims=True)
            code = np.empty((len(x), 2 * dim + 4), np.uint8)
            code[:, : 2 * dim] = np.rint(x * (32767 / top)).astype(np.int16).view(np.uint8)
            code[:, 2 * dim :] = (top / 32767).astype(np.float32).view(np.uint8).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _packed(code.ravel(), np.full(len(x), 2 * dim + 4))], names=["model", "chunk_id", "code"])

    return units.select("model", "chunk_id", "unit").mapInArrow(run, "model string, chunk_id bigint, code binary")


def _decoded(column: pa.Array, dim: int) -> np.ndarray:
    code = _rows_of(column, np.uint8, 2 * dim + 4)
    return np.ascontiguousarray(code[:, : 2 * dim]).view(np.int16).astype(np.float32) * np.ascontiguousarray(code[:, 2 * dim :]).view(np.float32)


def _by_key(batches, keys: int):
    """Record batches of sorted rows, cut so that rows that agree in the first ``keys`` columns are in one batch, with the
    places where a key begins. A key's rows are held together; all others pass by."""
    held: pa.RecordBatch | None = None
    for b in _with_end(batches):
        t = held if b is None else b if held is None or not held.num_rows else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        if t is None or not t.num_rows:
            continue
        change = np.zeros(t.num_rows - 1, bool)
        for i in range(keys):
            c = t.column(i)
            c = c.dictionary_encode().indices if pa.types.is_string(c.type) else c
            change |= np.diff(c.to_numpy()) != 0
        starts = np.concatenate([[0], np.nonzero(change)[0] + 1])
        done = t.num_rows if b is None else int(starts[-1])
        held = t.slice(done)
        if done:
            yield t.slice(0, done), starts[starts < done]


def _curve_lists(coded: DataFrame, sizes: DataFrame, dense: dict, family: Curves, dim: int, window: int, keep: int, width: int, parts: int) -> DataFrame:
    """``LISTS``: the best ``keep`` of each vector's window on each curve, ``width`` on the first."""
    curves = family.count

    def order(batches):
        for b in batches:
            n, x = b.num_rows, _decoded(b.column(2), dim)
            models = b.column(0).dictionary_encode()
            mine = [(dense.get(m), models.indices.to_numpy() == i) for i, m in enumerate(models.dictionary.to_pylist())]
            for c in range(curves):
                key, fine = family.keys(x, c), np.zeros(n, np.int64)
                for cells, rows in mine:
                    if cells and cells[c]:
                        fine[rows] = family.fine_keys(x[rows], c, key[rows], cells[c])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(n, c, np.int32)), pa.array(key), pa.array(fine), b.column(1), b.column(2)], names=["model", "curve", "key", "fine", "chunk_id", "code"])

    def scan(batches):
        now, ids, xs = None, [], []

        def flush():
            x, who = np.concatenate(xs), np.concatenate(ids)
            best, sims = best_in_windows(x, who, width if now[1] == 0 else keep, window)
            real = best >= 0
            counts = real.sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(who)), pa.array(who), _packed(best[real], counts), _packed(sims[real], counts)], names=["model", "chunk_id", "ids", "sims"])

        for b in batches:
            models, curve = b.column(0), b.column(1).to_numpy()
            x, who = _decoded(b.column(3), dim), b.column(2).to_numpy()
            codes = models.dictionary_encode().indices.to_numpy()
            starts = [0, *(np.nonzero((np.diff(curve) != 0) | (np.diff(codes) != 0))[0] + 1).tolist()] if b.num_rows else []
            for a, e in zip(starts, [*starts[1:], b.num_rows], strict=False):
                key = (models[a].as_py(), int(curve[a]))
                if key != now:
                    if ids:
                        yield from flush()
                    now, ids, xs = key, [], []
                ids.append(who[a:e])
                xs.append(x[a:e])
        if ids:
            yield from flush()

    orderings = coded.join(sizes.where("n > 1").select("model"), "model", "left_semi").mapInArrow(order, "model string, curve int, key bigint, fine bigint, chunk_id bigint, code binary")
    tie = F.xxhash64("chunk_id", "curve")  # what shares a key stands in another order on each curve
    places = ["model", "curve", "key", "fine", "tie"]
    ordered = orderings.withColumn("tie", tie).repartitionByRange(parts, *places).sortWithinPartitions(*places)
    return ordered.select("model", "curve", "chunk_id", "code").mapInArrow(scan, LISTS)


def _merge(lists: DataFrame, k: int) -> DataFrame:
    """``(model, chunk_id, neighbours, cosines)`` from ``LISTS``: the best ``k`` different ones of each vector."""

    def run(batches):
        for t, starts in _by_key(batches, 2):
            yield _merged(t, starts, k)

    gathered = lists.repartition("chunk_id").sortWithinPartitions("model", "chunk_id")
    return gathered.mapInArrow(run, "model string, chunk_id bigint, neighbours array<bigint>, cosines array<float>")


def _as_lists(near: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            counts = np.diff(b.column(2).offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _packed(b.column(2).flatten().to_numpy(), counts), _packed(b.column(3).flatten().to_numpy(), counts)], names=["model", "chunk_id", "ids", "sims"])

    return near.mapInArrow(run, LISTS)


def _met_at_neighbours(near: DataFrame, coded: DataFrame, dim: int, width: int) -> DataFrame:
    """``LISTS``: what each vector finds among the neighbours of its neighbours, and among those it is such a neighbour of,
    beyond the last place of its own list.

    Both sides meet at the vector between them: the ones it lists (at most ``width``), held in memory, and the ones that
    list it, which pass by however many they are.
    """
    last = F.when(F.size("cosines") >= width, F.col("cosines")[width - 1]).otherwise(F.lit(-2.0)).cast("float").alias("least")
    mine = cut(near.join(coded, ["model", "chunk_id"]).select("model", "chunk_id", "neighbours", "code", last))
    vec = mine.select("model", F.col("chunk_id").alias("who"), "code", "least")
    listed = mine.select("model", F.col("chunk_id").alias("center"), F.explode("neighbours").alias("who")).join(vec, ["model", "who"])
    listed = listed.select("model", "center", F.lit(0).alias("role"), "who", "code", "least")
    listing = mine.select("model", F.explode("neighbours").alias("center"), F.lit(1).alias("role"), F.col("chunk_id").alias("who"), "code", "least")

    def run(batches):
        now, ids, x, floor = None, np.empty(0, np.int64), np.empty((0, dim), np.float32), np.empty(0, np.float32)
        for b in batches:
            if not b.num_rows:
                continue
            model, center, role, who = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()
            models, vectors, least = model.dictionary_encode(), _decoded(b.column(4), dim), b.column(5).to_numpy()
            names, codes = models.dictionary.to_pylist(), models.indices.to_numpy()
            starts = np.concatenate([[0], np.nonzero((np.diff(center) != 0) | (np.diff(codes) != 0) | (np.diff(role) != 0))[0] + 1]).tolist()
            to, found, cosines, of = [], [], [], []
            for a, e in zip(starts, [*starts[1:], b.num_rows], strict=True):
                key = (names[codes[a]], center[a])
                if key != now:
                    now, ids, x, floor = key, ids[:0], x[:0], floor[:0]
                if role[a] == 0:
                    ids, x, floor = np.concatenate([ids, who[a:e]]), np.concatenate([x, vectors[a:e]]), np.concatenate([floor, least[a:e]])
                elif len(ids):
                    sims, other = vectors[a:e] @ x.T, who[a:e, None] != ids
                    for better, back in ((sims > least[a:e, None]) & other, False), ((sims > floor) & other, True):
                        row, col = np.nonzero(better)
                        there, here = ids[col], who[a:e][row]
                        to.append(there if back else here)
                        found.append(here if back else there)
                        cosines.append(sims[row, col])
                        of.append(np.full(len(row), codes[a]))
            if not to:
                continue
            of, to, found, cosines = (np.concatenate(c) for c in (of, to, found, cosines))
            # A pair is met at several vectors: one row for each vector of the batch, with different ones only.
            order = np.lexsort((found, to, of))
            of, to, found, cosines = of[order], to[order], found[order], cosines[order]
            fresh = np.ones(len(to), bool)
            fresh[1:] = (of[1:] != of[:-1]) | (to[1:] != to[:-1]) | (found[1:] != found[:-1])
            of, to, found, cosines = of[fresh], to[fresh], found[fresh], cosines[fresh]
            heads = np.concatenate([[0], np.nonzero((np.diff(of) != 0) | (np.diff(to) != 0))[0] + 1]) if len(to) else np.empty(0, np.int64)
            counts = np.diff(np.append(heads, len(to)))
            yield pa.RecordBatch.from_arrays([models.dictionary.take(pa.array(of[heads])), pa.array(to[heads]), _packed(found, counts), _packed(cosines.astype(np.float32), counts)], names=["model", "chunk_id", "ids", "sims"])

    both = listed.unionByName(listing).repartition("center").sortWithinPartitions("model", "center", "role")
    return both.mapInArrow(run, LISTS)


def _exact(near: DataFrame, units: DataFrame, dim: int, k: int, more: int) -> DataFrame:
    """The first ``k`` by exact cosines of the first ``k + more`` of each list."""
    mine = near.join(units.select("model", "chunk_id", "unit"), ["model", "chunk_id"]).select("model", "chunk_id", "unit", F.explode(F.slice("neighbours", 1, k + more)).alias("other"))
    pairs = mine.join(units.select("model", F.col("chunk_id").alias("other"), F.col("unit").alias("there")), ["model", "other"])

    def run(batches):
        for b in batches:
            sims = np.einsum("ij,ij->i", _rows_of(b.column(3), np.float32, dim).astype(np.float64), _rows_of(b.column(4), np.float32, dim))
            one = np.ones(b.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _packed(b.column(2).to_numpy(), one), _packed(sims.astype(np.float32), one)], names=["model", "chunk_id", "ids", "sims"])

    return _merge(pairs.select("model", "chunk_id", "other", "unit", "there").mapInArrow(run, LISTS), k)


def nearest(vectors: DataFrame, k: int = 10, dim: int = 64, curves: int = 16, window: int = 512, keep: int = 6, width: int = 17, settled: float = 0.15) -> DataFrame:
    """``(model, chunk_id, neighbours array<bigint>, cosines array<float>)`` for each usable vector, best first.

    The (approximately) ``k`` most similar other chunks of the same model; ties in cosine go by chunk id. Fewer than k
    where the model has fewer. Unusable rows (see :func:`unit_vectors`) have none and are nobody's neighbour; an empty
    table gives an empty result. Equal unit vectors are each other's first neighbours, exactly: only the one with the
    lowest id is ordered, the others are put back by id.

    On each of ``curves`` orderings ``window`` places to either side are compared and the best ``keep`` kept (``width`` on the first), whatever
    the number of vectors; lists of ``width`` then meet in rounds, until at most the share ``settled`` of all first k places
    is new. So a round's comparisons for a vector are bounded, and the work grows with the number of vectors (recall
    measured against brute force: README); a model of at most ``window`` vectors is compared exhaustively. No vector set is broadcast or collected but a sample of bounded size,
    which shows where groups of close vectors crowd a cell.
    """
    if width < k:
        raise ValueError("lists must be at least as wide as k")
    units = cut(unit_vectors(vectors, dim))
    sizes = units.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    total, models = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 2 * window, 1))).first()
    # The k + 1 lowest ids are all that can be among anybody's k best; the limit is taken on both sides of the shuffle.
    place = F.row_number().over(Window.partitionBy("model", "unit").orderBy("chunk_id"))
    heads = units.withColumn("__r", place).where(F.col("__r") <= k + 1).groupBy("model", "unit").agg(F.array_sort(F.collect_list("chunk_id")).alias("same"))
    heads = cut(heads.where(F.size("same") > 1))
    copied = not heads.isEmpty()
    every = units
    if copied:
        units = units.join(heads.select("model", "unit", F.col("same")[0].alias("first")), ["model", "unit"], "left").where("first IS NULL OR first = chunk_id").select("model", "chunk_id", "unit")
    few = F.least(F.lit(1.0), F.lit(min(20_000, 200_000 // max(models, 1))) / F.col("n"))
    picked = units.join(sizes.where(F.col("n") > 2 * window), "model").where(F.pmod(F.xxhash64("chunk_id", F.lit("sample")), F.lit(1 << 20)) < few * (1 << 20)).select("model", "unit", "n")
    samples: dict[str, list] = {}
    for r in picked.collect():
        samples.setdefault(r.model, [r.n]).append(bytes(r.unit))
    family = Curves(dim, curves)
    dense = {}
    for model, (n, *seen) in samples.items():
        crowd = max(32, int(window * len(seen) / n))
        dense[model] = family.dense_cells(np.frombuffer(b"".join(seen), np.float32).reshape(-1, dim), crowd)
    coded = cut(_coded(units, dim))
    # A partition is many windows long, so few places lie near its ends, and holds some ten MB.
    parts = max(1, curves * total // max(50_000, 100 * window) + 1)
    near = cut(_merge(_curve_lists(coded, sizes, dense, family, dim, window, keep, width, parts), width))
    fresh = 1.0
    while fresh > settled:
        before, near = near, cut(_merge(_as_lists(near).unionByName(_met_at_neighbours(near, coded, dim, width)), width))
        best = lambda df, name: df.select("model", "chunk_id", F.slice("neighbours", 1, k).alias(name))
        both = best(near, "now").join(best(before, "then"), ["model", "chunk_id"])
        new, all_ = both.agg(F.sum(F.size(F.array_except("now", "then"))), F.sum(F.size("now"))).first()
        fresh = (new or 0) / (all_ or 1)
    found = _exact(near, units, dim, k, min(2, width - k))
    # Lists can be empty where a model has one vector.
    near = units.select("model", "chunk_id").join(found, ["model", "chunk_id"], "left")
    none = lambda t: F.array().cast(f"array<{t}>")
    near = near.select("model", "chunk_id", F.coalesce("neighbours", none("bigint")).alias("neighbours"), F.coalesce("cosines", none("float")).alias("cosines"))
    return _with_copies(near, every, heads, k) if copied else near


def _with_copies(near: DataFrame, units: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """Lists of one vector of each group of equal ones made lists of all vectors, with all vectors as neighbours.

    ``heads(model, unit, same)``: the k + 1 lowest ids of each group of several; the lowest is the one that has a list.
    """
    near = cut(near)
    groups = heads.select("model", F.col("same")[0].alias("other"), "same")
    pairs = near.select("model", "chunk_id", F.explode(F.arrays_zip("neighbours", "cosines")).alias("x")).select("model", "chunk_id", F.col("x.neighbours").alias("other"), F.col("x.cosines").alias("cosine"))
    pairs = pairs.join(groups, ["model", "other"], "left").select("model", "chunk_id", "cosine", F.explode(F.coalesce("same", F.array("other"))).alias("other"))
    entry = F.struct((-F.col("cosine")).alias("c"), F.col("other").alias("id"))
    lists = near.select("model", "chunk_id").join(pairs.groupBy("model", "chunk_id").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("near")), ["model", "chunk_id"], "left")
    members = units.join(heads, ["model", "unit"], "left").select("model", F.col("chunk_id").alias("member"), F.coalesce(F.col("same")[0], "chunk_id").alias("chunk_id"), F.coalesce("same", F.array().cast("array<bigint>")).alias("same"))
    own = F.transform(F.filter("same", lambda i: i != F.col("member")), lambda i: F.struct(F.lit(-1.0).cast("float").alias("c"), i.alias("id")))
    best = F.slice(F.concat(own, F.coalesce("near", F.array().cast("array<struct<c:float,id:bigint>>"))), 1, k)
    out = members.join(lists, ["model", "chunk_id"]).select("model", F.col("member").alias("chunk_id"), best.alias("b"))
    return out.select("model", "chunk_id", F.transform("b", lambda e: e["id"]).alias("neighbours"), F.transform("b", lambda e: -e["c"]).alias("cosines"))


def _with_end(batches):
    yield from batches
    yield None


def _merged(t: pa.RecordBatch, starts: np.ndarray, k: int) -> pa.RecordBatch:
    """Lists of the same chunk and model, which stand together, made one: distinct, by cosine, then id."""
    ids = np.frombuffer(b"".join(t.column(2).to_pylist()), np.int64)
    sims = np.frombuffer(b"".join(t.column(3).to_pylist()), np.float32)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
    owner = np.repeat(group, pc.binary_length(t.column(2)).to_numpy() // 8)
    # Products of one pair may differ in the last bits between orderings; the largest counts.
    o = np.lexsort((-sims, ids, owner))
    first = np.ones(len(o), bool)
    first[1:] = (owner[o][1:] != owner[o][:-1]) | (ids[o][1:] != ids[o][:-1])
    o = o[first]
    o = o[np.lexsort((ids[o], -sims[o], owner[o]))]
    sizes = np.bincount(owner[o], minlength=len(starts))
    place = np.arange(len(o)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    o = o[place < k]
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.minimum(sizes, k))]).astype(np.int32))
    at = pa.array(starts)
    return pa.RecordBatch.from_arrays(
        [pc.take(t.column(0), at), pc.take(t.column(1), at), pa.ListArray.from_arrays(offsets, pa.array(ids[o])), pa.ListArray.from_arrays(offsets, pa.array(np.minimum(sims[o], np.float32(1))))],
        names=["model", "chunk_id", "neighbours", "cosines"],
    )


def mutual_pairs(neighbours: DataFrame, least: float = 0.92) -> DataFrame:
    """``(chunk_id_a, chunk_id_b)``, a < b: pairs with at least this cosine, each among the other's neighbours."""
    near = neighbours.select("model", "chunk_id", F.explode(F.arrays_zip("neighbours", "cosines")).alias("x")).where(F.col("x.cosines") >= least)
    other = F.col("x.neighbours")
    # Either side names the pair once; seen from both sides it is mutual. One pass over the lists, combined before the shuffle.
    sides = near.groupBy("model", F.least("chunk_id", other).alias("chunk_id_a"), F.greatest("chunk_id", other).alias("chunk_id_b")).agg(F.max(F.col("chunk_id") < other).alias("up"), F.max(F.col("chunk_id") > other).alias("down"))
    return sides.where("up AND down").select("chunk_id_a", "chunk_id_b").distinct()
