"""Problem 8: filling containers of fixed capacity by minimum bin slack.

Items count only by their size, and sizes lie between 1 and the capacity. The packing is therefore planned on the
histogram of sizes, which has at most ``capacity`` rows however many items there are, and items are then dealt to the
planned places by their number within their size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.llm.bpe import DEFAULT_VOCABULARY, count_tokens
from corbel.operators.ranking import group_positions
from corbel.session import cut


def fullest(room: int, available: Sequence[tuple[int, int]]) -> dict[int, int]:
    """The choice of available sizes (size, number) whose sum comes closest to ``room`` from below.

    Bitset dynamic programming: bit s of ``reach`` says that a sum of s is feasible. A size that may be taken up to n
    times enters as multiples 1, 2, 4, ... so that all numbers up to n are covered.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for size, number in available:
        left, part = min(number, room // size), 1
        while left > 0:
            take = min(part, left)
            wider = reach | (reach << (size * take)) & mask
            if wider != reach:
                steps.append((reach, size, take))
                reach = wider
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, size, take in reversed(steps):
        if not before >> total & 1:
            chosen[size] = chosen.get(size, 0) + take
            total -= size * take
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Minimum bin slack over a histogram of sizes: ``(segments, number of containers)``.

    Each container starts from the largest size left and takes the fullest feasible combination beside it. A
    combination is repeated while the numbers of its sizes last. A segment ``(size, first, last, container, each)``
    says that items ``first .. last`` (0-based) of a size go to the containers from ``container`` on, ``each`` in one.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    given = dict.fromkeys(left, 0)
    segments, container = [], 0
    order = sorted(left, reverse=True)
    while order:
        seed = order[0]
        room = capacity - seed
        available = [(s, left[s] - (s == seed)) for s in order if s <= room and left[s] > (s == seed)]
        chosen = fullest(room, available) if room and available else {}
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(left[s] // n for s, n in chosen.items())
        for s, n in chosen.items():
            segments.append((s, given[s], given[s] + n * times - 1, container, n))
            given[s] += n * times
            left[s] -= n * times
        container += times
        order = [s for s in order if left[s]]
    return segments, container


def pieces_of(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """``(id, piece, first_token, n_tokens)``: one row for an item that fits; an oversized item gives full pieces and a rest."""
    n = F.col(size_col)
    count = F.greatest(F.lit(1), F.ceil(n / capacity)).cast("int")
    cut_up = sizes.select(F.col(id_col), n.cast("bigint").alias("__n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    first = F.col("piece").cast("bigint") * capacity
    return cut_up.select(id_col, "piece", first.alias("first_token"), F.least(F.lit(capacity).cast("bigint"), F.col("__n") - first).alias("n_tokens"))


def pack(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = 2048) -> DataFrame:
    """Assign items to containers: ``(id, piece, first_token, n_tokens, container)``.

    Every row of ``sizes`` comes out. Sizes of 0 (and null or negative ones, which count as 0) take no place: one row
    with a null container. Items above the capacity are split into full pieces and one rest. Repeated rows are items
    of their own; null ids are kept. An empty table gives an empty result.

    Each (size, hash cell of the id) is numbered by itself and offset by the counts of the cells before it, so a size
    that a third of all items share is spread over all cells. ``sizes`` is read twice: hand over a stored table.
    """
    sizes = sizes.select(F.col(id_col), F.greatest(F.lit(0), F.coalesce(F.col(size_col), F.lit(0))).cast("bigint").alias(size_col))
    empty = sizes.where(F.col(size_col) == 0).select(id_col, F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("first_token"), F.col(size_col).alias("n_tokens"), F.lit(None).cast("bigint").alias("container"))
    items = pieces_of(sizes.where(F.col(size_col) > 0), id_col, size_col, capacity)
    counted = items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    segments, _ = plan({int(r[0]): int(r[1]) for r in counted}, capacity)
    total = sum(int(r[1]) for r in counted)
    cells = max(1, min(1 << 20, total // 250_000 + 1)) * 8
    numbered = group_positions(items, ["n_tokens"], [F.col(id_col), F.col("piece")], F.pmod(F.xxhash64(id_col), F.lit(cells)), "number")
    segments.sort()
    size, first, _last, start, each = (np.array(x, np.int64) for x in zip(*segments, strict=True)) if segments else (np.zeros(0, np.int64),) * 5
    # A plan has at most a few segments for each of at most `capacity` sizes, so it is small enough for the closure.
    kind = sizes.schema[id_col].dataType.simpleString()

    def place(batches):
        width = np.int64(1) << 40
        keys = size * width + first
        for b in batches:
            n, number = b.column(3).to_numpy(), b.column(4).to_numpy() - 1
            at = np.searchsorted(keys, n * width + number, side="right") - 1
            where = start[at] + (number - first[at]) // each[at]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(4)] + [pa.array(where, pa.int64())], names=[id_col, "piece", "first_token", "n_tokens", "container"])

    placed = numbered.mapInArrow(place, f"`{id_col}` {kind}, piece int, first_token bigint, n_tokens bigint, container bigint")
    return placed.unionByName(empty)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """:func:`pack` of texts sized in tokens of a public vocabulary; texts are tokenised once."""
    return pack(cut(count_tokens(docs, id_col, text_col, vocabulary)), id_col, "n_tokens", capacity)
