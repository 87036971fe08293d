"""Problem 7: corpus encoding with a public byte-level BPE, by prefix dynamic programming.

For every prefix of a byte string exactly one vocabulary token can be the last token of that prefix's encoding.
The table of those last tokens is filled left to right: a token that ends at byte ``i`` is the one sought if it can
stand behind the last token of the prefix before it, that is, if no merge would ever have crossed the boundary.
Reading the table backwards gives the encoding. The table of a prefix never changes when bytes are appended, so
appends are exact, and an edit only recomputes from the piece it touches.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's public pattern of pieces, inside which merges take place.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEVER = 1 << 60


class PrefixTable:
    """Last tokens of all prefixes of one byte string; grows by :meth:`append`."""

    __slots__ = ("bpe", "data", "last")

    def __init__(self, bpe: PrefixEncoder) -> None:
        self.bpe, self.data, self.last = bpe, b"", [-1]

    def append(self, more: bytes) -> PrefixTable:
        """Extend the string; entries of earlier prefixes stay as they are."""
        data, last, vocabulary, tails, fits = self.data + more, self.last, self.bpe.ranks, self.bpe.tails, self.bpe.fits
        for end in range(len(self.data) + 1, len(data) + 1):
            ending, start = [], end - 1
            while start >= 0 and (part := data[start:end]) in tails:
                token = vocabulary.get(part)
                if token is not None:
                    ending.append((token, start))
                start -= 1
            for token, start in reversed(ending):
                if start == 0 or fits(last[start], token):
                    last.append(token)
                    break
        self.data = data
        return self

    def rewrite(self, at: int, tail: bytes) -> PrefixTable:
        """Replace everything from byte ``at`` on; the prefixes before it are kept."""
        self.data = self.data[:at]
        del self.last[at + 1 :]
        return self.append(tail)

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= self.bpe.lengths[out[-1]]
        out.reverse()
        return out


class PrefixEncoder(dict):
    """Encoder of texts; as a dict it maps a piece of text to its ids and fills itself (bounded by ``limit``)."""

    def __init__(self, path: str = DEFAULT_VOCABULARY, pattern: str = PIECES, limit: int = 400_000) -> None:
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.names = {t: b for b, t in self.ranks.items()}
        self.lengths = {t: len(b) for b, t in self.ranks.items()}
        self.tails = {b[i:] for b in self.ranks for i in range(len(b))}
        self.limit, self.find = limit, regex.compile(pattern).findall
        self._fits: dict[tuple[int, int], bool] = {}
        self._halves: dict[int, tuple[int, int]] = {}

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made ``token``: the only split whose halves are older and fit each other."""
        if (known := self._halves.get(token)) is None:
            name, ranks = self.names[token], self.ranks
            for i in range(1, len(name)):
                a, b = ranks.get(name[:i], _NEVER), ranks.get(name[i:], _NEVER)
                if a < token and b < token and self._meet(a, b, token):
                    known = (a, b)
                    break
            else:
                raise ValueError(f"token {token} can't be made by merges")
            self._halves[token] = known
        return known

    def _meet(self, left: int, right: int, until: int) -> bool:
        """No merge crosses the boundary between two tokens before time ``until``.

        Undo, latest first, the merges that made the two tokens. Each pair of neighbours seen on the way stood side
        by side until one of them was merged away from the boundary; a crossing merge that is due before that wins.
        At equal ranks the place further left is merged first.
        """
        names, ranks = self.names, self.ranks
        gone_left = gone_right = until
        while True:
            across = ranks.get(names[left] + names[right], _NEVER)
            if across < gone_left and across <= gone_right and across != until:
                return False
            if left > right and len(names[left]) > 1:
                gone_left, left = left, self.halves(left)[1]
            elif len(names[right]) > 1:
                gone_right, right = right, self.halves(right)[0]
            elif len(names[left]) > 1:
                gone_left, left = left, self.halves(left)[1]
            else:
                return True

    def fits(self, left: int, right: int) -> bool:
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) > 4 * self.limit:
                self._fits.clear()
            known = self._fits[left, right] = self._meet(left, right, _NEVER)
        return known

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        ids = (whole,) if whole is not None else tuple(PrefixTable(self).append(data).tokens())
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; what looks like a special token is plain text. Null and empty give no ids."""
        return list(chain.from_iterable(map(self.__getitem__, self.find(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, self.find(text)))) if text else 0


_encoders: dict[tuple[str, str], PrefixEncoder] = {}


def encoder(path: str = DEFAULT_VOCABULARY, pattern: str = PIECES) -> PrefixEncoder:
    """The process's encoder for a vocabulary; kept over tasks by a reused Python worker."""
    key = (path, pattern)
    if key not in _encoders:
        _encoders[key] = PrefixEncoder(path, pattern)
    return _encoders[key]


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(id_col, ids array<int>)``, one row for each input row, without special tokens.

    No shuffle: each Arrow batch is encoded where it is read, and only the two columns leave the scan. Empty and null
    texts give an empty list; null ids stay; repeated rows are encoded as often as they come; an empty table gives an
    empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = encoder(vocabulary)
        for batch in batches:
            rows = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(id_col, n_tokens bigint)``, one row for each input row; 0 for empty and null texts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = encoder(vocabulary)
        for batch in batches:
            sizes = pa.array([bpe.count(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], names=[id_col, "n_tokens"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")
