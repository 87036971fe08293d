import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corbel.llm import bpe, packing


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=bpe.encoder().ranks, special_tokens={})


def test_every_token_encodes_to_itself():
    e = bpe.encoder()
    assert all(bpe.PrefixTable(e).append(name).tokens() == [t] for name, t in list(e.ranks.items())[::7])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_equals_the_public_encoder(text):
    ref = tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=bpe.encoder().ranks, special_tokens={})
    text = text.encode("utf-8", "replace").decode()
    assert bpe.encoder().encode(text) == ref.encode_ordinary(text)


def test_append_and_rewrite_equal_a_fresh_table():
    e, rnd = bpe.encoder(), random.Random(5)
    for _ in range(100):
        data = bytes(rnd.choice(b"abcthe in=-\xc3\xa9") for _ in range(40))
        at = rnd.randrange(40)
        table = bpe.PrefixTable(e).append(data[:at]).append(data[at:])
        assert table.tokens() == bpe.PrefixTable(e).append(data).tokens()
        assert table.rewrite(at, b"the end").tokens() == bpe.PrefixTable(e).append(data[:at] + b"the end").tokens()


def test_corpus_with_odd_rows(spark, reference):
    texts = ["plain words", None, "", "   ", "<|endoftext|>", "x" * 30000, "plain words", "a�b é́"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(df).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(df).collect()} == {i: len(v) for i, v in got.items()}
    assert bpe.encode_corpus(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 60), st.lists(st.tuples(st.integers(1, 30), st.integers(1, 4)), max_size=6, unique_by=lambda x: x[0]))
def test_fullest_is_optimal(room, available):
    sums = {0}
    for size, n in available:
        sums = {s + size * k for s in sums for k in range(n + 1) if s + size * k <= room}
    chosen = packing.fullest(room, available)
    assert sum(s * n for s, n in chosen.items()) == max(sums)
    assert all(n <= dict(available)[s] for s, n in chosen.items())


def _containers(rows):
    fill = {}
    for r in rows:
        if r.container is not None:
            fill[r.container] = fill.get(r.container, 0) + r.n_tokens
    return fill


def test_packing_keeps_all_and_wastes_little(spark):
    rnd = random.Random(3)
    sizes = [rnd.choice([0, 1, 7, 100, 100, 100, 333, 512, 1999, 2048, 2049, 9000]) for _ in range(3000)] + [None, -4]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long")
    rows = packing.pack(df).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, n in enumerate(sizes):
        n = max(n or 0, 0)
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in parts) == n
        assert [r.first_token for r in parts] == [2048 * k for k in range(len(parts))]
        assert len(parts) == max(1, -(-n // 2048))
        assert (parts[0].container is None) == (n == 0)
    fill = _containers(rows)
    assert max(fill.values()) <= 2048 and sorted(fill) == list(range(len(fill)))
    assert len(fill) <= -(-sum(max(n or 0, 0) for n in sizes) // 2048) * 1.03 + 1


def test_packing_empty_and_hot_size(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0
    rows = packing.pack(spark.range(5000).selectExpr("id as doc_id", "1000L as n_tokens")).collect()
    fill = _containers(rows)
    assert len(fill) == 2500 and set(fill.values()) == {2000}
