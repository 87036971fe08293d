import random

import numpy as np
import pytest

from corbel.llm.shared_spans import SharedSpans, _common, anchors, block_index, factors


def _brute(texts, span):
    """Pairs of ids that share a span, and covered places of each id."""
    grams, covered, pairs = {}, {i: set() for i in texts}, set()
    for i, t in texts.items():
        for p in range(len(t or "") - span + 1):
            grams.setdefault(t[p : p + span], []).append((i, p))
    for places in grams.values():
        ids = {i for i, _ in places}
        if len(ids) > 1:
            pairs |= {(a, b) for a in ids for b in ids if a < b}
            for i, p in places:
                covered[i] |= set(range(p, p + span))
    return pairs, covered


def _corpus(seed, span):
    rnd = random.Random(seed)
    words = ["alpha", "beta ", "Γάμμα", "d", "  ", "\r\n", "é", "😀", "x1"]
    make = lambda n: "".join(rnd.choice(words) for _ in range(n))
    common, licence = make(60)[:span], make(80)[: span - 1]
    texts = {}
    for i in range(60):
        t = make(rnd.randint(0, 120))
        at = rnd.randint(0, len(t))
        if i % 5 == 0:
            t = t[:at] + common + t[at:]
        if i % 2:
            t = t[:at] + licence + t[at:]
        if i % 7 == 0 and i:
            src = texts[rnd.randrange(i)] or ""
            p = rnd.randint(0, len(src))
            t += src[p : p + rnd.choice([span - 1, span, span + 1, 3 * span])]
        texts[i] = t
    texts |= {60: None, 61: "", 62: texts[5], 63: texts[5], 64: "=" * (4 * span), 65: "a" + "=" * (2 * span), 66: "ab" * 3 * span, 67: "b" + "ab" * span, 68: "=" * (span - 1)}
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    span = 60
    texts = _corpus(seed, span)
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()] + [(62, texts[62], 0), (None, texts[5], 0)], "doc_id long, text string, doc int")
    parse = SharedSpans(df.drop("doc"), span=span)
    pairs, covered = _brute(texts, span)
    got = [tuple(r) for r in parse.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    rows = parse.spans().collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert {p for s in r.spans for p in range(s["start"], s["end"])} == covered[r.doc_id]
        assert r.shared_chars == len(covered[r.doc_id]) and r.share == (len(covered[r.doc_id]) / len(texts[r.doc_id]) if texts[r.doc_id] else 0)


def test_anchors_of_repetitive_text_are_few():
    owner, *_ = anchors(["=" * 5000, "ab" * 2500], 100, 101)
    assert len(owner) < 450


def test_every_window_holds_an_anchor():
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abc") for _ in range(700)) for _ in range(4)]
    owner, _key, first, last = anchors(texts, 30, 31)
    assert (first == last).all()
    for i in range(4):
        p = np.sort(first[owner == i])
        assert p[0] < 31 and (np.diff(p) <= 31).all() and p[-1] >= 700 - 60


def test_common():
    assert [_common(a, b) for a, b in [("", ""), ("abc", "abd"), ("abc", "abc"), ("abc", "ab"), ("x", "y")]] == [0, 2, 3, 2, 0]


def test_a_parse_finds_every_span_of_the_block():
    rnd = random.Random(4)
    for alphabet in ("ab", "abcdefgh", "aaab"):
        for _ in range(300):
            block = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 90)))
            record = "".join(block[(p := rnd.randint(0, len(block))) : p + rnd.randint(0, 40)] + rnd.choice(alphabet) for _ in range(4))
            got = factors(record, block, block_index(block, 10), 10, 20)
            assert all(record[a:b] == block[j : j + b - a] and b - a >= 20 for a, b, j in got)
            assert {i for a, b, _ in got for i in range(a, b)} == {i for p in range(len(record) - 19) if record[p : p + 20] in block for i in range(p, p + 20)}


def test_span_classes_name_a_block_all_share(spark):
    rnd = random.Random(5)
    make = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    common = make(300)
    docs = spark.createDataFrame([(i, make(50) + common + make(50)) for i in range(30)] + [(99, make(500))], "doc_id long, text string")
    rows = SharedSpans(docs, span=60).span_classes().collect()
    assert max(r.members for r in rows) == 30 and all(r.members > 1 for r in rows)
    assert {r.doc_id for r in rows if r.links == 0} <= {0}


def test_empty_table(spark):
    parse = SharedSpans(spark.createDataFrame([], "doc_id long, text string"))
    assert parse.pairs().count() == 0 and parse.spans().count() == 0
