import random

from corbel.llm.splitting import split_oversized

SCHEMA = "id long, text string, start_line int, end_line int, context_header string, part int"


def _texts():
    rnd = random.Random(11)
    lines = ["", "x = 1;  y = 2", "déjà vu " * 9, "    return ünïcödé", "print('ok')  # " + "a" * 70]
    yield "".join(rnd.choice(lines) + "\n" for _ in range(900))
    yield "".join(rnd.choice(lines) + "\r\n" for _ in range(500)) + "no line end"
    yield "€" * 5000
    yield "short\n" + "z" * 20000 + "\ntail\n"
    yield "word " * 4000
    yield "\n" * 9000
    yield "a" * 4097
    yield "😀" * 3000 + "\n" + "b; " * 3000


def _lines_up_to(text, at):
    return text.encode()[:at].count(b"\n")


def test_round_trip_limits_and_lines(spark):
    texts = dict(enumerate(_texts()))
    df = spark.createDataFrame([(i, t, 10, 5, None if i % 2 else "h", 0) for i, t in texts.items()], SCHEMA)
    rows = split_oversized(df).collect()
    for i, text in texts.items():
        parts = sorted((r for r in rows if r.chunk_id == i), key=lambda r: r.part)
        assert [r.part for r in parts] == list(range(1, parts[0].n_parts + 1)) and len(parts) >= 2
        at = 0
        for k, r in enumerate(parts):
            data = r.text.encode()
            assert 0 < len(data) <= 4096 and r.overlap_bytes <= 256
            assert r.context_header == ("" if i % 2 else "h")
            start = at - r.overlap_bytes
            assert text.encode()[start : start + len(data)] == data
            if k and r.overlap_bytes:
                over = data[: r.overlap_bytes]
                assert over.endswith(b"\n") and (start == 0 or text.encode()[start - 1 : start] == b"\n")
            if k and not r.overlap_bytes:
                prev = parts[k - 1].text.encode()
                head = text.encode()[: at - len(prev)]
                whole = b"\n" in prev[:-1] or not head or head.endswith(b"\n")  # the last line starts in that piece
                assert not prev.endswith(b"\n") or not whole or len(prev[:-1].rpartition(b"\n")[2]) + 1 > 256
            assert r.start_line == 5 + _lines_up_to(text, start)
            assert r.end_line == 5 + _lines_up_to(text, start + len(data)) - data.endswith(b"\n")
            at = start + len(data)
        assert at == len(text.encode())


def test_cuts_at_line_ends_where_possible(spark):
    text = "".join(f"value_{i} = {i}\n" for i in range(2000))
    rows = split_oversized(spark.createDataFrame([(1, text, 1, 2000, "h", 0)], SCHEMA)).collect()
    assert all(r.text.endswith("\n") for r in rows)
    assert all(r.overlap_bytes > 200 for r in rows if r.part > 1)


def test_small_null_empty_and_repeated_rows(spark):
    big = "line\n" * 2000
    df = spark.createDataFrame([(1, None, 1, 1, "h", 0), (2, "", 1, 1, "h", 0), (3, "a" * 4096, 1, 1, "h", 0), (4, big, None, None, "h", 0), (4, big, None, None, "h", 0), (None, big, 3, None, None, 0)], SCHEMA)
    rows = split_oversized(df).collect()
    assert {r.chunk_id for r in rows} == {4, None}
    assert len({(r.chunk_id, r.part) for r in rows}) == len(rows)
    assert min(r.start_line for r in rows if r.chunk_id == 4) == 1
    assert split_oversized(df.limit(0)).count() == 0
