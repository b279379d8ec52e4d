import random

import pytest

from factspark.llm import queries, warc


def brute(rows, least=0):
    payload = [(html or "").encode() for _, _, html in rows]
    out = []
    for (i, _, _), p in zip(rows, payload):
        group = [j for (j, _, _), q in zip(rows, payload) if q == p and j is not None] if len(p) >= least else []
        first = min(group, default=None)
        revisit = first is not None and first != i
        out.append((i, len(p), warc.base32_sha1(p), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def made():
    r = random.Random(6)
    long = ["".join(r.choice("abc é\r\n<>0") for _ in range(n)) for n in (16_000, 60_000, 200_000)]
    html = ["", None, "a", "a", "WARC/1.1\r\n\r\n", "0\r\n\r\n", *long, long[1], "\r\n" * 30_000]
    rows = [(i, f"http://x/{i}", html[i % len(html)]) for i in range(60)]
    return rows + [(3, "http://x/3", html[3]), (70, None, "only"), (70, "again", "only"), (71, "bad\r\nX-Page-Id: 5", "é" * 9000), (None, "n", "a"), (None, "n", "no id")]


@pytest.mark.parametrize("least", [0, 2])
def test_round_trip(spark, least):
    rows = made()
    got = warc.round_trip(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, segments int"), least)
    assert sorted([tuple(r)[:5] for r in got.collect()], key=str) == brute(rows, least)
    assert got.agg({"segments": "max"}).first()[0] > 5


def test_payloads_and_files(spark, tmp_path):
    rows = [(i, "u", "x" * n + "ü") for i, n in enumerate((5, 40_000, 100_000))]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/w")
    got = {r.page_id: bytes(r.payload) for r in warc.read(spark, f"{tmp_path}/w", with_payload=True).collect()}
    assert got == {i: h.encode() for i, _, h in rows if i}
    found = [f for p in sorted((tmp_path / "w").glob("part-*.gz")) for f, _ in warc.parse(p.read_bytes())]
    assert {f["warc-type"] for f in found} == {"response", "continuation"}


def test_missing_segment(spark):
    parts = list(warc.response_records(1, 0, "u", b"y" * 50_000, warc.base32_sha1(b"y" * 50_000)))
    blocks = [next(warc.parse(p + b"\r\n\r\n")) for p in parts]
    rows = [(int(f["warc-segment-number"]), b, int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None) for f, b in blocks]
    assert warc.payload_of(warc.reassemble(rows[::-1])) == b"y" * 50_000
    for broken in (rows[:-1], rows[1:], rows[:1] + rows[2:], [*rows[:-1], (rows[-1][0], rows[-1][1], 7)]):
        with pytest.raises(ValueError):
            warc.reassemble(broken)
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"


def test_query_on_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op6_warc_round_trip(spark, str(tmp_path)).collect() == []
