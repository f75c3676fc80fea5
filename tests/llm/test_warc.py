import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from liveops.llm import warc

PAGES = "page_id long, url string, html string"


def test_round_trip(spark, tmp_path):
    """Payloads come back byte for byte, whatever they hold; equal ones of 1000 bytes are revisits."""
    rng = random.Random(1)
    tricky = "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n0\r\n\r\n" * 40
    texts = {
        1: "a" * 1000, 2: "a" * 1000, 3: "a" * 1000, 4: "b" * 999, 5: "b" * 999, 6: "", 7: None, 8: tricky,
        9: tricky, 10: "é€🙂" * 30_000, 11: "\r\n" * 700, 12: "x\r", 13: "\n", 14: "x" * 300_000 + "\r\n",
        15: "".join(rng.choice("ab\r\n€") for _ in range(90_000)),
    }
    rows = [(i, f"http://e.org/{i}\n", t) for i, t in texts.items()]
    pages = spark.createDataFrame([*rows, (None, None, "n" * 2000), (12, None, "x\r")], PAGES)
    pages = pages.withColumns({"digest": F.lit("clash"), "size": F.lit(1)})
    warc.write(pages, str(tmp_path / "a"))
    got = warc.read(spark, str(tmp_path / "a")).collect()
    assert len(got) == len(rows) + 2 and not any(r.problem for r in got)
    for r in got:
        raw = ("n" * 2000 if r.page_id is None else texts[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        origin = {1: 3, 2: 3, 8: 9}.get(r.page_id)
        assert (r.record_type, r.refers_to) == ("revisit" if origin else "response", origin)
        assert r.payload == (None if origin else raw)
    kept = [f for f in (tmp_path / "a").iterdir() if f.name.endswith(".gz")]
    assert kept and gzip.open(kept[0]).read(8) in (b"WARC/1.1", b"")


def test_empty(spark, tmp_path):
    warc.write(spark.createDataFrame([], PAGES), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def _archive(path, records):
    path.mkdir()
    (path / "one.warc.gz").write_bytes(gzip.compress(b"".join(r + b"\r\n" for r in records)))


def test_segments(spark, tmp_path):
    """Segments out of order or archived twice are joined; missing, cut and short ones are named."""
    text = ("some text € " * 3000).encode()
    page = {"url": "u", "payload": text, "size": len(text), "refers_to": None}
    page["digest"] = hashlib.sha1(text).hexdigest()
    of = lambda i: list(warc.page_records(page | {"page_id": i, "record": str(i)}, 10_000, 512))
    whole, missing, short, lone = of(1), of(2), of(3), of(4)
    assert len(whole) == 5
    bad = of(5)
    bad[1] = bad[1].replace(b"some", b"SOME")
    short[-1] = short[-1].replace(b"Segment-Total-Length: ", b"Segment-Total-Length: 1")
    records = [whole[3], *whole, *missing[:2], *missing[3:], *short, *lone[1:], *bad]
    _archive(tmp_path / "s", records[::-1])
    got = {r.page_id: r for r in warc.read(spark, str(tmp_path / "s")).collect()}
    assert {i: r.problem for i, r in got.items()} == {
        1: None, 2: "segment missing", 3: "length differs", 5: "digest differs",
    }
    assert got[1].payload == text
    _archive(tmp_path / "t", [*of(1)[:1], of(6)[0][:5000]])
    assert {r.problem for r in warc.read(spark, str(tmp_path / "t")).collect()} >= {"segment missing"}


@pytest.mark.parametrize("body, want", [
    (b"3\r\nabc\r\n0\r\n\r\n", b"abc"), (b"0\r\n\r\n", b""), (b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n", b"abc"),
    (b"3\r\nab\r\n0\r\n\r\n", None), (b"zz\r\n", None), (b"3\r\nabc", None), (b"", None),
])
def test_unchunked(body, want):
    assert warc.unchunked(body) == want


def test_chunked():
    for n in (0, 1, 511, 512, 513, 5000):
        assert warc.unchunked(warc.chunked(b"q" * n, 512)) == b"q" * n
