import gzip
import hashlib

import pytest

from barline.llm import web_archive as op

PAGES = [
    (1, "http://a.example/x", "<p>" + "text " * 40 + "</p>"),
    (2, "http://a.example/with space", "<p>" + "text " * 40 + "</p>"),
    (7, None, "<p>" + "text " * 40 + "</p>"),
    (3, "http://b.example/ü", "short"),
    (4, "http://b.example/2", "short"),
    (5, "", None),
    (6, "http://c.example/", "\r\n\r\nWARC/1.1\r\n\r\n 1 0 x \n\n é\U0001f600" * 30),
    (8, "http://c.example/long", "ä" * 3_000_000),
    (9, "http://c.example/long", "ä" * 3_000_000),
    (9, "http://c.example/long", "ä" * 3_000_000),
    (2**60 + 1, "http://d.example/", "x" * 100),
    (2**60, "http://d.example/", "x" * 100),
    (10, "http://d.example/", "x" * 99),
    (11, "http://d.example/", "x" * 99),
]


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "payload", 1, b"h") for r in rows], "page_id bigint, url string, html string, payload_digest string, salt int, head binary"
    )


def brute(rows):
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and first[h or ""] < i
        digest = hashlib.sha256(data).hexdigest()
        out.append((i, len(data), digest, "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(spark, tmp_path, version):
    arc, warc = str(tmp_path / "arc"), str(tmp_path / "warc")
    op.write_arc(frame(spark, PAGES).repartition(3), arc, version)
    op.convert(spark, arc, warc)
    got = op.read_warc(spark, warc).collect()
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=repr) == brute(PAGES)
    html = {i: (h or "").encode() for i, _, h in PAGES}
    ids = {r["record_id"]: r["page_id"] for r in got}
    for r in got:
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == html[r["page_id"]]
        else:
            assert r["payload"] is None and ids[r["refers_to_record"]] == r["refers_to"]
        assert r["date"] == "1996-01-01T00:00:00Z"
    urls = {r["page_id"]: r["url"] for r in got}
    assert urls[2] == "http://a.example/with%20space" and urls[7] is None


def test_mixed_versions_and_short_dates():
    one = op.version_block(1, "a.arc") + "\nhttp://a/ 1.2.3.4 1997 text/html 5\nhello\n\nhttp://b/ 1.2.3.4 19970203 text/html 0\n\n"
    two = op.version_block(2, "b.arc") + "\nhttp://c/ 1.2.3.4 19980101000000 text/html 404 abc - 0 b.arc 3\nx\ny\n"
    got = list(op.arc_records(gzip.compress(one.encode()) + gzip.compress(two.encode())))
    assert [(f["URL"], b) for f, b in got] == [("http://a/", b"hello"), ("http://b/", b""), ("http://c/", b"x\ny")]
    assert got[2][0]["Result-code"] == "404"
    assert op.iso_date(got[0][0]["Archive-date"]) == "1997-01-01T00:00:00Z"
    assert list(op.arc_records(two.encode()))[0][1] == b"x\ny"


@pytest.mark.parametrize("bad", ["http://a/ 1.2.3.4 1997 text/html 50\nhello", "http://a/ 1997 text/html 5\nhello"])
def test_damaged_archives_are_refused(bad):
    with pytest.raises(ValueError):
        list(op.arc_records((op.version_block(1, "a.arc") + "\n" + bad).encode()))
    with pytest.raises(ValueError):
        list(op.warc_records(b"WARC/1.1\r\nContent-Length: 2\r\nWARC-Block-Digest: sha256:00\r\n\r\nab\r\n\r\n"))


def test_empty_table(spark, tmp_path):
    arc, warc = str(tmp_path / "arc"), str(tmp_path / "warc")
    op.write_arc(frame(spark, []), arc)
    op.convert(spark, arc, warc)
    assert op.read_warc(spark, warc).count() == 0
