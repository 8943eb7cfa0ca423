import hashlib

import pytest

from tempora.llm import warc as W


@pytest.mark.parametrize("payload", [b"", b"x", b"a" * 16384, b"a" * 40_000, ("é日" * 9000).encode(), b"0\r\n\r\nWARC/1.1\r\n"])
def test_chunks(payload):
    assert W.dechunk(W.chunked(payload, 1000)) == payload
    if len(payload) > 10:
        with pytest.raises(ValueError):
            W.dechunk(W.chunked(payload, 1000)[: len(payload) // 2])


def test_round_trip(spark, tmp_path):
    big = "é日<p>" * 60_000
    trap = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 10
    rows = [(1, "http://a b", "<p>one</p>" * 20), (2, None, "<p>one</p>" * 20), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", big), (8, "u", big), (9, "u", trap), (10, "u\r\n\r\nWARC/1.1", "\r\n\r\n\n"), (0, "u", "z" * 100), (11, "u", "z" * 100), (12, "u", "z" * 99), (13, "u", "z" * 99)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    out = {r.page_id: r for r in W.archive(pages).collect()}
    assert len(out) == len(rows)
    first = {}
    for i, _, h in sorted(rows):
        h = (h or "").encode()
        want = first.setdefault(h, i) if len(h) >= 100 else i
        r = out[i]
        assert r.error is None and r.payload_bytes == len(h) and r.payload_digest == hashlib.sha256(h).hexdigest()
        assert (r.record_type, r.refers_to) == (("response", None) if want == i else ("revisit", want))
        if want == i:
            assert bytes(r.payload) == h
    assert {r.page_id for r in W.digest_rows(pages).collect()} == {r[0] for r in rows}


def test_segments_and_faults():
    recs = [(r + "\r\n").encode() for r in W.records(1, 0, "u", "abcdefghij" * 50, None, 120)]
    assert len(recs) > 3
    got = list(W.parse(b"".join(recs)))
    parts = [(int(f.get("warc-segment-number")), int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, b) for f, b, _ in got]
    assert W._assemble(parts[::-1], False) == (b"abcdefghij" * 50, None)
    assert W._assemble(parts[:-1], False)[1] and W._assemble(parts[1:], False)[1] and W._assemble(parts + parts[:1], False)[1]
    assert [e for *_, e in W.parse(recs[0][:-60])] == ["block is cut short"]


def test_repeated_null_and_empty(spark):
    pages = spark.createDataFrame([(None, None, "q" * 200), (1, "u", "q" * 200), (1, "u", "q" * 200)], "page_id long, url string, html string")
    out = W.digest_rows(pages).collect()
    assert sorted((str(r.page_id), r.record_type) for r in out) == [("1", "revisit"), ("1", "revisit"), ("None", "response")]
    assert W.digest_rows(pages.limit(0)).count() == 0


def test_malformed_archives(spark, tmp_path):
    import gzip

    one = (W.records(1, 0, "u", "abc", None)[0] + "\r\n").encode()
    bad = one.replace(b"Content-Length: ", b"Content-Length: x")
    foreign = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\nWARC-Page-ID: no\r\n\r\nabc\r\n\r\n"
    got = list(W.parse(b"junk" + bad + foreign + one))
    assert [e for *_, e in got if e] == ["no record begins here", "the length is missing or no number"] and got[-1][2] is None
    packed = gzip.compress(one) + gzip.compress(one)
    assert len(list(W.parse(packed))) == 2
    cut_short = list(W.parse(packed[:-30]))
    assert cut_short[0][2] is None and cut_short[-1][2]
    assert list(W.parse(b"")) == []
    (tmp_path / "a").mkdir()
    lone = W.records(5, 0, "u", "z" * 50_000, None)[1].encode() + b"\r\n"  # a continuation without its origin
    for name, data in (("a.warc", bad + foreign + one), ("b.warc.gz", packed[:-30]), ("c.warc", b""), ("d.warc", lone)):
        (tmp_path / "a" / name).write_bytes(data)
    rows = W.read(spark, str(tmp_path / "a")).collect()
    assert sum(r.error is None for r in rows) >= 3 and sum(r.error is not None for r in rows) >= 3
    assert any(r.page_id is None and r.error is None and r.payload_bytes == 3 for r in rows)


def test_a_block_without_an_http_header_is_all_payload():
    assert W._assemble([(1, None, b"abc")], True) == (b"abc", None)
    assert W._assemble([(1, None, b"a\r\n\r\nb")], True) == (b"a\r\n\r\nb", None)
    assert W._assemble([(1, None, b"HTTP/1.1 200 OK\r\n\r\nabc")], True) == (b"abc", None)
