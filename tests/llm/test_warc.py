import gzip
import hashlib
import zlib

import pytest

from lamina.llm import files, warc
from lamina.llm.session import new_dir


def rec(i, payload, refers=None):
    return warc.record(i, f"http://x/{i}", payload, hashlib.sha1(payload).hexdigest(), refers)


def test_normaliser_makes_members(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 64)
    raw = [rec(1, b"a\r\n\r\nb" * 500), rec(2, b""), rec(None, b"\x1f\x8b" * 9), rec(3, b"z" * 2000, 9)]
    (tmp_path / "in.gz").write_bytes(gzip.compress(b"".join(raw)))
    t, i = str(tmp_path / "out.gz"), str(tmp_path / "out.idx")
    assert warc.normalise(str(tmp_path / "in.gz"), t, i) == 4
    assert gzip.decompress((tmp_path / "out.gz").read_bytes()) == b"".join(raw)
    places = [x.split() for x in (tmp_path / "out.idx").read_text().splitlines()]
    with files.opened(t) as f:
        for (at, n, kind, _), r in reversed(list(zip(places, raw))):
            head, whole = warc.read_member(f, int(at), int(n))
            assert whole == r and zlib.decompress((tmp_path / "out.gz").read_bytes()[int(at) : int(at) + int(n)], 31) == r
            assert warc.parse(head, whole)[3] == kind
    assert warc.parse(*warc.read_member(files.opened(t), int(places[3][0]), int(places[3][1]))) == (3, 2000, hashlib.sha1(b"z" * 2000).hexdigest(), "revisit", 9)


def test_several_members_and_cut_files(tmp_path):
    raw = rec(1, b"x" * 99)
    (tmp_path / "two.gz").write_bytes(gzip.compress(raw) + gzip.compress(raw))
    with files.opened(str(tmp_path / "two.gz")) as f:
        assert [w for _, w in warc.records(warc.inflated(f))] == [raw, raw]
    with pytest.raises(ValueError):
        list(warc.records([raw[:-20]]))


def test_edge_rows(spark):
    big = "é" * 600
    rows = [(1, "u", big), (2, None, big), (2, "v", big), (None, "w", big), (5, "x", None), (6, "y", ""), (None, None, "n" * 1000), (None, None, "n" * 1000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    crawl = warc.write(warc.with_revisits(df), new_dir(spark, "c"))
    out = warc.read(warc.normalise_all(crawl, new_dir(spark, "w"))).collect()
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in out)
    assert got == [(0, 1000, "response", None)] * 2 + [(0, 1200, "revisit", 2), (1, 1200, "revisit", 2), (2, 1200, "response", None), (2, 1200, "response", None), (5, 0, "response", None), (6, 0, "response", None)]
    assert {r.payload_digest for r in out if r.page_id == 1} == {hashlib.sha1(big.encode()).hexdigest()}
    none = warc.write(warc.with_revisits(df.limit(0)), new_dir(spark, "c"))
    assert warc.read(warc.normalise_all(none, new_dir(spark, "w"))).count() == 0
