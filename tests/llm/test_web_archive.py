import base64
import hashlib
import random

import pytest

from tabreg.llm import web_archive
from tabreg.llm.web_archive import arc_record, arc_start, archive_digests, convert_arc, parse_arc, parse_warc, read_warc, warc_record, write_arc


def test_arc_versions():
    body = b"HTTP/1.1 200 OK\r\n\r\n<p>\nhttp://x 1 2 3 4\n</p>"
    for version in (1, 2):
        whole = b"\n".join([arc_start(version, "a.arc"), arc_record(version, "http://e.x/", "20200102030405", body, 90, "a.arc"),
                            arc_record(version, "http://e.x/2", "20200102030405", b"", 190, "a.arc")]) + b"\n"
        got = list(parse_arc(whole + whole))
        assert [r["body"] for r in got] == [body, b""] * 2 and got[0]["URL"] == "http://e.x/" and got[0]["Archive-date"] == "20200102030405"
        assert ("Checksum" in got[0]) == (version == 2)
        with pytest.raises(ValueError):
            list(parse_arc(whole[:-20]))


def test_warc_blocks_by_length():
    payload = b"\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    record = warc_record("urn:uuid:1", 4, "http://e.x", "2020-01-01T00:00:00Z", "D", payload, len(payload), None, None)
    got = list(parse_warc(record + b"\r\n\r\n" + record + b"\r\n\r\n"))
    assert len(got) == 2 and got[0][1].endswith(payload) and got[0][0]["warc-type"] == "response"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(rows, least=0):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "")]
        revisit = len(data) >= least and i != max(same)
        out.append((i, len(data), digest(data), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(web_archive, "RUN_BYTES", 3000)
    rng = random.Random(13)
    rows = [(k, f"http://h{k % 3}.example.org/a b?x=é%20{k}", f"<p>{'x' * rng.randint(0, 400)}\r\n\r\n\nWARC/1.1\n{k % 40}é</p>") for k in range(120)]
    rows += [(200 + k, "http://c.example.org", "copy") for k in range(90)]
    rows += [(300, None, None), (301, "", ""), (302, "http://x", "\n"), (303, "-", "z" * 500_000), (304, "u", "a\x00b\r\n")]
    pages = spark.createDataFrame([(*r, "q", 1) for r in rows], "page_id long, url string, html string, digest string, `row` int").repartition(4)
    for least in (0, 10):
        got = sorted(tuple(r) for r in archive_digests(pages, least).collect())
        assert got == brute(rows, least)


def test_payloads_and_urls_come_back(spark, tmp_path):
    rows = [(1, "http://e.x/a b", "<p>é\r\n\r\n</p>"), (2, None, None), (3, "http://e.x/%20", "<p>é\r\n\r\n</p>"), (None, "u", "v"), (3, "again", "w")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    write_arc(pages, f"{tmp_path}/arc")
    convert_arc(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    got = read_warc(spark, f"{tmp_path}/warc").collect()
    assert sorted((r.page_id or 0, r.url or "") for r in got) == sorted((i or 0, u or "") for i, u, _ in rows)
    payload = {(r.page_id, r.url): r.payload for r in got}
    assert bytes(payload[(3, "http://e.x/%20")]).decode() == "<p>é\r\n\r\n</p>" and payload[(1, "http://e.x/a b")] is None
    assert archive_digests(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_urls_that_look_like_other_fields(spark):
    rows = [(1, "filedesc://x.arc", "<p>a</p>"), (2, "-", "<p>a</p>"), (3, "filedesc:", ""), (4, None, None), (5, "%", "b"), (6, "", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {r.page_id: r for r in archive_digests(pages).collect()}
    assert {k: r.payload_bytes for k, r in got.items()} == {k: len((h or "").encode()) for k, _, h in rows}
    assert got[1].record_type == "revisit" and got[1].refers_to == 2
    assert {k: r.url for k, r in got.items() if "url" in r} in ({}, {k: u for k, u, _ in rows})
