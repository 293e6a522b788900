import hashlib

import pytest

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string"


def round_trip(spark, rows, folder, **options):
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), str(folder), **options)
    return {r["page_id"]: r for r in warc.read_headers(spark, str(folder)).collect()}


def test_revisits(spark, tmp_path):
    big, other = "é" * 500, "x" * 1000
    rows = [(1, "http://a/", big), (2, "http://b/", big), (7, "http://c/", big), (3, None, other), (4, "u", "x" * 999), (5, "u", "x" * 999)]
    rows += [(8, "http://h/", None), (9, "a\r\nb", ""), (10, "u", "x\r\n\r\nWARC/1.1\r\n\r\n" * 99), (11, "u", "\r\n\r\n" * 400)]
    got = round_trip(spark, rows, tmp_path / "w")
    for id, _, html in rows:
        data = (html or "").encode()
        same = [i for i, _, h in rows if h == html and len(data) >= 1000]
        owner = max(same) if same and max(same) != id else None
        r = got[id]
        assert (r["payload_bytes"], r["payload_digest"], r["refers_to"]) == (len(data), hashlib.sha1(data).hexdigest(), owner)
        assert r["record_type"] == ("revisit" if owner else "response")
    bodies = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert bodies == {i: "" if got[i]["refers_to"] else (h or "") for i, _, h in rows}


def test_archives_are_plain_warc_files(spark, tmp_path):
    round_trip(spark, [(1, "http://a/", "x" * 2000), (2, "http://b/", "x" * 2000)], tmp_path / "w")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    assert data.count(b"WARC/1.1\r\n") == 2 and data.endswith(b"\r\n\r\n")
    assert b"WARC-Type: revisit" in data and b"WARC-Refers-To: <urn:page:2>" in data and b"Content-Length: 0" in data
    assert len(list(warc.parse(data))) == 2


def test_damage_is_found(spark, tmp_path):
    round_trip(spark, [(1, "http://a/", "x" * 50)], tmp_path / "w")
    data = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    with pytest.raises(ValueError, match="damaged"):
        list(warc.parse(data.replace(b"xxxx", b"xxyx", 1)))
    with pytest.raises(ValueError):
        list(warc.parse(data[:-1]))


def test_null_ids_repeats_and_empty(spark, tmp_path):
    big = "z" * 1500
    warc.write_archives(spark.createDataFrame([(None, "u", big), (None, "u", big), (4, "u", big), (4, "u", big), (2, "u", big)], SCHEMA), str(tmp_path / "w"))
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, str(tmp_path / "w")).collect())
    assert kinds == [("2", "revisit", 4), ("4", "response", None), ("4", "response", None), ("None", "response", None), ("None", "response", None)]
    assert round_trip(spark, [], tmp_path / "e") == {}


def test_headers_of_repeated_ids(spark, tmp_path):
    big, other = "z" * 1500, "y" * 1700
    rows = [(None, "u", big), (4, "u", big), (4, "u", big), (2, "u", big), (4, "u", other), (3, "u", other)]
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "w"))
    heads = sorted((r["page_id"] or -1, r["record_type"], r["payload_bytes"]) for r in warc.read_headers(spark, str(tmp_path / "w")).collect())
    assert heads == [(-1, "response", 1500), (2, "revisit", 1500), (3, "revisit", 1700), (4, "response", 1500), (4, "response", 1500), (4, "response", 1700)]


def test_long_payload_and_small_files(spark, tmp_path):
    rows = [(i, "u", str(i) * 3000) for i in range(1, 60)] + [(100, "u", "y" * 20_000_000)]
    got = round_trip(spark, rows, tmp_path / "w", per_file=7)
    assert len(got) == 60 and got[100]["payload_bytes"] == 20_000_000
