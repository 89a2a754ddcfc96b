import glob
import gzip
import hashlib
import zlib

import pytest

from tidepanel.llm import warc

PAGE = "<html>é" + "x" * 1200
ROWS = [
    (1, "http://a/", PAGE, "clash"),
    (2, "http://b/ x\r\ny", PAGE, None),
    (9, None, PAGE, "c"),
    (9, None, PAGE, "c"),
    (3, "u", None, "c"),
    (4, "u", "", "c"),
    (5, "u", "short\r\n\r\nContent-Length: 7\r\n\r\nWARC/1.1", "c"),
    (6, "u", "short\r\n\r\nContent-Length: 7\r\n\r\nWARC/1.1", "c"),
    (None, "u", PAGE, "c"),
    (7, "u", "\0\n" * 600_000, "c"),
]


def want(rows):
    out, last = [], {}
    for i, _, html, _ in rows:
        b = (html or "").encode()
        if i is not None and len(b) >= 1000:
            last[b] = max(last.get(b, i), i)
    for i, _, html, _ in rows:
        b = (html or "").encode()
        again = i is not None and len(b) >= 1000 and last[b] > i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last[b] if again else None))
    return sorted(out, key=str)


def test_round_trip_and_index(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, payload_digest string")
    warc.write_monolithic(warc.assign_types(pages.repartition(2)), f"{tmp_path}/whole", records=3)
    whole = glob.glob(f"{tmp_path}/whole/*.gz")
    assert len(whole) > 2
    for f in whole:
        one = zlib.decompressobj(31)
        one.decompress(open(f, "rb").read())
        assert one.eof and not one.unused_data
    warc.normalise(spark, f"{tmp_path}/whole", f"{tmp_path}/members")
    got = warc.read_back(spark, f"{tmp_path}/members").collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == want(ROWS)
    html = {i: h or "" for i, _, h, _ in ROWS}
    assert all(r.html == html[r.page_id] for r in got if r.record_type == "response")
    # each member opens through the index alone
    for f in glob.glob(f"{tmp_path}/members/kind=warc/*/*.txt"):
        content = open(f, "rb").read()
        archive = f.split("archive=")[1].split("/")[0]
        index = warc.read_index(spark, f"{tmp_path}/members").where(f"archive = '{archive}'").orderBy("offset").collect()
        parts = [gzip.decompress(content[r.offset : r.offset + r.length]) for r in index]
        assert b"".join(parts) == gzip.decompress(content)
        assert [warc.header_of(p)[0]["WARC-Record-ID"] for p in parts] == [r.record_id for r in index]
    assert warc.read_index(spark, f"{tmp_path}/members").count() == len(ROWS)


def test_truncated_archive_is_refused():
    z = gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")
    with pytest.raises(ValueError):
        list(warc.records_of(z))
    assert list(warc.records_of(b"")) == []


def test_no_rows(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
