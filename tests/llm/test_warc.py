import gzip
import hashlib

from fleetlens.llm.queries import QUERIES
from fleetlens.llm.storage import shared_folder
from fleetlens.llm.warc import read_warc, write_warc

LARGE = "<p>ü" + "x" * 2000


def _pages(spark):
    rows = [
        (5, "http://a/b c\r\nX: y", LARGE, "d"), (3, "http://a/1", LARGE, "d"), (9, None, LARGE, "d"), (9, None, LARGE, "d"),
        (1, "http://a/2", "small", "d"), (2, "http://a/2", "small", "d"), (4, "é", None, "d"), (6, "", "", "d"),
        (None, "http://none", LARGE, "d"), (7, "http://a/7", "WARC/1.1\r\n\r\n" * 3000, "d"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def _want():
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    out = []
    seen_nine = False
    for p in _ROWS:
        page, html = p
        target = 9 if html == LARGE else None
        first = page == 9 and not seen_nine
        seen_nine |= page == 9
        revisit = target is not None and not first
        out.append((page, len((html or "").encode()), sha(html), "revisit" if revisit else "response", target if revisit else None))
    return sorted(out, key=repr)


_ROWS = [(5, LARGE), (3, LARGE), (9, LARGE), (9, LARGE), (1, "small"), (2, "small"), (4, None), (6, ""), (None, LARGE), (7, "WARC/1.1\r\n\r\n" * 3000)]
COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_round_trip_of_awkward_pages(spark):
    for sizes in ({}, {"shard_bytes": 3000, "roll_bytes": 200}):
        path = shared_folder(spark, "test-warc")
        manifest = write_warc(_pages(spark), path, **sizes).collect()
        rows = read_warc(spark, path).collect()
        assert sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=repr) == _want()
        assert all(r["digest_ok"] for r in rows if r["record_type"] == "response")
        assert sum(m["records"] for m in manifest) == len(rows)
        for m in manifest:
            data = open(f"{path}/{m['file']}".removeprefix("file://"), "rb").read()
            assert hashlib.sha1(data).hexdigest() == m["sha1"] and len(data) == m["bytes"]
            assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")


def test_same_rows_give_the_same_files(spark):
    found = []
    for order in ("page_id", "url"):
        path = shared_folder(spark, "test-warc")
        found.append(sorted(map(tuple, write_warc(_pages(spark).orderBy(order), path, shard_bytes=3000).collect())))
    assert found[0] == found[1]


def test_only_committed_files_are_read(spark):
    path = shared_folder(spark, "test-warc")
    write_warc(_pages(spark), path)
    with open(f"{path}/_writing-left-over".removeprefix("file://"), "wb") as out:
        out.write(b"half a record")
    assert read_warc(spark, path).count() == len(_ROWS)


def test_empty_table(spark):
    path = shared_folder(spark, "test-warc")
    assert write_warc(_pages(spark).limit(0), path).count() == 0
    assert read_warc(spark, path).count() == 0


def test_query_reads_back_every_page(spark, sf):
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op8_warc"](spark, sf).collect()
    assert {r["page_id"]: r["payload_digest"] for r in rows} == {
        k: hashlib.sha1(v.encode()).hexdigest() for k, v in pages.items()
    }
