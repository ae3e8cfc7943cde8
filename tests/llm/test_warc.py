import gzip
import hashlib

from pyspark.sql import functions as F

from hopledger.llm.warc import captures, pages_through_archives, read_records, records, write_archives

BODY = "<p>the same long body</p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 3
ROWS = [
    (1, "http://a.example/1", BODY), (2, "http://a.example/2", BODY), (3, "http://b.example/é", BODY), (4, "http://b.example/", "short"),
    (5, "http://b.example/x", "short"), (6, None, None), (7, "http://c.example", ""), (8, "http://d", "é" * 60), (8, "http://d", "é" * 60),
    (None, "http://e", BODY), (9, "not a url", "x" * 300_000), (10, "http://f", "\U0001f600" * 25), (11, "http://f", "\U0001f600" * 25),
]


def pages(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return df.select("*", *(F.lit("x").alias(c) for c in ("digest", "payload", "bytes", "first", "type", "capture")))


def test_round_trip_against_brute_force(spark):
    found = sorted((tuple(r) for r in pages_through_archives(pages(spark)).collect()), key=str)
    expected = []
    for page, url, html in ROWS:
        data = (html or "").encode()
        same = [p for p, _, h in ROWS if (h or "").encode() == data and p is not None]
        first = min(same, default=None) if len(data) >= 100 else None
        later = first is not None and first != page
        expected.append((page, url, len(data), hashlib.sha256(data).hexdigest(), "revisit" if later else "response", first if later else None))
    assert found == sorted(expected, key=str)


def test_archives_hold_three_records_a_capture(spark, tmp_path):
    path = f"{tmp_path}/warc"
    write_archives(pages(spark), path, records_per_file=2)
    files = sorted((tmp_path / "warc").glob("part-*"))
    assert len(files) >= len(ROWS) // 2
    kinds = {}
    for file in files:
        data = gzip.decompress(file.read_bytes())
        for headers, block in records(data):
            assert len(block) == int(headers["content-length"])
            kinds[headers["warc-type"]] = kinds.get(headers["warc-type"], 0) + 1
        assert sum(1 for _ in records(gzip.compress(data[:900]) + gzip.compress(data[900:]))) == sum(1 for _ in records(data))
    assert kinds["request"] == kinds["metadata"] == kinds["response"] + kinds["revisit"] == len(ROWS)
    whole = captures(read_records(spark, path)).collect()
    assert len(whole) == len(ROWS) and all(r.request and r.response and r.metadata for r in whole)


def test_missing_records_are_null(spark, tmp_path):
    path = f"{tmp_path}/warc"
    write_archives(pages(spark, ROWS[:3]), path)
    found = captures(read_records(spark, path).filter("type <> 'request'")).collect()
    assert len(found) == 3 and all(r.request is None and r.response is not None for r in found)


def test_empty(spark):
    assert pages_through_archives(pages(spark).limit(0)).count() == 0
