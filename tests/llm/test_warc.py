import gzip
import hashlib

from veilspark.llm import warc

SCHEMA = "page_id long, url string, html string"


def test_pages(spark, tmp_path):
    long = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 40 + "</p>"
    rows = [(5, "http://a/ b", long), (3, "http://c", long), (9, None, long), (1, "u", "short"), (2, "u", "short"), (4, "x\ny", None), (6, "z", ""), (3, "http://c", long), (None, None, long), (8, "big", "x" * 300_000)]
    got = sorted((r[:5] for r in warc.page_records(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as uid", "2 as n"), str(tmp_path / "w")).collect()), key=repr)
    want = []
    first = True
    for i, _, h in rows:
        b = (h or "").encode()
        repeat = h == long and not (i == 3 and first)
        first = first and not (i == 3)
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if repeat else "response", 3 if repeat else None))
    assert got == sorted(want, key=repr)


def test_nested_rows_have_all_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "x" * 200), (2, "http://b", "x" * 200)], SCHEMA)
    rows = warc.captures(pages, str(tmp_path / "w")).collect()
    assert len(rows) == 2 and all(r["request"]["record_id"] and len(r["metadata"]) == 1 for r in rows)
    full = warc.read(spark, str(tmp_path / "w"), payloads=True).where("type = 'response'").first()
    assert bytes(full["payload"]) == b"x" * 200
    revisit = next(r for r in rows if r["response"]["type"] == "revisit")
    assert revisit["response"]["refers_to"] == next(r["response"]["record_id"] for r in rows if r["response"]["type"] == "response")


def test_concurrent_through_another_record(spark):
    rows = [("r", "response", [], None), ("q", "request", ["r"], None), ("m", "metadata", ["q"], [("k", "v")]), ("lost", "metadata", ["nowhere"], None)]
    recs = spark.createDataFrame([(a, b, c, "u", None, None, 0, "d", dict(f or []), None) for a, b, c, f in rows], warc.RECORD)
    (got,) = warc.assemble(recs).collect()
    assert got["request"]["record_id"] == "q" and [m["record_id"] for m in got["metadata"]] == ["m"]


def test_members_are_read(spark, tmp_path):
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nContent-Type: application/http\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n"
    (tmp_path / "a.gz").write_bytes(warc.compress_members([one % 1, one % 2]))
    got = warc.read(spark, str(tmp_path), payloads=True).collect()
    assert [bytes(r["payload"]) for r in got] == [b"body"] * 2
    assert gzip.decompress((tmp_path / "a.gz").read_bytes()).count(b"WARC/1.0") == 2


def test_empty(spark, tmp_path):
    assert warc.page_records(spark.createDataFrame([], SCHEMA), str(tmp_path / "w")).count() == 0
