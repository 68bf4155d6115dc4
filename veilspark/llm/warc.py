"""WARC archives of captures and their assembly into one nested row per capture.

Writing: every page becomes three records of one file, a request, a response (or a revisit, if a page with an equal
payload is the response) and a metadata record; request and metadata name the response in WARC-Concurrent-To. Spark's
text writer makes the files, with the four bytes that end a record as its line end, so any Hadoop store will do; a
file is one gzip member. Reading: whole files, cut by Content-Length; files of many gzip members are read as well.
Assembly: request and metadata records meet their response by joins on the concurrent-to identifiers, also through
another record of the capture that names the response.

Defined results: a null html is an empty payload; a null url has the target urn:page:<page_id>, or urn:page: if that
is null too; blanks and control characters of urls are percent-encoded in the archive. Pages repeat as they come,
each a capture of its own; of equal payloads from the same smallest page_id one is the response. A null page_id is a
response only if all equal payloads have none. Payloads under 100 bytes are responses. Extra columns are ignored.
Record ids come from row numbers of the scan, so `pages` must read the same on every pass, as files do.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import free, remove, settle, shared_dir

#: Smallest payload that is worth a revisit record.
REVISIT_BYTES = 100
#: Records of a file; with it a file stays small enough to be read whole.
RECORDS_PER_FILE = 3_000
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "record_id string, type string, concurrent_to array<string>, target_uri string, refers_to string, header_digest string, "
    "payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
)


def _id(kind: str, uid: Column) -> Column:
    """A record id from the capture's number."""
    h = F.md5(F.concat(F.lit(kind + "|"), uid.cast("string")).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column | str, record_id: Column, uri: Column, headers: list[Column], block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit("WARC-Date: 2024-01-01T00:00:00Z"), F.concat(F.lit("WARC-Target-URI: "), uri), *headers, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *head), F.lit(_END), block)


def _safe_uri(url: Column, page_id: Column) -> Column:
    coded = F.replace(F.replace(F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20")), F.lit("\t"), F.lit("%09"))
    return F.coalesce(coded, F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit(""))))


def decide(pages: DataFrame) -> DataFrame:
    """page_id, url, html ('' if null), uid, digest, n, and the capture it repeats (__to, null for responses)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.monotonically_increasing_id().alias("uid"))
    rows = rows.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "n": F.octet_length("html").cast("long")})
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "uid"))
    known = rows.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(first.alias("__to"), F.count("*").alias("__k")).where("__k > 1").drop("__k")
    joined = rows.join(known, "digest", "left")  # one row for each digest on the right: AQE splits a hot left side
    return joined.withColumn("__to", F.when(F.col("__to.uid") != F.col("uid"), F.col("__to")))


def records(pages: DataFrame) -> DataFrame:
    """Three records of each page, in the column `value`, without the bytes that end a record."""
    d = decide(pages)
    uid, uri = F.col("uid"), _safe_uri(F.col("url"), F.col("page_id"))
    target = _id("response", uid)
    to = F.concat(F.lit("WARC-Concurrent-To: "), target)
    is_revisit = F.col("__to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(_END))
    block = F.concat(http, F.when(is_revisit, F.lit("")).otherwise(F.col("html")))
    revisit = F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), _id("response", F.col("__to.uid")), F.lit("\r\nWARC-Profile: " + _PROFILE)))
    content = _record(F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")), target, uri, [F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")), revisit], block)
    request = _record("request", _id("request", uid), uri, [F.lit("Content-Type: application/http; msgtype=request"), to], F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1" + _END)))
    note = F.concat_ws("\r\n", F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.concat(F.lit("payload-bytes: "), F.col("n").cast("string")), F.lit(""))
    metadata = _record("metadata", _id("metadata", uid), uri, [F.lit("Content-Type: application/warc-fields"), to], note)
    return d.select(F.explode(F.array(request, content, metadata)).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    out = records(pages).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE)
    out.mode("overwrite").text(path)


def _inflate(data: bytes) -> bytes:
    if data[:2] != b"\x1f\x8b":
        return data
    return gzip.GzipFile(fileobj=io.BytesIO(data)).read()  # all members, without a copy of the rest for each


def parse(data: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (lower-case names) and block of every record of an archive's bytes."""
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers: dict[str, list[str]] = {}
        for line in lines:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(headers["content-length"][0])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def _row(headers: dict[str, list[str]], block: bytes, keep: bool) -> dict:
    one = lambda name: headers.get(name, [None])[0]
    kind, fields, payload = one("warc-type"), [], block
    if (one("content-type") or "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    elif (one("content-type") or "").startswith("application/warc-fields"):
        fields = [tuple(x.strip() for x in line.split(":", 1)) for line in block.decode("utf-8", "replace").split("\r\n") if ":" in line]
    return {
        "record_id": one("warc-record-id"), "type": kind, "concurrent_to": headers.get("warc-concurrent-to", []), "target_uri": one("warc-target-uri"), "refers_to": one("warc-refers-to"),
        "header_digest": (one("warc-payload-digest") or "").removeprefix("sha256:") or None, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(),
        "fields": fields, "payload": payload if keep else None,
    }


_ARROW = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()), ("refers_to", pa.string()), ("header_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives under path; the payload bytes only if asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def run(batches):
        for b in batches:
            for c in b.column("content"):
                held = []
                for headers, block in parse(_inflate(c.as_py())):
                    held.append(_row(headers, block, payloads))
                    if len(held) == 500:
                        yield pa.RecordBatch.from_pylist(held, _ARROW)
                        held = []
                yield pa.RecordBatch.from_pylist(held, _ARROW)

    return files.mapInArrow(run, RECORD)


def assemble(recs: DataFrame) -> DataFrame:
    """One nested row for each capture: its response (or revisit), the request and the metadata records.

    A record belongs to the response that it names, or to the one that a record which it names names. Records that
    reach no response are left out; several records of a kind are ordered by record id, the request is the first.
    """
    main = recs.where("type in ('response', 'revisit')").select(F.col("record_id").alias("main_id"), F.struct("record_id", "type", "target_uri", "refers_to", "header_digest", "payload_bytes", "payload_digest", "payload").alias("response"))
    other = recs.where("type in ('request', 'metadata')").select("record_id", "type", "target_uri", "fields", "payload", F.explode("concurrent_to").alias("named"))
    ids = main.select("main_id")
    direct = other.join(ids, F.col("named") == F.col("main_id"))
    # records that name another record than a response: one more hop through what that one names
    hop = other.join(ids, F.col("named") == F.col("main_id"), "left_anti")
    via = direct.select(F.col("record_id").alias("via"), F.col("main_id")).distinct()
    found = direct.unionByName(hop.join(via, F.col("named") == F.col("via")).drop("via")).dropDuplicates(["main_id", "record_id"])
    request = found.where("type = 'request'").groupBy("main_id").agg(F.min(F.struct("record_id", "target_uri", "payload")).alias("request"))
    metadata = found.where("type = 'metadata'").groupBy("main_id").agg(F.array_sort(F.collect_list(F.struct("record_id", F.map_entries("fields").alias("fields")))).alias("metadata"))
    return main.join(request, "main_id", "left").join(metadata, "main_id", "left")


def captures(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archives of all pages under path, reads and assembles them; without a path they are deleted once read."""
    spark, own = pages.sparkSession, path is None
    path = path or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    free(spark)  # the payloads that were shuffled to decide
    records = settle(read(spark, path))  # the archives are parsed once
    if own:
        remove(spark, path)
    return assemble(records)


def page_records(pages: DataFrame, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each capture, as the archives tell them."""
    note = F.map_from_entries(F.element_at("metadata", 1).getField("fields"))
    revisit = F.col("response.type") == "revisit"
    rows = captures(pages, path).select(
        "main_id",
        note["page-id"].cast("long").alias("page_id"),
        F.when(revisit, note["payload-bytes"].cast("long")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("response.header_digest")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(revisit, F.col("response.refers_to")).alias("named"),
        F.col("response.target_uri").alias("target_uri"),
        F.col("request.record_id").alias("request_id"),
    )
    rows = settle(rows)
    # a revisit names a response's record, whose page is told by that capture's metadata; AQE splits a response that many name
    responses = rows.where("record_type = 'response'").select(F.col("main_id").alias("named"), F.col("page_id").alias("refers_to"))
    wanted = rows.where("named is not null")
    met = wanted.join(responses, "named", "left")
    alone = rows.where("named is null").withColumn("refers_to", F.lit(None).cast("long"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "request_id"]
    return met.select(*columns).union(alone.select(*columns))


def compress_members(blobs: list[bytes]) -> bytes:
    """Records as gzip members of their own, as other writers make them."""
    return b"".join(map(gzip.compress, blobs))
