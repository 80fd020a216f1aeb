"""WARC archives: writing with segments and revisits, reading with reassembly.

Archives are written by Spark's own text writer, one record a row, with a record's closing CRLF CRLF as the line
separator: the files are plain WARC on any file system that Spark reaches. Reading parses whole files by
Content-Length; only records that were segmented are shuffled, by the id of the record they continue.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import reach_workers, read, scratch, table

SPACE = uuid.UUID("7b0d4f3e-58f1-5c0e-9a7b-2f64a1d0c3aa")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = 8192) -> bytes:
    """The payload in HTTP chunked transfer framing."""
    parts = []
    for k in range(0, len(payload), size):
        some = payload[k : k + size]
        parts += [b"%x\r\n" % len(some), some, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload back from its framing; chunk extensions and trailers are passed over. ValueError if cut off."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(parts)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        parts.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(block: bytes, **fields) -> bytes:
    """A record without its closing CRLF CRLF."""
    lines = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def record_id(page_id, digest: str, nth: int = 0, kind: str = "") -> str:
    """nth tells rows apart that repeat a page_id and payload; only those after the first carry it."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}{page_id}/{digest}' + (f'/repeat/{nth}' if nth else ''))}>"


def records(page_id, url: str | None, payload: bytes, first_id, segment_bytes: int, nth: int = 0) -> list[bytes]:
    """The records of a page: a revisit if first_id (the page whose payload is the same) is given, else a response,
    cut into a first segment and continuations where its block is longer than segment_bytes."""
    digest = base32_sha1(payload)
    own = record_id(page_id, digest, nth, "" if first_id is None else "revisit/")
    base = {"WARC_Record_ID": own, "WARC_Date": DATE, "WARC_Target_URI": (url or "").replace("\r", "%0D").replace("\n", "%0A") or None, "WARC_Payload_Digest": f"sha1:{digest}", "X_Page_ID": page_id, "Content_Type": "application/http; msgtype=response"}
    if first_id is not None:
        return [record(HTTP, WARC_Type="revisit", WARC_Profile=PROFILE, WARC_Refers_To=record_id(first_id, digest), **base)]
    block = HTTP + chunked(payload)
    if len(block) <= segment_bytes:
        return [record(block, WARC_Type="response", **base)]
    out = [record(block[:segment_bytes], WARC_Type="response", WARC_Segment_Number=1, **base)]
    for n, k in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        last = len(block) if k + segment_bytes >= len(block) else None
        part = f"<urn:uuid:{uuid.uuid5(SPACE, f'{own}/{n}')}>"
        out.append(record(block[k : k + segment_bytes], WARC_Type="continuation", WARC_Record_ID=part, WARC_Date=DATE, WARC_Segment_Origin_ID=own, WARC_Segment_Number=n, WARC_Segment_Total_Length=last))
    return out


def parse(data: bytes):
    """(fields by lower-case name, block) of each record of an archive. ValueError where it is cut off."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            if not data[at:].strip():
                return
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
        start = end + 4
        at = start + int(fields["content-length"])
        if at > len(data):
            raise ValueError("record cut off")
        yield fields, data[start:at]
        at += 4


def write(pages: DataFrame, path: str, segment_bytes: int = 32768, least: int = 0, per_file: int = 5000) -> None:
    """Write a record for each row of pages (page_id, url, html). Of rows with equal payloads of at least ``least``
    bytes the smallest page_id becomes a response and the others revisits. Null html is an empty payload. Rows that
    repeat a page_id (or null) and html are numbered in their record ids; only such rows are shuffled."""
    reach_workers(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("same", F.when(F.octet_length("payload") >= least, F.sha1("payload")))
    first = rows.filter(F.col("same").isNotNull()).groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("same", "first")
    # payloads stay where they are read: only ids and digests meet, and the answer comes back by page_id and digest
    dup = rows.select("page_id", "same").join(first, "same").filter("page_id > first").select("page_id", "same", "first").distinct()
    few = dup.count() <= 1_000_000
    rows = rows.join(F.broadcast(dup) if few else dup, ["page_id", "same"], "left").select("page_id", "url", "payload", "first")
    digest = F.sha1("payload")
    twice = table(rows.groupBy("page_id", digest.alias("digest")).count().filter("count > 1").select(F.col("page_id").alias("id"), "digest"), "twice")
    n_twice = twice.count()
    if n_twice:
        twice = F.broadcast(twice) if n_twice <= 1_000_000 else twice
        same = F.col("page_id").eqNullSafe(F.col("id")) & (digest == F.col("digest"))
        nth = F.row_number().over(Window.partitionBy("page_id", digest).orderBy("url")) - 1
        rows = rows.join(twice, same, "left_anti").withColumn("nth", F.lit(0)).unionByName(rows.join(twice, same, "left_semi").withColumn("nth", nth))
    else:
        rows = rows.withColumn("nth", F.lit(0))

    def run(batches):
        for b in batches:
            out: list[bytes] = []
            for p, u, x, f, nth in zip(*(c.to_pylist() for c in b.columns)):
                out += records(p, u, x, f, segment_bytes, nth)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path)


FIELDS = "record_id string, record_type string, page_id long, uri string, digest string, refers_to string, number int, total long, block binary, payload_bytes long, ok boolean"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under path (FIELDS), segments put together again.

    A segmented record's parts are grouped by the id of its first and ordered by number; ok says that no part is
    missing, that the length is the one its last part states, and that the payload has the digest in its header.
    Copies of a part count once. Blocks are not returned; a group is never larger than one record.
    """
    reach_workers(spark)

    def told(block: bytes, digest: str | None) -> tuple[int | None, bool]:
        try:
            payload = payload_of(block)
        except ValueError:
            return None, False
        return len(payload), digest in (None, base32_sha1(payload))

    def run(batches):
        for b in batches:
            for data in b.column(0):
                out = []
                for f, block in parse(data.as_py()):
                    kind = f["warc-type"]
                    number = int(f["warc-segment-number"]) if "warc-segment-number" in f else None
                    digest = f["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in f else None
                    n, ok = told(block, digest) if kind == "response" and number is None else (None, True)
                    page = f.get("x-page-id", "")
                    total = f.get("warc-segment-total-length")
                    own = f["warc-segment-origin-id"] if kind == "continuation" else f["warc-record-id"]
                    out.append((own, kind, int(page) if page.lstrip("-").isdigit() else None, f.get("warc-target-uri"), digest, f.get("warc-refers-to"), number, int(total) if total else None, block if number else None, n, ok))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], NAMES) if out else pa.RecordBatch.from_arrays([pa.array([], t) for t in TYPES], NAMES)

    def join(batches):
        for b in batches:
            got = [(told(block, d) if whole else (None, False)) for block, d, whole in zip(b.column("block").to_pylist(), b.column("digest").to_pylist(), b.column("whole").to_pylist())]
            keep = [b.column(n) for n in NAMES[:8]] + [pa.nulls(len(got), pa.binary())]
            yield pa.RecordBatch.from_arrays([*keep, pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.bool_())], NAMES)

    parsed = table(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, FIELDS), "records")
    part = F.array_sort(F.collect_set(F.struct("number", "block")))
    head = lambda c: F.max(F.when(F.col("number") == 1, F.col(c))).alias(c)
    groups = parsed.filter("number IS NOT NULL").groupBy("record_id").agg(*map(head, ("record_type", "page_id", "uri", "digest", "refers_to")), F.max("total").alias("total"), part.alias("parts"))
    groups = groups.withColumn("block", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["block"])))
    whole = (F.element_at("parts", -1)["number"] == F.size("parts")) & (F.col("total") == F.octet_length("block")) & F.col("record_type").isNotNull()
    groups = groups.select("record_id", "record_type", "page_id", "uri", "digest", "refers_to", F.lit(None).cast("int").alias("number"), "total", "block", F.coalesce(whole, F.lit(False)).alias("whole"))
    return parsed.filter("number IS NULL").unionByName(groups.mapInArrow(join, FIELDS))


NAMES = [x.split()[0] for x in FIELDS.split(", ")]
TYPES = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[x.split()[1]] for x in FIELDS.split(", ")]


def captures(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (the response's page_id) and ok of each page;
    a revisit takes its length from the response it refers to. Copies of a record count once."""
    rows = records.dropDuplicates(["record_type", "record_id"])
    found = rows.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("to_bytes"), F.col("ok").alias("to_ok"))
    again = rows.filter("record_type = 'revisit'").select("page_id", "digest", "refers_to").join(found, "refers_to", "left")
    out = rows.filter("record_type = 'response'").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), "ok")
    return out.unionByName(again.select("page_id", F.col("to_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("to_page").alias("refers_to"), F.coalesce("to_ok", F.lit(False)).alias("ok")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null html is an empty payload; ties on page_id and null page_ids are one row each, whatever their html;
    further columns of pages are ignored; an empty table gives an empty result."""
    path = scratch(spark, "warc")
    write(read(spark, sf_dir, "pages"), path)
    return captures(read_records(spark, path))
