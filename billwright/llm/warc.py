"""WARC archives as chunked record tables.

A record is a run of rows (record_id, chunk_no, data, running): chunk 0 is the header block, the
following chunks are slices of the payload, each with the SHA-1 of all payload up to its end. The
data of a record's chunks, in order, is the record as it stands in a WARC file. Writer and reader
hold one chunk at a time beside the batch Spark hands over, so a record may be larger than a
task's memory share. Chunks are written idempotently: a repeated chunk of a record is the same row
and is read once.

Equal payloads of at least ``least`` bytes are stored once: the row with the largest page_id is the
response, the others revisit it. Defined cases: a null payload is empty; a null url leaves out the
target address; null page ids come last in the choice of the response; fully repeated rows give
one response and revisits of it (large payloads) or one response each (small ones); an empty table
gives an empty archive.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 16
LEAST = 1000
#: Revisited payloads up to this count go to every task as a broadcast list; more are joined by shuffle.
BROADCAST_ROWS = 100_000
ARCHIVE = "record_id string, chunk_no int, data binary, running string"
_CRLF = "\r\n"


def _record_id(*parts):
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _head(kind, http):
    """Header block of a record from the columns record_id, page_id, url, digest, bytes, refers_to."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    answer = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(_CRLF * 2))
    length = (F.octet_length(answer) + F.col("bytes")) if http else F.lit(0)
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{_CRLF}"), line("WARC-Type", F.lit(kind)), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        optional("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "")),
        optional("X-Page-Id", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        *([] if http else [line("WARC-Refers-To", F.col("refers_to"))]),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", length.cast("string")), F.lit(_CRLF), *([answer] if http else []),
    )


def records(pages, least=LEAST, broadcast_rows=BROADCAST_ROWS, settle=lambda df, name: df):
    """One row per page: record_id, head, and payload (null for revisits)."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumns(
        {"digest": F.sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload").cast("long")}
    )
    again = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
    small = base.where(F.col("bytes") < least).withColumn("_n", again("page_id", "url", "digest"))
    small = small.select("page_id", "url", "digest", "bytes", "payload", _record_id(*map(F.col, ("page_id", "url", "digest", "_n"))).alias("record_id"))

    large = base.where(F.col("bytes") >= least)
    plan = settle(large.drop("payload"), "warc-plan")
    shared = (
        plan.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("_rows"), F.max("page_id").alias("keeper")).where("_rows > 1")
    )
    shared = settle(shared, "warc-shared")
    near = F.broadcast(shared) if shared.count() <= broadcast_rows else shared
    first_id = _record_id(F.col("keeper"), F.col("digest"))
    response = large.join(near, ["digest", "bytes"], "left").where("_rows is null or page_id <=> keeper")
    response = response.select("page_id", "url", "digest", "bytes", "payload", _record_id(F.col("page_id"), F.col("digest")).alias("record_id"))
    # a row repeated with page and payload is written once; the others revisit it
    twice = settle(plan.groupBy("page_id", "digest").count().where("count > 1").select(_record_id(F.col("page_id"), F.col("digest")).alias("record_id")), "warc-twice")
    n = twice.count()
    if n:
        near_twice = F.broadcast(twice) if n <= broadcast_rows else twice
        once = response.join(near_twice, "record_id", "left_semi").dropDuplicates(["record_id"])
        response = response.join(near_twice, "record_id", "left_anti").unionByName(once)
    # one row of the response's own page stands for the response, further ones revisit it
    extra = plan.join(near, ["digest", "bytes"]).withColumn("_n", again("page_id", "digest"))
    revisit = extra.where("not page_id <=> keeper or _n > 1").select(
        "page_id", "url", "digest", "bytes", first_id.alias("refers_to"), _record_id(*map(F.col, ("page_id", "digest", "_n")), F.lit("revisit")).alias("record_id")
    )
    stored = response.unionByName(small)
    return stored.select("record_id", _head("response", True).alias("head"), "payload").unionByName(
        revisit.select("record_id", _head("revisit", False).alias("head"), F.lit(None).cast("string").alias("payload"))
    )


def chunked(record_rows, chunk_bytes=CHUNK_BYTES):
    """The chunk rows of records."""
    schema = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("running", pa.string())])

    def cut(batches):
        rows, held = [], 0
        for batch in batches:
            payloads = batch.column("payload")
            payloads = payloads.cast(pa.large_string()) if payloads.type != pa.large_string() else payloads
            for i, (key, head) in enumerate(zip(batch.column("record_id").to_pylist(), batch.column("head").to_pylist(), strict=True)):
                value = payloads[i]
                data = memoryview(value.as_buffer()) if value.is_valid else memoryview(b"")
                digest, end = hashlib.sha1(), b"\r\n\r\n"
                rows.append((key, 0, head.encode() + (b"" if len(data) else end), None))
                for n, at in enumerate(range(0, len(data), chunk_bytes), 1):
                    piece = data[at : at + chunk_bytes]
                    digest.update(piece)
                    rows.append((key, n, bytes(piece) + (end if at + chunk_bytes >= len(data) else b""), digest.hexdigest()))
                    held += len(piece)
                    if held >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                held += len(head)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return record_rows.mapInArrow(cut, ARCHIVE)


class _Open:
    """The record being read: its header fields, and digest and length of the payload so far."""

    def __init__(self, key, data):
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split(_CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"record {key} doesn't begin with a header block")
        self.key, self.at, self.running = key, 0, None
        self.fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        self.left, self.n, self.digest = int(self.fields["content-length"]), 0, hashlib.sha1()
        if self.left:
            answer, _, _ = rest.partition(b"\r\n\r\n")
            self.left -= len(answer) + 4

    def take(self, chunk_no, data, running):
        if chunk_no <= self.at:
            return
        piece = memoryview(data)[: self.left]
        self.digest.update(piece)
        self.left, self.n, self.at = self.left - len(piece), self.n + len(piece), chunk_no
        if running != self.digest.hexdigest():
            raise ValueError(f"record {self.key}: chunk {chunk_no} doesn't fit its running digest")

    def row(self):
        f = self.fields
        if self.left:
            raise ValueError(f"record {self.key} ends {self.left} bytes early")
        declared = f["warc-payload-digest"].removeprefix("sha1:")
        page = f.get("x-page-id")
        stored = f["warc-type"] == "response"
        if stored and declared != self.digest.hexdigest():
            raise ValueError(f"record {self.key}: payload doesn't fit its digest")
        return self.key, f["warc-type"], None if page is None else int(page), f.get("warc-target-uri"), self.n if stored else None, declared, f.get("warc-refers-to")


READ = "record_id string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_id string"


def read_records(archive):
    """Header fields, length and digest of every record of a chunk table, streamed chunk by chunk and verified."""
    types = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_id", pa.string())])
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)

    def stream(batches):
        now, rows = None, []
        for batch in batches:
            keys, numbers, running = (batch.column(c).to_pylist() for c in ("record_id", "chunk_no", "running"))
            data = batch.column("data")
            for i, key in enumerate(keys):
                if now is None or now.key != key:
                    if now is not None:
                        rows.append(now.row())
                    now = _Open(key, data[i].as_py())
                else:
                    now.take(numbers[i], data[i].as_buffer(), running[i])
            if len(rows) >= 5000:
                yield pack(rows)
                rows = []
        if now is not None:
            rows.append(now.row())
        if rows:
            yield pack(rows)

    return archive.repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(stream, READ)


def resolve(read):
    """Revisits take length and page of the response they refer to; digests must agree."""
    stored = read.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest")
    )
    agree = F.when(F.col("_digest").isNull() | (F.col("_digest") == F.col("payload_digest")), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a revisit and its response differ in digest")))
    return read.join(stored, "refers_id", "left").select(
        "page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), agree.alias("payload_digest"), "record_type", "refers_to"
    )
