"""WARC archives with revisit records: payloads that repeat are stored once.

Record headers are shuffled by payload digest; the record with the smallest key keeps its payload as a response and
the others become revisit records that refer to it, all under fresh headers. Reading joins revisits back to
their responses. Archives are gzip files with a member per record, bounded in size.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, partition_id, shared_dir, write_file, written

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "framewright:warc")

MANIFEST = "file string, records long, bytes long"
RECORDS = "record_id string, key long, type string, uri string, payload_bytes long, payload_digest string, refers_to_id string"


def record_id(key, uri, digest) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{key} {digest} {uri}')}>"


def _line(text) -> str:
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in text)  # a header field is one line


def build_record(key, uri, payload: bytes, digest: str, date: str, original: tuple | None = None) -> bytes:
    """A response record, or a revisit of ``original`` (key, uri): the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if original else "response"), ("WARC-Record-ID", record_id(key, uri, digest)), ("WARC-Date", date)]
    if uri is not None:
        fields.append(("WARC-Target-URI", _line(uri)))
    if key is not None:
        fields.append(("Framewright-Key", str(key)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if original:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*original, digest))]
        if original[1] is not None:
            fields.append(("WARC-Refers-To-Target-URI", _line(original[1])))
    block = http if original else http + payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n"


def pack_member(record: bytes, level: int = 6) -> bytes:
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(record) + press.flush()


_STEP = 1 << 14  # bytes of an archive that are opened at once


def read_records(blob: bytes):
    """(header fields, block) of each record of an archive; ValueError if it is damaged or cut short."""
    view, at = memoryview(blob), 0
    while at < len(view):
        opened, parts = zlib.decompressobj(31), []
        while not opened.eof:  # in steps, so that what follows a record isn't copied for each
            if at >= len(view):
                raise ValueError("archive cut short")
            step = view[at : at + _STEP]
            try:
                parts.append(opened.decompress(step))
            except zlib.error as e:
                raise ValueError(f"damaged archive: {e}") from e
            at += len(step) - len(opened.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        size = int(fields["Content-Length"])
        if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
            raise ValueError("record length is wrong")
        yield fields, rest[:size]


def write_archives(
    records: DataFrame, folder: str, *, key: str, uri: str, payload: str, least_bytes: int = 100, date: str | None = None, file_bytes: int = 8 << 20,
) -> DataFrame:
    """Write a record per row and return the manifest. ``payload`` is text (as UTF-8) or binary; null is empty.

    Of the rows with equal payloads of at least ``least_bytes``, that with the smallest key is written in full and
    the others as revisits; rows that repeat that key are written in full too. Smaller payloads are always written in
    full, so the most common (the empty one) is no key of a join. A null key never is the original where
    another has a key; if none has one, all are in full. Rows that are equal in all three columns are a record each. Very long payloads are
    one record. An empty table writes no archive. Other columns are ignored, whatever their names.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = records.select(F.col(key).cast("long").alias("key"), F.col(uri).cast("string").alias("uri"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # Headers alone are shuffled by digest; payloads only meet the revisits found among them.
    heads = rows.where(F.octet_length("payload") >= least_bytes).select("key", "uri", "digest")
    # Written, so that the join is of two shuffles and a digest that many records share can be split.
    first = heads.groupBy("digest").agg(F.min(F.when(F.col("key").isNotNull(), F.struct("key", "uri"))).alias("first"), F.count(F.lit(1)).alias("n"))
    first = written(first.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "warc-repeated-digests")
    revisits = heads.join(first, "digest").where(~F.col("key").eqNullSafe(F.col("first.key"))).select(*[F.col(c).alias(f"r_{c}") for c in ("key", "uri", "digest")], "first").distinct()
    same = F.col("key").eqNullSafe(F.col("r_key")) & F.col("uri").eqNullSafe(F.col("r_uri")) & F.col("digest").eqNullSafe(F.col("r_digest"))
    found = rows.join(revisits, same, "left").select("key", "uri", "payload", "digest", "first")

    def write(iterator):
        part, seq, members, held = partition_id(), 0, [], 0

        def flush():
            nonlocal seq, members, held
            name = f"part-{part:06d}-{seq:04d}.warc.gz"
            write_file(f"{folder}/{name}", b"".join(members))
            row = [name, len(members), held]
            seq, members, held = seq + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([row[1]]), pa.array([row[2]])], names=["file", "records", "bytes"])

        for batch in batches(iterator, "payload"):
            for k, u, p, d, f in zip(*(c.to_pylist() for c in batch.columns)):
                member = pack_member(build_record(k, u, p, d, date, (f["key"], f["uri"]) if f else None))
                if held and held + len(member) > file_bytes:
                    yield flush()
                members.append(member)
                held += len(member)
        if members:
            yield flush()

    # Ordered by content, so that a task that runs again writes the same files.
    return written(found.sortWithinPartitions("key", "uri", "digest").mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(spark, folder: str) -> DataFrame:
    """A row per record of the archives in ``folder``, headers and payload facts; responses' digests are computed anew."""

    def read(iterator):
        for batch in iterator:
            rows = []
            for blob in batch.column(0):
                for fields, block in read_records(blob.as_py()):
                    number = fields.get("Framewright-Key")
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = None
                    if fields["WARC-Type"] == "response":
                        body = block.partition(b"\r\n\r\n")[2]
                        size, own = len(body), hashlib.sha256(body).hexdigest()
                        if own != digest:
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                    rows.append((fields["WARC-Record-ID"], int(number) if number is not None else None, fields["WARC-Type"], fields.get("WARC-Target-URI"), size, digest, fields.get("WARC-Refers-To")))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["record_id", "key", "type", "uri", "payload_bytes", "payload_digest", "refers_to_id"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content").mapInArrow(read, RECORDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Revisit records get their response's payload size, digest and key (``refers_to``); responses stay.

    A revisit whose response isn't in the archives keeps its own digest and has a null size and ``refers_to``.
    """
    responses = records.where("type = 'response'")
    target = responses.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("key").alias("refers_to"), F.min("payload_bytes").alias("size"), F.min("payload_digest").alias("own"))
    target = written(target, "warc-responses")  # one response may be what most revisits refer to
    revisits = records.where("type = 'revisit'").drop("payload_bytes").join(target, "refers_to_id", "left")
    revisits = revisits.select("key", "uri", "type", F.col("size").alias("payload_bytes"), F.coalesce("own", "payload_digest").alias("payload_digest"), "refers_to")
    return responses.select("key", "uri", "type", "payload_bytes", "payload_digest", F.lit(None).cast("long").alias("refers_to")).union(revisits)


def op5_warc_revisits(spark, sf_dir: str) -> DataFrame:
    """All pages as archives, written and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = shared_dir(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_archives(pages, folder, key="page_id", uri="url", payload="html")
    records = written(read_archives(spark, folder), "warc-records")
    return resolve_revisits(records).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
