"""WARC archives through a chunked record table.

A page's payload becomes rows (record, chunk number, bytes) of at most `CHUNK` bytes, cut in the JVM. The writer
streams them, in order, as WARC/1.1 records: one chunk is a response record, several are a segmented one (the standard's
continuation records), with the digest of each block and a running digest of the payload, checked at its last chunk. The reader
streams segments back the same way and checks both digests, so neither ever holds a whole oversized payload.

Files go through Spark's text writer and reader, which any store serves, with the records' own end as line separator: a row is a
record. Where a payload holds the bytes that begin the next record, the writer cuts a segment inside them, so they are never met when reading.
Gzip files are read by one task each, in order; of others, which Spark may split inside a record, segments are brought together first.

Of records with equal payloads of at least MIN_REVISIT bytes, that with the largest page_id is written whole, the others as revisits.

Defined results: a null html is an empty payload; a row without a page_id is never the response that others refer to, if any row of
its payload has one; equal rows (page_id and payload) are judged alike, each; an empty table gives an empty archive and result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import common

CHUNK, MIN_REVISIT = 1 << 16, 1000
END, NEXT = "\r\n\r\n", "\r\n\r\nWARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def chunk_table(pages: DataFrame, chunk: int = CHUNK, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, digest, size, refers_to, chunk, last, data): the rows of a record stand together, in order."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    names = rows.select("page_id", "digest", "size").where(F.col("size") >= min_revisit)
    keepers = names.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"))
    # narrow rows only: payloads never meet on a digest, which a third of all pages may share
    revisits = names.distinct().join(keepers, ["digest", "size"]).where(F.col("refers_to").isNotNull() & ~F.col("refers_to").eqNullSafe(F.col("page_id")))
    revisits = revisits.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    rows = rows.join(revisits, (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_id")), "left")
    rows = rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")))
    count = F.greatest(F.ceil(F.octet_length("payload") / chunk), F.lit(1)).cast("int")
    rows = rows.withColumn("chunks", count).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.select(
        "page_id", "url", "digest", "size", "refers_to", "chunk", (F.col("chunk") + 1 == F.col("chunks")).alias("last"),
        F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("data"),
    )


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest[:12]}>"


def page_of(name: str | None) -> int | None:
    part = (name or "<urn:page:none").split(":")[2].rstrip(">")
    return None if part == "none" else int(part)


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def segments(data: bytes) -> Iterator[bytes]:
    """data cut so that no piece holds the bytes that begin a record."""
    mark = NEXT.encode()
    while (at := data.find(mark)) >= 0:
        yield data[: at + len(END) + 2]
        data = data[at + len(END) + 2 :]
    yield data


def record(fields: dict[str, object], block: bytes) -> bytes:
    head = {**fields, "WARC-Block-Digest": base32(hashlib.sha1(block).digest()), "Content-Length": len(block)}
    return ("WARC/1.1\r\n" + "\r\n".join(f"{k}: {v}" for k, v in head.items()) + END).encode() + block


def to_records(rows) -> Iterator[bytes]:
    """Chunk rows (page_id, url, digest, size, refers_to, chunk, last, data) as WARC records, without their ends."""
    running, done, number = None, 0, 0
    for page, url, digest, size, refers, chunk, last, data in rows:
        own = {"WARC-Record-ID": record_id(page, digest), "WARC-Date": DATE, "WARC-Payload-Digest": base32(bytes.fromhex(digest)), "X-Payload-Length": size}
        if url is not None:
            own["WARC-Target-URI"] = quote(url, safe="/:?#[]@!$&'()*+,;=%~")
        if refers is not None:
            yield record({"WARC-Type": "revisit", **own, "WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers, digest)}, b"")
            continue
        if not chunk:
            running, done, number = hashlib.sha1(), 0, 0
        running.update(data)
        done += len(data)
        pieces = list(segments(data))
        for k, piece in enumerate(pieces):
            final = last and k + 1 == len(pieces)
            number += 1
            if final and (running.hexdigest() != digest or done != size):
                raise ValueError(f"payload of page {page} does not have its digest")
            if number == 1:
                part = {} if final else {"WARC-Segment-Number": 1}
                yield record({"WARC-Type": "response", **own, **part, "Content-Type": "application/http; msgtype=response"}, HTTP + piece)
            else:
                fields = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:page:segment:{own['WARC-Record-ID'][10:-1]}:{number}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": own["WARC-Record-ID"], "WARC-Segment-Number": number}
                if final:
                    fields["WARC-Segment-Total-Length"] = size + len(HTTP)
                yield record(fields, piece)


def write_archive(pages: DataFrame, path: str, chunk: int = CHUNK, min_revisit: int = MIN_REVISIT) -> None:
    """A folder of .warc-format gzip files."""

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        held, size = [], 0
        for x in to_records(rows()):
            held.append(x)
            size += len(x)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])

    out = common.arrow(chunk_table(pages, chunk, min_revisit), run, "record binary")
    out.select(F.col("record").cast("string")).write.option("compression", "gzip").option("lineSep", END).text(path)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record, whatever ends it."""
    head, _, block = raw.partition(END.encode())
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n") if ": " in x)
    fields = {k.lower(): v for k, v in fields.items()}
    block = block[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
    if (want := fields.get("warc-block-digest")) and base32(hashlib.sha1(block).digest()) != want:
        raise ValueError(f"block of {fields.get('warc-record-id')} does not have its digest")
    return fields, block


class Reader:
    """Segments in order to results."""

    def __init__(self):
        self.open = None

    def feed(self, raw: bytes):
        fields, block = parse(raw)
        kind = fields["warc-type"]
        if kind == "revisit":
            digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
            return page_of(fields["warc-record-id"]), int(fields["x-payload-length"]), digest, kind, page_of(fields["warc-refers-to"])
        if kind == "response":
            block = block.partition(END.encode())[2]
            self.open, self.digest, self.size, self.next = fields, hashlib.sha1(), 0, 2
        elif kind == "continuation":
            if not self.open or self.open["warc-record-id"] != fields["warc-segment-origin-id"] or int(fields["warc-segment-number"]) != self.next:
                raise ValueError(f"segment {fields['warc-record-id']} does not follow its record")
            self.next += 1
        else:
            return None  # warcinfo and the like
        self.digest.update(block)
        self.size += len(block)
        if "warc-segment-number" in self.open and "warc-segment-total-length" not in fields:
            return None
        if base32(self.digest.digest()) != self.open["warc-payload-digest"]:
            raise ValueError(f"payload of {self.open['warc-record-id']} does not have its digest")
        return page_of(self.open["warc-record-id"]), self.size, self.digest.hexdigest(), "response", None


def read_archive(spark: SparkSession, path: str, in_order: bool = True) -> DataFrame:
    """One row per record, digests checked. in_order: each file is read by one task (gzip); else segments are brought together."""
    raw = spark.read.option("lineSep", NEXT).text(path).select(F.col("value").cast("binary").alias("record"))
    raw = raw.where(F.length("record") > 0)
    if not in_order:
        head = F.split(F.substring("record", 1, 4096).cast("string"), END)[0]
        origin = F.coalesce(F.regexp_extract(head, r"WARC-Segment-Origin-ID: (\S+)", 1), F.lit(""))
        origin = F.when(origin != "", origin).otherwise(F.regexp_extract(head, r"WARC-Record-ID: (\S+)", 1))
        number = F.coalesce(F.regexp_extract(head, r"WARC-Segment-Number: (\d+)", 1).try_cast("int"), F.lit(1))
        raw = raw.withColumn("origin", origin).withColumn("number", number).repartition("origin").sortWithinPartitions("origin", "number").select("record")

    def run(batches):
        reader = Reader()
        for batch in batches:
            found = [x for raw in batch.column(0) if (x := reader.feed(raw.as_py()))]
            columns = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=[x.split()[0] for x in RESULT.split(", ")])

    return common.arrow(raw, run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    path = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archive(spark, path)


def oracle_sql() -> str:
    return f"""
    WITH a AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
    b AS (SELECT page_id, strlen(p)::BIGINT AS payload_bytes, sha1(p) AS payload_digest FROM a),
    c AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS keeper FROM b)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper IS NOT NULL AND keeper IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to FROM c"""
