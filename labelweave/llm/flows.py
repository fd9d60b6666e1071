"""Packed shuffles for operators that compare passages of all documents.

Hashes and positions travel in blobs: one row per (map task's share, bucket), holding compressed numpy arrays, instead of
one row per hash. Documents travel in packs, one per (map task's share, destination), so that verdicts can be brought to the texts
they are about. A document is named by its doc_id and 64 bits: 63 of its text's hash (rows without a doc_id, or several texts of one, are told apart by
them: m such texts share a name with a probability of m * m / 2**64), and one that says that it has no doc_id. A blob lists its documents once.

`at_documents` is the join of verdicts and texts: both are dealt by document, verdicts sort before texts, and a task streams the packs
of a destination past the verdicts on it.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm import common

#: Text bytes in the packs of a share, and records in the blobs of one (more where there are many buckets, see share()).
PACK_BYTES, SHARE = 8 << 20, 1 << 18
BLOBS = "dest int, kind int, payload binary"


def large(least: int, n: int) -> int:
    """Bytes that a map task gathers before it deals them to n buckets: about 128 KB a bucket, within bounded memory; smaller blobs compress worse."""
    return max(least, min(4 * least, n << 17))


def share(n: int) -> int:
    """Records that a map task gathers before it deals them to n buckets: eight a blob on average, within bounded memory."""
    return max(SHARE, min(8 * SHARE, 8 * n))


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as bytes; compressed if that pays."""
    head = struct.pack("<B", len(arrays)) + b"".join(a.dtype.str.encode().ljust(4) + struct.pack("<q", len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(payload: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, at, out = raw[0], 1 + 12 * raw[0], []
    for k in range(n):
        kind, size = np.dtype(raw[1 + 12 * k : 5 + 12 * k].decode().strip()), struct.unpack_from("<q", raw, 5 + 12 * k)[0]
        out.append(np.frombuffer(raw, dtype=kind, count=size, offset=at))
        at += size * kind.itemsize
    return out


def small(x: np.ndarray) -> np.ndarray:
    """In the narrowest unsigned type that holds all values."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def steps(x: np.ndarray) -> np.ndarray:
    """Differences from one value to the next (any order), small when near: zigzag."""
    d = np.diff(x.astype(np.int64), prepend=0)  # wraps around, and back in unsteps
    return small(((d << 1) ^ (d >> 63)).view(np.uint64))


def unsteps(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    return np.cumsum(((x >> np.uint64(1)).astype(np.int64)) ^ -((x & np.uint64(1)).astype(np.int64)))


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The doc_ids of a column, and which are missing; in their place stands the greatest id."""
    return pc.fill_null(column, common.NO_ID).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)


def named_by_id(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own; then it is the document's name, and hashes, which would travel with every record, are 0."""
    n, ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.sum("n"), F.count("doc_id")).first()
    return n == ids


def doc_hashes(texts: list[bytes], missing: np.ndarray, by_id: bool = False) -> np.ndarray:
    """The second half of documents' names: the last bit says that there is no doc_id."""
    if by_id:
        return np.zeros(len(texts), dtype=np.uint64)
    found = np.array([xxhash.xxh64_intdigest(x) for x in texts], dtype=np.uint64)
    return (found & ~np.uint64(1)) | missing.astype(np.uint64)


def doc_hash(text: bytes) -> int:
    """doc_hashes() of one text that has a doc_id."""
    return xxhash.xxh64_intdigest(text) & ~1


def ids_back(ids: np.ndarray, hashes: np.ndarray) -> pa.Array:
    """doc_ids as they came, the missing ones null."""
    return pa.array(ids, pa.int64(), mask=(hashes & np.uint64(1)).astype(bool))


def ranked(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Numbers in the order of the doc_ids, with missing ones after all others."""
    last = ids == common.NO_ID
    if not last.any():
        return ids
    missing = (hashes & np.uint64(1)).astype(bool)
    if missing[last].all():  # the greatest id stands for missing ones alone
        return ids
    return 2 * np.unique(ids, return_inverse=True)[1].astype(np.int64) + missing


class Docs:
    """Which document each of many records is of; records of a document stand together."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray):
        self.ids, self.hashes = ids, hashes  # by record

    def table(self) -> tuple[np.ndarray, ...]:
        new = np.ones(len(self.ids), dtype=bool)
        new[1:] = (self.ids[1:] != self.ids[:-1]) | (self.hashes[1:] != self.hashes[:-1])
        first = np.flatnonzero(new)
        return steps(self.ids[first]), self.hashes[first].astype(np.uint64), small(np.diff(np.append(first, len(self.ids))))

    @staticmethod
    def read(ids: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> Docs:
        counts = counts.astype(np.int64)
        return Docs(np.repeat(unsteps(ids), counts), np.repeat(hashes, counts))


def destination(ids: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    return (common.mix(ids.astype(np.uint64) ^ common.mix(hashes.astype(np.uint64))) % np.uint64(n)).astype(np.int64)


def bucket_of(values: np.ndarray, n: int) -> np.ndarray:
    """By the top 32 bits of 64."""
    return ((values >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def dealt(where: np.ndarray, kind: int, columns: Callable[[np.ndarray], tuple[np.ndarray, ...]], level: int = 1) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, blob of the columns at the bucket's records, in order) for each bucket that occurs."""
    if len(where):
        order = np.argsort(where, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(where[order], prepend=-1)), len(order))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield int(where[order[a]]), kind, pack(*columns(order[a:b]), level=level)


def verdicts(ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray, n: int, kind: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """Ranges of documents, joined where they touch, as blobs by the documents' destination."""
    if not len(ids):
        return
    order = np.lexsort((starts, hashes, ids))
    ids, hashes, starts, stops = ids[order], hashes[order], starts[order], stops[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])
    shift = (np.cumsum(new) - 1) << 40  # a range of its own for each document
    a, b = common.intervals(starts + shift, stops + shift)
    doc = np.flatnonzero(new)[a >> 40]
    a, b, ids, hashes = a & ((1 << 40) - 1), b & ((1 << 40) - 1), ids[doc], hashes[doc]
    yield from dealt(destination(ids, hashes, n), kind, lambda x: (*Docs(ids[x], hashes[x]).table(), small(a[x]), small(b[x] - a[x])))


def read_verdicts(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """ids, hashes, starts, stops."""
    parts = []
    for blob in blobs:
        *table, starts, sizes = unpack(blob)
        docs = Docs.read(*table)
        starts = starts.astype(np.int64)
        parts.append((docs.ids, docs.hashes, starts, starts + sizes.astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def rows(out: Iterator[tuple[int, int, bytes]], most: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int, bytes]] = []

    def batch():
        columns = list(zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["dest", "kind", "payload"])

    for x in out:
        held.append(x)
        if len(held) >= most:
            yield batch()
            held.clear()
    if held:
        yield batch()


def texts(docs: DataFrame, others: bool = False) -> DataFrame:
    """(doc_id, text binary): a null text is empty. others: then all other columns, doc_id too, as they are but for
    their names, which are positions."""
    doc = F.col("doc_id").cast("long").alias("_doc")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("_text")
    return docs.select(doc, text, *(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns) if others and c != "text"))


def packed(docs: DataFrame, n: int, kind: int = 9, by_id: bool = False) -> DataFrame:
    """Documents (texts()) in packs by destination. Other columns go along as Arrow's own bytes."""

    def run(batches):
        def flush(held):
            table = pa.Table.from_batches(held).combine_chunks()
            raw = table.column(1).to_pylist()
            ids, missing = ids_of(table.column(0))
            hashes = doc_hashes(raw, missing, by_id)
            where = destination(ids, hashes, n)
            order = np.argsort(where, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(where[order], prepend=-1)), len(order))
            for a, b in zip(cuts[:-1], cuts[1:]):
                own = order[a:b]
                sizes = np.array([len(raw[i]) for i in own], dtype=np.int64)
                others = []
                if table.num_columns > 2:
                    sink = pa.BufferOutputStream()
                    few = table.select(range(2, table.num_columns)).take(own)
                    with pa.ipc.new_stream(sink, few.schema) as out:
                        out.write_table(few)
                    others = [np.frombuffer(sink.getvalue(), dtype=np.uint8)]
                yield int(where[own[0]]), kind, pack(ids[own], hashes[own], sizes, np.frombuffer(b"".join(raw[i] for i in own), dtype=np.uint8), *others, level=3)

        def all_of():
            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.column(1).nbytes
                if size > large(PACK_BYTES, n):
                    yield from flush(held)
                    held, size = [], 0
            if held:
                yield from flush(held)

        return rows(all_of(), most=4)

    return common.arrow(docs, run, BLOBS)


def at_documents(replies: DataFrame, packs: DataFrame, n: int, fn: Callable, schema: str) -> DataFrame:
    """fn(iterator of (replies by kind, ids, hashes, data, offsets, other columns)) gives record batches; the replies are the
    blobs of the packs' destination: {kind: [blob, ...]}."""

    def run(batches):
        def stream():
            now, held = None, {}
            for batch in batches:
                for dest, kind, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    if dest != now:
                        now, held = dest, {}
                    if kind != 9:
                        held.setdefault(kind, []).append(payload.as_py())
                    else:
                        ids, hashes, sizes, data, *others = unpack(payload.as_py())
                        yield held, ids, hashes, data, np.append(0, np.cumsum(sizes)), others and pa.ipc.open_stream(others[0].tobytes()).read_all()

        return fn(stream())

    both = replies.select("dest", "kind", "payload").unionByName(packs)
    return common.arrow(both.repartition(n, "dest").sortWithinPartitions("dest", "kind"), run, schema)


def in_buckets(blobs: DataFrame, n: int, fn: Callable[[list[bytes]], Iterator[tuple[int, int, bytes]]], done: int | None = None) -> DataFrame:
    """fn over all blobs of a bucket; it gives blobs for the next step. Blobs of the kind `done` go on as they are."""

    def run(batches):
        def all_of():
            now, held = None, []
            for batch in batches:
                for dest, kind, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    if kind == done:
                        yield dest, kind, payload.as_py()
                        continue
                    if dest != now and held:
                        yield from fn(held)
                        held = []
                    now = dest
                    held.append(payload.as_py())
            if held:
                yield from fn(held)

        return rows(all_of())

    return common.arrow(blobs.select("dest", "kind", "payload").repartition(n, "dest").sortWithinPartitions("dest"), run, BLOBS)


class ByDocument:
    """Ranges of positions by document, looked up as packs stream by."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, *columns: np.ndarray):
        order = np.lexsort((hashes, ids))
        self.ids, self.hashes, self.columns = ids[order], hashes[order], [c[order] for c in columns]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (self.ids[1:] != self.ids[:-1]) | (self.hashes[1:] != self.hashes[:-1])
        cuts = np.append(np.flatnonzero(new), len(ids)).tolist()
        self.at = {(i, h): (a, b) for i, h, a, b in zip(self.ids[cuts[:-1]].tolist(), self.hashes[cuts[:-1]].tolist(), cuts, cuts[1:])}

    def get(self, doc: int, hash_: int) -> list[np.ndarray] | None:
        found = self.at.get((doc, hash_))
        return found and [c[found[0] : found[1]] for c in self.columns]


def largest(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """As smallest()."""
    first = np.flatnonzero(groups)
    return np.repeat(np.maximum.reduceat(values, first), np.diff(np.append(first, len(values)))) if len(values) else values


def smallest(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For records sorted by group (new[i]: a group begins): the smallest value of each one's group."""
    first = np.flatnonzero(groups)
    return np.repeat(np.minimum.reduceat(values, first), np.diff(np.append(first, len(values)))) if len(values) else values
