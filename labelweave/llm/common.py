"""What several operators share: byte and word views of Arrow text columns, polynomial hashes, blobs and written tables.

Texts reach Python as Arrow batches and are worked on in slices of a quarter megabyte, so that memory does not follow
the size of a partition.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.session import ship_package
from labelweave.storage import drop, shared_dir, written  # noqa: F401

#: Bytes of text that are turned into numpy arrays at once (a longer document makes a slice of its own).
SLICE_BYTES = 1 << 18
#: Stands in the place of a missing doc_id, beside a flag (flows.ids_of).
NO_ID = (1 << 63) - 1

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches (a batch of very long documents must fit beside the JVM), and this package on the executors."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def settled(df: DataFrame, what: str) -> DataFrame:
    """written(), and the driver's garbage collected: the shuffle files behind the table go then, not whenever the driver happens to collect.
    Spark holds on to the last query that it ran, so a small one is run first."""
    out = written(df, what)
    del df
    out.sparkSession.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def buckets(spark: SparkSession) -> int:
    """One bucket for each shuffle partition; beyond 262,144 the blobs of flows.py would hold a record each."""
    return max(1, min(1 << 18, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """b**i and b**-i modulo 2**64 for i below n."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, 4 * SLICE_BYTES)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefix:
    """Prefix polynomial hashes of a sequence: the hash of any range in constant time."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]

    def rolling(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:-k]) * self.down[:n] if n > 0 else np.zeros(0, dtype=np.uint64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end, and where each row's begin (one offset more than rows). Null: empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n, at = len(column), column.offset
    if not n:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[at : at + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, their bytes, their offsets) in pieces of about `most` bytes, whole rows each."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, alnum: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, first word of each row): maximal runs of non-space bytes, or of [0-9a-z] and bytes over 0x7F.

    No word crosses a row's end. The classes hold ASCII bytes only or all others, so UTF-8 needs no decoding."""
    inside = _ALNUM[data] if alnum else ~_SPACE[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    stops = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, stops, np.searchsorted(starts, offsets)


class WordHashes:
    """The words of a slice of documents as hashes: of each word its document (row) and the word after that document's last (end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, alnum: bool = False):
        starts, stops, self.begin = words(data, offsets, alnum)
        self.hashes = mix(Prefix(data).ranges(starts, stops) ^ mix((stops - starts).astype(np.uint64)))
        self.prefix, self.n = Prefix(self.hashes), len(starts)
        self.row = np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))
        self.end = self.begin[1:][self.row]

    def second(self) -> Prefix:
        """A prefix of the words' hashes under another bijection, independent of the first."""
        return Prefix(mix(self.hashes ^ np.uint64(0xA0761D6478BD642F)))


def intervals(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges as maximal disjoint ones, in order."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate(stops[order])
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] > b[:-1]
    first = np.flatnonzero(new)
    return a[first], b[np.append(first[1:], len(a)) - 1]


_LEAN: list = []


def _lean() -> None:
    """In a worker, once: large arrays straight from the system, and back to it when freed. Workers are kept between tasks, and several
    share an executor's memory."""
    if _LEAN:
        return
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD, no longer raised by what was freed; smaller arrays are reused without new pages
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD: within a task; _trim gives back the rest
        _LEAN.append(libc)
    except (OSError, AttributeError):  # another C library
        _LEAN.append(None)


def _trim() -> None:
    _POWERS.clear()
    if _LEAN and _LEAN[0]:
        _LEAN[0].malloc_trim(0)


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow, in workers that give memory back."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _lean()
        yield from run(batches)
        _trim()

    return df.mapInArrow(lean, schema)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """fn over each Arrow batch that has rows."""
    return arrow(df, lambda batches: (fn(b) for b in batches if b.num_rows), schema)


def free_prefix(columns: list[str], prefix: str, names) -> str:
    """The prefix, after as many underscores as keep `names` behind it apart from the columns (whose case Spark ignores)."""
    held = {c.lower() for c in columns}
    while any(f"{prefix}{x}".lower() in held for x in names):
        prefix = f"_{prefix}"
    return prefix


def with_key(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text) alone, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
