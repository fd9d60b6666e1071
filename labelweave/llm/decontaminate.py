"""Benchmark decontamination by winnowing.

Of every window of consecutive k-gram hashes the smallest is kept (the leftmost of equal ones) as fingerprint, in
training and benchmark texts alike, so a shared span of k + window - 1 words always shares one. Fingerprints are joined, and each hit
is extended: the `span`-word windows around it are compared word hash by word hash with those of the benchmark. Items
shorter than a span are one window; for each length that occurs, k is that length and the winnowing window 1.

The benchmark is worked in blocks of about BLOCK_BYTES of text (its size is measured first). A block's table, about seven bytes for each byte of text, is
broadcast, and the documents pass it in one map, without a shuffle. If there are several blocks, the documents are written after each, and its
table goes before the next one is collected.

Defined results: null or empty texts have no words and are never contaminated; items without words or item_id are
ignored; a repeated item_id counts once; repeated documents are judged alike, each; an empty table on either side
gives no hits; a very long text is a slice of its own; items are dealt to blocks by hash, so one longer
than a block makes its block as large as it is, and the table with it; other columns pass through `flag` (its own begin with `prefix`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.llm import common

SPAN, GRAM, BLOCK_BYTES = 13, 5, 16 << 20
#: What flag() adds.
COLUMNS = ("n_words", "hit_starts", "hit_stops", "items", "n_hit", "n_items", "items_sha256", "contaminated")
_TOP = np.uint64((1 << 64) - 1)


class Words(common.WordHashes):
    """The lower-cased words of a slice of documents, with their fingerprints."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(common.lowered(data), offsets, alnum=True)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; all ones where the document ends before."""
        out = np.full(self.n, _TOP, dtype=np.uint64)
        whole = common.mix(self.prefix.rolling(k))
        out[: len(whole)] = whole
        out[np.arange(self.n) + k > self.end] = _TOP
        return out

    def fingerprints(self, k: int, window: int) -> np.ndarray:
        """The words at which kept k-grams begin."""
        if self.n < k + window - 1:
            return np.zeros(0, dtype=np.int64)
        grams = self.grams(k)
        if window == 1:
            return np.flatnonzero(np.arange(self.n) + k <= self.end)
        views = np.lib.stride_tricks.sliding_window_view(grams, window)
        ok = np.flatnonzero(np.arange(len(views)) + k + window - 1 <= self.end[: len(views)])
        best = views.min(axis=1)  # first the smallest, then where it stands first
        chosen = np.full(len(views), -1, dtype=np.int64)
        for j in range(window - 1, -1, -1):
            hit = grams[j : j + len(views)] == best
            chosen[hit] = np.flatnonzero(hit) + j
        return np.unique(chosen[ok])


class Table:
    """The windows of a block of items, by length: the distinct ones' hashes in order, where each stands in the items' words, and which items hold it;
    and the fingerprints. Windows that differ may share a hash: words are compared."""

    def __init__(self, items: list[tuple[int, str]], span: int, gram: int):
        texts = [t.encode() for _, t in items]
        offsets = np.cumsum([0, *map(len, texts)])
        w = Words(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
        ids, self.flat = np.array([i for i, _ in items], dtype=np.int64), w.hashes
        counts = np.diff(w.begin)
        sizes = np.minimum(counts, span)[w.row] if w.n else np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(np.arange(w.n) + sizes <= w.end)  # every word at which a window begins
        self.lengths = {}
        for size in np.unique(sizes[at]).tolist():
            k, own = gram if size == span else size, at[sizes[at] == size]
            keys = common.mix(w.prefix.ranges(own, own + size))
            order = np.lexsort((ids[w.row[own]], keys))
            own, keys = own[order], keys[order]
            new = np.append(True, keys[1:] != keys[:-1])
            same = np.flatnonzero(~new)
            for part in np.array_split(same, len(same) // (1 << 16) + 1):
                new[part] |= ~self.equal(self.flat, own[part], own[part - 1], size)
            group, holder = np.cumsum(new) - 1, ids[w.row[own]]
            both = np.unique(np.stack([group, holder], axis=1), axis=0) if len(own) else np.zeros((0, 2), dtype=np.int64)
            items_at = np.searchsorted(both[:, 0], np.arange(group[-1] + 2))
            prints = [np.zeros(0, dtype=np.uint64)]
            for part in np.array_split(own[new], int(new.sum()) // (1 << 16) + 1):  # of each window its smallest k-gram
                grams = common.mix(w.prefix.ranges((part[:, None] + np.arange(size - k + 1)).ravel(), (part[:, None] + np.arange(k, size + 1)).ravel()))
                prints.append(np.unique(grams.reshape(len(part), -1).min(axis=1)) if len(part) else grams)
            self.lengths[size] = (k, np.unique(np.concatenate(prints)), keys[new], own[new], items_at, np.ascontiguousarray(both[:, 1]))

    def equal(self, words: np.ndarray, at: np.ndarray, here: np.ndarray, size: int) -> np.ndarray:
        """Whether the windows of `words` at `at` are those of the block at `here`."""
        span = np.arange(size)
        return (words[at[:, None] + span] == self.flat[here[:, None] + span]).all(axis=1)

    def match(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ranges inside windows that occur (starts, stops), and (row, item) pairs, distinct and in order."""
        starts, stops, pairs = [], [], [np.zeros((0, 2), dtype=np.int64)]
        for size, (k, prints, keys, places, items_at, items) in self.lengths.items():
            at = w.fingerprints(k, size - k + 1)
            if not len(at):
                continue
            got = common.mix(w.prefix.ranges(at, at + k))
            near = np.minimum(np.searchsorted(prints, got), len(prints) - 1)
            at = at[prints[near] == got]
            if not len(at):
                continue
            at = np.unique((at[:, None] - np.arange(size - k + 1)).ravel())
            at = at[at >= 0]
            at = at[at + size <= w.end[at]]
            got = common.mix(w.prefix.ranges(at, at + size))
            lo, hi = np.searchsorted(keys, got), np.searchsorted(keys, got, side="right")
            which = np.repeat(np.arange(len(at)), hi - lo)
            group = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            at = at[which]
            ok = self.equal(w.hashes, at, places[group], size)
            at, group = at[ok], group[ok]
            starts.append(at)
            stops.append(at + size)
            found = np.unique(np.stack([w.row[at], group], axis=1), axis=0)
            many = items_at[found[:, 1] + 1] - items_at[found[:, 1]]
            held = np.repeat(items_at[found[:, 1]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            pairs.append(np.stack([np.repeat(found[:, 0], many), items[held]], axis=1))
        none = [np.zeros(0, dtype=np.int64)]
        return np.concatenate(starts or none), np.concatenate(stops or none), np.unique(np.concatenate(pairs), axis=0)


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in lists of about `most` bytes, collected one at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = -(-size // most)
    for b in range(n):
        yield [(x["item_id"], x["text"]) for x in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).toLocalIterator()]


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int64()))


def flag(docs: DataFrame, benchmark: DataFrame, prefix: str = "", span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated, and the hit ranges of words (hit_starts, hit_stops), each name after the prefix
    (after common.free_prefix of it, where docs has a column of such a name)."""
    prefix = common.free_prefix(docs.columns, prefix, COLUMNS)
    spark = docs.sparkSession
    names = [f"{prefix}{x}" for x in ("n_words", "hit_starts", "hit_stops", "items")]
    kinds = [T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(T.LongType()), T.ArrayType(T.LongType())]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, kinds))])
    fields = list(docs.columns)

    def one(table, first: bool):
        def run(batches):
            for batch in batches:
                data, offsets = common.flat(batch.column(fields.index("text")))
                rows, ranges, items = [], [np.zeros((0, 3), dtype=np.int64)], [np.zeros((0, 2), dtype=np.int64)]
                for a, b, part, at in common.slices(data, offsets):
                    w = Words(part, at)
                    starts, stops, found = table.value.match(w)
                    row = w.row[starts] if len(starts) else starts
                    ranges.append(np.stack([row + a, starts - w.begin[row], stops - w.begin[row]], axis=1))
                    items.append(found + np.array([a, 0]))
                    rows.append(np.diff(w.begin))
                n, columns = batch.num_rows, list(batch.columns)
                if not first:  # what earlier blocks found
                    columns, (old_starts, old_stops, old_items) = columns[:-4], batch.columns[-3:]
                    own = np.repeat(np.arange(n), np.diff(old_starts.offsets.to_numpy()))
                    ranges.append(np.stack([own, old_starts.flatten().to_numpy(), old_stops.flatten().to_numpy()], axis=1))
                    own = np.repeat(np.arange(n), np.diff(old_items.offsets.to_numpy()))
                    items.append(np.stack([own, old_items.flatten().to_numpy()], axis=1))
                ranges, items = np.concatenate(ranges), np.unique(np.concatenate(items), axis=0)
                shift = ranges[:, 0] << 40  # a stretch of its own for each row
                starts, stops = common.intervals(ranges[:, 1] + shift, ranges[:, 2] + shift)
                row, low = starts >> 40, (1 << 40) - 1
                cuts, item_cuts = np.searchsorted(row, np.arange(n + 1)), np.searchsorted(items[:, 0], np.arange(n + 1))
                new = [pa.array(np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64), pa.int64()), _lists(starts & low, cuts), _lists(stops & low, cuts), _lists(items[:, 1], item_cuts)]
                yield pa.RecordBatch.from_arrays([*columns, *new], names=[*fields, *names])

        return run

    out, table, before = docs, None, None
    for k, block in enumerate(blocks(benchmark, block_bytes)):
        if table is not None:  # documents with the hits so far, so that one table is alive at a time
            out, last = common.written(out, "hits"), before
            table.destroy()
            common.drop(last)
            before = out
        table = spark.sparkContext.broadcast(Table(block, span, gram))
        del block
        out = common.arrow(out, one(table, not k), schema)
    if table is None:
        out = common.arrow(out, one(spark.sparkContext.broadcast(Table([], span, gram)), True), schema)
    hit = F.aggregate(F.zip_with(names[2], names[1], lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn(f"{prefix}n_hit", hit).withColumn(f"{prefix}n_items", F.size(names[3]).cast("long"))
    out = out.withColumn(f"{prefix}items_sha256", F.sha2(F.array_join(F.array_sort(F.transform(names[3], lambda x: x.cast("string"))), ","), 256))
    return out.withColumn(f"{prefix}contaminated", (F.col(f"{prefix}n_hit") > 0) & (F.col(f"{prefix}n_hit") * 20 >= F.col(names[0])))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, that are not contaminated."""
    prefix = common.free_prefix(docs.columns, "_", COLUMNS)
    return flag(docs, benchmark, prefix).where(~F.col(f"{prefix}contaminated")).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = common.with_key(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return flag(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def oracle_sql() -> str:
    """Short items and windows by their words, joined with commas between them (a word holds none)."""

    def words(table: str, key: str) -> str:
        return f"SELECT row_number() OVER () AS rid, {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"

    return f"""
    WITH d AS ({words("documents", "doc_id")}), b AS ({words("benchmark", "item_id")}),
    g AS (SELECT item_id, least(len(w), {SPAN}) AS k, unnest(range(1, len(w) - least(len(w), {SPAN}) + 2)) AS i, w FROM b WHERE len(w) > 0 AND item_id IS NOT NULL),
    win AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ',') AS x FROM g),
    ks AS (SELECT DISTINCT k FROM win),
    p AS (SELECT rid, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, ks WHERE len(w) >= k),
    m AS (SELECT p.rid, p.i, p.k, win.item_id FROM p JOIN win ON p.k = win.k AND array_to_string(p.w[p.i : p.i + p.k - 1], ',') = win.x),
    h AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS j FROM m) GROUP BY rid),
    t AS (SELECT rid, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM m GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
           sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)"""
