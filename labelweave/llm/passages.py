"""Substring dedup by fixed-block anchors, over words.

Every document is cut into non-overlapping blocks of `BLOCK` words, whose hashes are the index; every rolling window
of BLOCK words, of every document, is a probe. A repeat of WINDOW = 2 * BLOCK words holds a whole block of its other occurrence, so it
shows up as a hit. Around each hit between different documents, on both sides, the windows of WINDOW words that contain it are
taken (the hit is extended that far to either end) and compared: a window is removed where a document with a smaller
doc_id has it too. Removed windows join into maximal repeats.

Index and probes travel as 4-byte hashes in blobs by hash, so a passage that many documents hold spreads by its
blocks; windows are made distinct in each map task before they are dealt, so a copied window costs one record per task at most.
Windows are compared by two hashes, 64 and 32 bits of independent polynomials over the words' hashes: n distinct candidate windows give n * n / 2**97
false repeats on average, one in 160,000 runs with 10**12 windows. Words are compared by hashes of 64 bits, and no text is exchanged.

Defined results: a null or empty text has no words; a very long text is a slice of its own; rows without a doc_id come after all others and do not remove one another's
words, nor do rows with the same doc_id; rows repeated whole get the same result each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import common, flows

BLOCK = 25
WINDOW = 2 * BLOCK


def probes(batches, n: int, block: int):
    """Blobs of (hash, document, word) for each rolling window."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush():
        keys, ids, hashes, at = (np.concatenate(x) for x in zip(*held))
        yield from flows.dealt(
            flows.bucket_of(keys, n), 0, lambda x: (*flows.Docs(ids[x], hashes[x]).table(), (keys[x] & np.uint64(0xFFFFFFFF)).astype(np.uint32), flows.steps(at[x]))
        )

    size = 0
    for batch in batches:
        ids, missing = flows.ids_of(batch.column(0))
        data, offsets = common.flat(batch.column(1))
        for first, end, part, begin in common.slices(data, offsets):
            w = common.WordHashes(part, begin)
            if w.n < block:
                continue
            at = np.flatnonzero(np.arange(w.n) + block <= w.end)
            row, raw = w.row[at], part.tobytes()
            own = flows.doc_hashes([raw[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())], missing[first:end])
            keys = common.mix(w.prefix.ranges(at, at + block))
            held.append((keys, ids[first:end][row], own[row], at - w.begin[row]))
            size += len(at)
            if size > flows.share(n):
                yield from flush()
                held.clear()
                size = 0
    if held:
        yield from flush()


def hits(blobs: list[bytes], n: int, block: int):
    """Probes that meet an indexed block, where different documents do: as verdict-like ranges of one word."""
    keys, ids, hashes, at = [], [], [], []
    for blob in blobs:
        *table, key, step = flows.unpack(blob)
        docs = flows.Docs.read(*table)
        keys.append(key)
        ids.append(docs.ids)
        hashes.append(docs.hashes)
        at.append(flows.unsteps(step))
    keys, ids, hashes, at = map(np.concatenate, (keys, ids, hashes, at))
    index = np.unique(keys[at % block == 0])
    near = np.minimum(np.searchsorted(index, keys), len(index) - 1)
    hit = np.flatnonzero(index[near] == keys) if len(index) else np.zeros(0, dtype=np.int64)
    order = hit[np.argsort(keys[hit], kind="stable")]
    new = np.ones(len(order), dtype=bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    rank = flows.ranked(ids[order], hashes[order])
    order = order[flows.smallest(new, rank) != flows.largest(new, rank)]
    yield from flows.verdicts(ids[order], hashes[order], at[order], at[order] + 1, n, kind=1)


def extend(stream, n: int, block: int, window: int):
    """Windows around hits: those that another document of the share holds too are decided, the others dealt by hash."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush():
        keys, checks, ids, hashes, at = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((checks, keys))
        keys, checks, ids, hashes, at = (x[order] for x in (keys, checks, ids, hashes, at))
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
        rank = flows.ranked(ids, hashes)
        later = rank > flows.smallest(new, rank)
        yield from flows.verdicts(ids[later], hashes[later], at[later], at[later] + window, n)
        rest = np.flatnonzero(~later)
        rest = rest[np.lexsort((at[rest], hashes[rest], ids[rest]))]
        keys, checks, ids, hashes, at = (x[rest] for x in (keys, checks, ids, hashes, at))
        yield from flows.dealt(flows.bucket_of(keys, n), 2, lambda x: (*flows.Docs(ids[x], hashes[x]).table(), keys[x], checks[x], flows.steps(at[x])))

    size, seen, asked = 0, None, None
    for replies, ids, hashes, data, offsets, _ in stream:
        if replies is not seen:
            seen, asked = replies, flows.ByDocument(*flows.read_verdicts(replies.get(1, [])))
        for first, end, part, begin in common.slices(data, offsets):
            wanted = [(row, x) for row in range(end - first) if (x := asked.get(int(ids[first + row]), int(hashes[first + row])))]
            if not wanted:
                continue
            w = common.WordHashes(part, begin)
            change = np.zeros(w.n + 2, dtype=np.int64)
            for row, (starts, stops) in wanted:
                a, b = w.begin[row], w.begin[row + 1]
                lo, hi = np.maximum(starts + a - (window - block), a), np.minimum(stops - 1 + a, b - window)
                ok = hi >= lo
                np.add.at(change, lo[ok], 1)
                np.add.at(change, hi[ok] + 1, -1)
            at = np.flatnonzero(np.cumsum(change)[: w.n] > 0)
            if len(at):
                row = w.row[at]
                check = (common.mix(w.second().ranges(at, at + window)) >> np.uint64(32)).astype(np.uint32)
                held.append((common.mix(w.prefix.ranges(at, at + window)), check, ids[first:end][row], hashes[first:end][row], at - w.begin[row]))
                size += len(at)
            if size > flows.share(n):
                yield from flush()
                held.clear()
                size = 0
    if held:
        yield from flush()


def decide(blobs: list[bytes], n: int, window: int):
    columns: list[list[np.ndarray]] = [[] for _ in range(5)]
    for blob in blobs:
        *table, key, check, step = flows.unpack(blob)
        docs = flows.Docs.read(*table)
        for held, x in zip(columns, (key, check, docs.ids, docs.hashes, flows.unsteps(step))):
            held.append(x)
    keys, checks, ids, hashes, at = map(np.concatenate, columns)
    order = np.lexsort((checks, keys))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (checks[order][1:] != checks[order][:-1])
    rank = flows.ranked(ids[order], hashes[order])
    later = order[rank > flows.smallest(new, rank)]
    yield from flows.verdicts(ids[later], hashes[later], at[later], at[later] + window, n)


def removed(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, int]:
    """Blobs of the word ranges to remove, by document, and the documents' packs."""
    n, window = common.buckets(docs.sparkSession), 2 * block
    rows = flows.texts(docs)
    asked = common.settled(flows.in_buckets(common.arrow(rows, lambda b: flows.rows(probes(b, n, block)), flows.BLOBS), n, lambda x: hits(x, n, block)), "hits")
    packs = flows.packed(rows, n)
    found = common.settled(flows.at_documents(asked, packs, n, lambda s: flows.rows(extend(s, n, block, window)), flows.BLOBS), "windows")
    decided = flows.in_buckets(found.where("kind = 2"), n, lambda x: decide(x, n, window))
    return found.where("kind = 0").unionByName(decided), packs, n


def dedup_passages(docs: DataFrame, block: int = BLOCK, with_text: bool = True) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256, and the kept words joined by spaces (kept), if asked for."""
    found, packs, n = removed(docs, block)

    def finish(stream):
        seen, gone = None, None
        for replies, ids, hashes, data, offsets, _ in stream:
            if replies is not seen:
                seen, gone = replies, flows.ByDocument(*flows.read_verdicts(replies.get(0, [])))
            raw, total, cut, sums, kept = data.tobytes(), [], [], [], []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                words = raw[a:b].split()
                total.append(len(words))
                if x := gone.get(int(ids[k]), int(hashes[k])):
                    mask = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(mask, x[0], 1)
                    np.add.at(mask, x[1], -1)
                    stay = np.cumsum(mask[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                cut.append(total[-1] - len(words))
                text = b" ".join(words)
                sums.append(hashlib.sha256(text).hexdigest())
                kept.append(text)
            columns = [flows.ids_back(ids, hashes), pa.array(total, pa.int64()), pa.array(cut, pa.int64()), pa.array(sums), *([pa.array(kept, pa.binary())] if with_text else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text])

    out = flows.at_documents(found, packs, n, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept binary" * with_text)
    return out.withColumn("kept", F.col("kept").cast("string")) if with_text else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return dedup_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


def oracle_sql() -> str:
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (SELECT r, doc_id, i, list_aggregate(w[i:i + {WINDOW - 1}], 'string_agg', ' ') AS s
            FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
    first_in AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
    hit AS (SELECT r, i FROM win JOIN first_in USING (s) WHERE least < doc_id OR (doc_id IS NULL AND least IS NOT NULL)),
    gone AS (SELECT DISTINCT r, i + k AS p FROM hit, range({WINDOW}) t(k)),
    word AS (SELECT r, w[p] AS word, p FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
    kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (r)"""
