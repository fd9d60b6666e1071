"""Sharding by Karmarkar-Karp differencing.

Documents of equal text are an indivisible group. Groups over 1/(shards * FINE) of all bytes are items of their own:
there are at most shards * FINE of them, whatever the table's size. All other groups are dealt by their digest into
shards * FINE bundles. So at most 2 * shards * FINE items reach the driver, where the multi-way differencing method
runs: each item is a partial partition; the two with the largest spread are combined in opposite order, over and over,
until one is left. Law: `bytes`. A group larger than a shard's fair share stays whole and makes its shard the largest.

Slots are gapless without sorting a shard in one task: rows are numbered within (bundle, part), the parts of a bundle are dealt by a hash of the
row, whatever its doc_id and text, and hold PART_ROWS rows on average (more only where there would be over shards * FINE * PARTS parts), and parts get
running offsets.

Defined results: a very long text counts by its bytes alone; a null text has no bytes and goes with empty ones (size 8, CRC 0); a null doc_id is a row like any other; repeated
rows each get a slot; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelweave.llm import common

SHARDS, FINE, PART_ROWS, PARTS, OVERHEAD = 24, 64, 1_000, 64, 8


def differencing(sizes: list[int], shards: int) -> list[int]:
    """A shard for each item, by multi-way Karmarkar-Karp."""
    if not sizes:
        return []
    # (minus spread, order of making, sums in descending order, the items behind each sum)
    heap = [(-s, i, [s] + [0] * (shards - 1), [[i]] + [[] for _ in range(shards - 1)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums = [p + q for p, q in zip(a, reversed(b))]
        items = [p + q for p, q in zip(x, reversed(y))]
        rank = sorted(range(shards), key=lambda k: -sums[k])
        sums, items = [sums[k] for k in rank], [items[k] for k in rank]
        base = sums[-1]
        heapq.heappush(heap, (base - sums[0], made, [s - base for s in sums], items))
        made += 1
    out = [0] * len(sizes)
    for shard, items in enumerate(heap[0][3]):
        for i in items:
            out[i] = shard
    return out


def shard(docs: DataFrame, shards: int = SHARDS, fine: int = FINE, part_rows: int = PART_ROWS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = (F.octet_length(text) + OVERHEAD).cast("long").alias("size")
    # row: a name of its own for each row of the table, repeated rows too; it is written, so a task that runs again later sees the same one
    rows = common.written(common.with_key(docs).select("doc_id", size, F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("group"), F.monotonically_increasing_id().alias("row")), "shard-rows")
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    part_rows = max(part_rows, -(-n_rows // (shards * fine * PARTS)))
    least = total // (shards * fine) + 1
    large = groups.where(F.col("size") >= least).collect()  # fewer than shards * fine
    bundle = F.pmod(F.xxhash64("group"), F.lit(shards * fine)).cast("int")
    small = groups.where(F.col("size") < least).groupBy(bundle.alias("bundle")).agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()
    items = sorted([(x["size"], x["n"], x["bundle"], None) for x in small] + [(x["size"], x["n"], shards * fine + i, bytes(x["group"])) for i, x in enumerate(sorted(large, key=lambda x: bytes(x["group"])))], key=lambda x: (-x[0], x[2]))
    shard_of = differencing([x[0] for x in items], shards)
    # in each shard, bundles one after the other
    begin, placed = [0] * shards, []
    for (_, n, b, group), s in zip(items, shard_of):
        placed.append((b, group, s, begin[s], max(1, -(-n // part_rows))))
        begin[s] += n
    own = spark.createDataFrame([(g, b) for b, g, *_ in placed if g is not None], "group binary, own int")
    where = spark.createDataFrame([(b, s, at, parts) for b, _, s, at, parts in placed], "bundle int, shard int, at long, parts int")
    rows = (
        rows.join(F.broadcast(own), "group", "left")  # both are bounded by 2 * shards * fine rows
        .withColumn("bundle", F.coalesce("own", bundle))
        .join(F.broadcast(where), "bundle")
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), F.col("parts")).cast("int"))
    )
    counts = rows.groupBy("bundle", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("bundle").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = before.select("bundle", "part", F.coalesce("before", F.lit(0)).alias("before"))
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("bundle", "part").orderBy("doc_id", "text_crc32", "row")))
    return numbered.join(offsets, ["bundle", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("before") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
