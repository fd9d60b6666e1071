"""k-anonymity of event streams: cohorts per time window, closed by a watermark.

Beyond what is asked of the batch engine: a stream of records with quasi-identifiers gives, per window and table, the size of each cohort; the least
of them is the window's k. Distinct records are counted exactly, by two groupings in a row whose state goes as the watermark passes (a row per record, window and
cohort); approximately, in one grouping with a sketch per cohort, only where asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cohorts(
    events: DataFrame, time: str, record: str, quasi: Sequence[str], window: str = "1 hour", late: str = "10 minutes", relative_error: float | None = None
) -> DataFrame:
    """(window_start, signature, n): distinct records per cohort and window; works on streams and on tables. Late events within `late` count.

    The signature is the JSON text of (name, value) pairs in order of name: no two cohorts share one, and a null is no empty text. relative_error: count
    approximately, to this error."""
    pair = lambda q: F.struct(F.lit(q).alias("name"), F.col(q).cast("string").alias("value"))
    signature = F.to_json(F.array(*map(pair, sorted(quasi))))
    own = events.withWatermark(time, late).select(F.window(time, window).alias("w"), signature.alias("signature"), F.col(record).alias("r"))
    if relative_error is not None:
        counted = own.groupBy("w", "signature").agg(F.approx_count_distinct("r", relative_error).alias("n"))
    else:
        once = own.where(F.col("r").isNotNull()).groupBy("w", "signature", "r").agg(F.count("*").alias("times"))
        counted = once.groupBy(F.window(F.window_time("w"), window).alias("w"), "signature").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "signature", "n")


def k_by_window(closed: DataFrame) -> DataFrame:
    """(window_start, k) of closed cohorts (of a batch, or of each micro-batch in foreachBatch)."""
    return closed.groupBy("window_start").agg(F.min("n").alias("k"))


def write_k(events: DataFrame, path: str, checkpoint: str, **options):
    """Starts a query that appends each closed window's k to Parquet; a batch that is run again replaces its own folder."""

    def sink(batch: DataFrame, number: int) -> None:
        k_by_window(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cohorts(events, **options).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
