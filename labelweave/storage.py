"""Tables in the folder that all executors share, for cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is named and all runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="labelweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage and survives the loss of an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


#: Rows of a part, where spread() is told how many there are.
PART_ROWS = 1 << 20


def spread(df: DataFrame, *keys, rows: int = 0) -> DataFrame:
    """df dealt by keys into as many partitions as Spark's shuffles begin with, or more for many rows. Spark does not put these together to fewer, as it would after
    looking at compressed sizes: a task that groups or sorts rows holds many times that."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // PART_ROWS), *keys)


def observed(df: DataFrame, what: str, **counts) -> tuple[DataFrame, dict]:
    """written(), and how many rows it has (n) with further aggregates, taken from the write itself: no second job."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in counts.items())), what)
    return out, dict(seen.get)


class Kept:
    """A table that grows by parts, each written where it came from; they become one from time to time."""

    PARTS = 8

    def __init__(self, what: str):
        self.what, self.parts = what, []
        self.rows = 0

    @property
    def table(self) -> DataFrame | None:
        out = None
        for p in self.parts:
            out = p if out is None else out.unionByName(p)
        return out

    def add(self, df: DataFrame) -> DataFrame | None:
        """The part, written; none if it has no rows."""
        part, seen = observed(df, self.what)
        self.rows += seen["n"]
        if not seen["n"]:
            if self.parts:
                drop(part)
                return None
        self.parts.append(part)
        if len(self.parts) > self.PARTS:
            self.replace(self.table, but=part)
        return part

    def replace(self, df: DataFrame, but: DataFrame | None = None) -> None:
        """The table is this one now; of the parts before, `but` stays for a while."""
        before = self.parts
        part, seen = observed(df, self.what)
        self.parts, self.rows = [part], seen["n"]
        drop(*(p for p in before if p is not but))

    def drop(self) -> None:
        drop(*self.parts)
        self.parts = []


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables that written() made, once nothing reads them any more."""
    for df in tables:
        if path := getattr(df, "_written_to", None):
            spark = df.sparkSession
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
