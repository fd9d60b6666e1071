"""Results kept as Parquet under a hash of all that they depend on."""

from __future__ import annotations

import hashlib
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.env import Env
from labelweave.plans.engine import Engine, Result


def content_key(env: Env, **options) -> str:
    """A hash of all tables (sums of row hashes: order does not count), rules and options. User rules have no stable hash and are refused."""
    if options.get("extra"):
        raise ValueError("results of user rules are not kept")
    parts = [repr(asdict(env.rules)), repr(sorted(options.items()))]
    for name in sorted(env.tables):
        df = env.tables[name]
        text = F.to_json(F.struct(*df.columns))
        row = df.select(F.xxhash64(text).cast("decimal(38,0)").alias("a"), F.hash(text).cast("decimal(38,0)").alias("b")).agg(F.count("*"), F.sum("a"), F.sum("b")).first()
        parts.append(f"{name}{tuple(map(str, row))}")
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:32]


def _exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def infer_cached(env: Env, folder: str, **options) -> tuple[DataFrame, bool]:
    """(assertions, whether they were kept already). Written beside, then renamed, so a broken run leaves nothing half."""
    spark, path = env.spark, f"{folder.rstrip('/')}/{content_key(env, **options)}"
    if _exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path), True
    result: Result = Engine(env, **options).run()
    result.assertions.write.mode("overwrite").parquet(f"{path}.part")
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.rename(jvm.org.apache.hadoop.fs.Path(f"{path}.part"), jvm.org.apache.hadoop.fs.Path(path))
    return spark.read.parquet(path), False
