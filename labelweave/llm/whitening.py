"""Whitening of embeddings by TSQR: the covariance is never formed.

Entries become integers on a fixed grid (`on_grid`), so sums are exact whatever the order of the rows, and each row is centred exactly (n*x - S, then one
division by n). Every partition folds its centred rows into one triangular factor by QR, a few hundred rows at a time; the factors are merged by QR of their
stacks, MERGE at a time, level by level; the singular values and right singular vectors of the last factor are those of all centred rows. The
right vectors over the singular values whiten: rows are projected on them, and a last pass measures how far the covariance of the result is from the identity.

Size: a task holds one factor (dim x dim) and one batch; a merge MERGE factors. The driver gets sums (dim numbers), the chosen components (k x dim) and
k x k sums, nothing that grows with the rows.

Defined results: a vector that is null, or holds a null or non-finite entry, has no row; nor has one with an entry whose integer leaves
+-2**62, nor one of another length than the most frequent (of equally frequent ones the longest), for it has no place in the same space. A null vec_id is kept.
Repeated rows count each. `deviation` is null where the exact sum exceeds a long. A component without variance (singular value within rounding of zero) has null
`whitened` values and explains 0. Fewer dimensions than components: as many components as dimensions. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import common

COMPONENTS = 8
#: Factors merged at once, and rows that meet a factor at once.
MERGE, ROWS = 16, 512
LIMIT = 1 << 62


@dataclass
class Model:
    """What whitens: n rows of `sums` (exact, by dimension), the components as rows, and the singular values of the centred rows."""

    n: int
    sums: list[int]
    components: np.ndarray
    singular: np.ndarray
    explained: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.sums)


def on_grid(values: np.ndarray) -> np.ndarray:
    """The grid's integers of doubles, as doubles: steps of 1/1024, moved by 100,000."""
    return np.floor(1024 * values) + 100_000


def _rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, x of these rows as int64) of the usable rows of each length in a batch."""
    column = column.cast(pa.large_list(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()  # entries of null rows are left out
    values = pc.fill_null(flat, math.nan).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        x = on_grid(values)
        fine = np.isfinite(values) & (np.abs(x) < LIMIT)
    at = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
    bad = np.concatenate([[0], np.cumsum(~fine)])
    usable = (lengths >= 0) & (bad[at[1:]] == bad[at[:-1]])
    for length in np.unique(lengths[usable]):
        own = np.flatnonzero(usable & (lengths == length))
        yield int(length), own, x[at[own][:, None] + np.arange(length)].astype(np.int64)


def _largest(x: np.ndarray) -> int:
    return int(np.abs(x).max(initial=0))


def _exact_sum(x: np.ndarray) -> np.ndarray:
    return x.sum(axis=0).astype(object) if _largest(x) * len(x) < LIMIT else x.astype(object).sum(axis=0)


def _apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exactly: int64 where that holds it, else Python's integers."""
    small = n * max(_largest(x), 1) < LIMIT and all(abs(s) < LIMIT for s in sums)
    return x * n - np.array(sums, dtype=np.int64) if small else x.astype(object) * n - np.array(sums, dtype=object)


def _squares(apart: np.ndarray) -> list[int | None]:
    """Row sums of squares, exactly; None above a long."""
    if apart.dtype != object and _largest(apart) ** 2 * apart.shape[1] < LIMIT:
        return (apart * apart).sum(axis=1).tolist()
    found = [sum(v * v for v in row) for row in apart.tolist()]
    return [s if s < 1 << 63 else None for s in found]


def sums(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(dim, pos, n, total): of the vectors of each length how many there are and their exact sums by position; position -1 stands for the length itself."""

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for dim, own, x in _rows(batch.column(0)):
                held = found.setdefault(dim, [0, np.zeros(dim, dtype=object)])
                held[0] += len(own)
                held[1] = held[1] + _exact_sum(x)
        for dim, (n, total) in found.items():
            yield pa.RecordBatch.from_pydict(
                {"dim": [dim] * (dim + 1), "pos": range(-1, dim), "n": [n] * (dim + 1), "total": ["0", *map(str, total)]},
                schema=pa.schema([("dim", pa.int32()), ("pos", pa.int32()), ("n", pa.int64()), ("total", pa.string())]),
            )

    parts = common.arrow(vectors.select(column), run, "dim int, pos int, n long, total string")
    return parts.groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def _fold(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")


def factors(vectors: DataFrame, n: int, total: list[int], column: str = "embedding") -> DataFrame:
    """(node, r): of each partition with rows the triangular factor of its centred rows, as bytes."""
    dim = len(total)

    def run(batches):
        r = None
        for batch in batches:
            for length, _, x in _rows(batch.column(0)):
                if length == dim:
                    centred = (_apart(x, n, total) / n).astype(np.float64)
                    for k in range(0, len(centred), ROWS):
                        r = _fold(r, centred[k : k + ROWS])
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["node", "r"])

    return common.arrow(vectors.select(column), run, "node long, r binary")


def merged(found: DataFrame, dim: int) -> DataFrame:
    """One factor of all: a tree of merges of MERGE nodes each."""

    def merge(few: pd.DataFrame) -> pd.DataFrame:
        r = None
        for node, raw in sorted(zip(few["node"], few["r"])):
            r = _fold(r, np.frombuffer(raw, dtype=np.float64).reshape(-1, dim))
        return pd.DataFrame({"node": [int(few["node"].min()) // MERGE], "r": [r.tobytes()]})

    found = common.written(found, "factors")
    last = found.agg(F.max("node")).first()[0] or 0
    out = found
    while True:
        out = out.groupBy(F.floor(F.col("node") / MERGE).alias("above")).applyInPandas(merge, "node long, r binary")
        last //= MERGE
        if not last:
            return out


def decomposed(factor: DataFrame, dim: int, k: int) -> DataFrame:
    """(component, singular, explained, vector) of the first k right singular vectors of the one factor. Signs: the largest entry is positive."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                _, s, v = np.linalg.svd(np.frombuffer(raw.as_py(), dtype=np.float64).reshape(-1, dim), full_matrices=True)
                s = np.concatenate([s, np.zeros(dim - len(s))])  # fewer rows than dimensions
                s[s <= s[0] * dim * np.finfo(float).eps] = 0
                share = s**2 / max((s**2).sum(), np.finfo(float).tiny)
                v = v[:k] * np.where(v[np.arange(dim), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:k, None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(1, len(v) + 1), pa.int32()), pa.array(s[:k]), pa.array(share[:k]), pa.array(list(v), pa.list_(pa.float64()))],
                    names=["component", "singular", "explained", "vector"],
                )

    return common.arrow(factor.select("r"), run, "component int, singular double, explained double, vector array<double>")


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """None: there is no usable vector of any length but zero."""
    counted = common.written(sums(vectors, column), "sums")
    best = counted.where("pos = -1").orderBy(F.desc("n"), F.desc("dim")).first()
    if best is None or not best["dim"]:
        return None
    dim, n = best["dim"], best["n"]
    total = [int(r["total"]) for r in counted.where((F.col("dim") == dim) & (F.col("pos") >= 0)).orderBy("pos").select("total").collect()]
    parts = decomposed(merged(factors(vectors, n, total, column), dim), dim, components).orderBy("component").collect()
    return Model(n, total, np.array([r["vector"] for r in parts]), np.array([r["singular"] for r in parts]), np.array([r["explained"] for r in parts]))


def _projected(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n*x - S, whitened: NaN for components without variance)."""
    apart = _apart(x, model.n, model.sums)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(model.singular > 0, math.sqrt(model.n) / model.singular, math.nan)
    return apart, (apart / model.n).astype(np.float64) @ model.components.T * scale


def transform(vectors: DataFrame, model: Model, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, deviation, whitened array<double>) of every usable row."""

    def run(batches):
        for batch in batches:
            for dim, own, x in _rows(batch.column(1)):
                if dim == model.dim:
                    apart, white = _projected(model, x)
                    flat = pa.array(white.ravel(), pa.float64(), from_pandas=True)  # NaN: null
                    lists = pa.ListArray.from_arrays(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1], flat)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(_squares(apart), pa.int64()), lists], names=[key, "deviation", "whitened"])

    return common.arrow(vectors.select(F.col(key).cast("long").alias(key), column), run, f"`{key}` long, deviation long, whitened array<double>")


def identity_error(vectors: DataFrame, model: Model, column: str = "embedding") -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over the components that have variance; None without any."""
    used = np.flatnonzero(model.singular > 0)
    k = len(used)

    def run(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for dim, _, x in _rows(batch.column(0)):
                if dim == model.dim:
                    white = _projected(model, x)[1][:, used]
                    first, second = first + white.sum(axis=0), second + white.T @ white
        both = np.vstack([second, first])
        i, j = np.indices(both.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(both.ravel())], names=["i", "j", "v"])

    if not k:
        return None
    both = np.zeros((k + 1, k))
    for i, j, v in common.arrow(vectors.select(column), run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        both[i, j] = v / model.n
    mean = both[k]  # of rows centred beforehand: zero but for rounding
    return float(np.abs(both[:k] - np.outer(mean, mean) - np.eye(k)).max())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = fit(vectors)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = F.array(*(F.lit(float(x)) for x in model.explained))
    rows = transform(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(identity_error(vectors, model)).cast("double").alias("identity_error"),
    )
