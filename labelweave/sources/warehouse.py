"""An environment projected from order-management tables: regions hold nations, nations customers and suppliers, customers orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave import env as E

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
LABELS = [
    *((f"Seg_{s}", "base") for s in SEGMENTS), *((f"Status_{s}", "base") for s in "FOP"), ("Trade", "base"), ("Trade", "strict"), ("Risky", "stat"), ("Debt", "strict"), ("Debt", "stat_sub"), ("Quasi", "base"),
]
FACETS = [*((f"Seg_{s}", "Segment") for s in SEGMENTS), ("Trade", "Domain"), ("Debt", "Control"), ("Risky", "Control")]
FRAMEWORKS = [("base", None, None, "core"), ("strict", "base", None, "privacy"), ("deep", "strict", None, "privacy"), ("stat", None, None, "privacy"), ("stat_sub", None, "stat", "custom")]
PROPAGATIONS = (
    E.Propagation("base", "Inward", label="Trade"), E.Propagation("strict", "Outward", label="Debt"), E.Propagation("stat", "Joinable", label="Risky"),
    E.Propagation("base", "Peer", label="Seg_BUILDING"), E.Propagation("stat_sub", "Outward", facet="Control"), E.Propagation("base", "Inward", facet="Domain"),
)
SUBCLASSES = (
    E.Subclass("base", tuple(f"Seg_{s}" for s in SEGMENTS), "Segmented", "segmented"), E.Subclass("base", ("Debt",), "Financial", "debt"),
    E.Subclass("strict", ("Financial",), "Sensitive", "sensitive"), E.Subclass("base", ("Sensitive",), "Reviewed", "reviewed"), E.Subclass("base", ("Reviewed",), "Filed", "filed"),
)
QUASI = ("segment", "band")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    region, nation, customer, supplier, orders = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "orders"))
    pairs = [
        nation.select(_id("R", "n_regionkey").alias("parent"), _id("N", "n_nationkey").alias("child")),
        customer.select(_id("N", "c_nationkey").alias("parent"), _id("C", "c_custkey").alias("child")),
        supplier.select(_id("N", "s_nationkey").alias("parent"), _id("S", "s_suppkey").alias("child")),
        orders.select(_id("C", "o_custkey").alias("parent"), _id("O", "o_orderkey").alias("child")),
    ]
    named = [
        region.select(_id("R", "r_regionkey").alias("container"), F.lit("database").alias("kind"), F.col("r_name").alias("name")),
        nation.select(_id("N", "n_nationkey").alias("container"), F.lit("table").alias("kind"), F.col("n_name").alias("name")),
        customer.select(_id("C", "c_custkey").alias("container"), F.lit("record").alias("kind"), F.col("c_name").alias("name")),
        supplier.select(_id("S", "s_suppkey").alias("container"), F.lit("record").alias("kind"), F.col("s_name").alias("name")),
        orders.select(_id("O", "o_orderkey").alias("container"), F.lit("field").alias("kind"), _id("order ", "o_orderkey").alias("name")),
    ]
    tagged = [
        customer.select(_id("C", "c_custkey").alias("container"), F.concat(F.lit("Seg_"), "c_mktsegment").alias("label")),
        customer.where("c_acctbal < 0").select(_id("C", "c_custkey").alias("container"), F.lit("Debt").alias("label")),
        orders.select(_id("O", "o_orderkey").alias("container"), F.concat(F.lit("Status_"), "o_orderstatus").alias("label")),
        supplier.where("s_acctbal < 0").select(_id("S", "s_suppkey").alias("container"), F.lit("Risky").alias("label")),
        nation.where("n_regionkey <> 1").select(_id("N", "n_nationkey").alias("container"), F.lit("Trade").alias("label")),
    ]
    first = supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("first"))
    joined = supplier.join(F.broadcast(first), "s_nationkey").where("s_suppkey <> first")  # a row per nation
    cells = customer.select(
        _id("C", "c_custkey").alias("record"), _id("N", "c_nationkey").alias("table"),
        F.explode(F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("band"), F.floor(F.col("c_acctbal") / 2000).cast("string"))).alias("name", "value"),
    )
    union = lambda frames: __import__("functools").reduce(DataFrame.unionByName, frames)
    return {
        "containers": union(named),
        "contains": union(pairs),
        "availability": region.select(_id("R", "r_regionkey").alias("container"), _id("G", "r_regionkey").alias("scope")).unionByName(
            nation.where("n_regionkey = 2").select(_id("N", "n_nationkey").alias("container"), F.lit("ALL").alias("scope"))
        ),
        "joinable": joined.select(_id("S", "first").alias("a"), _id("S", "s_suppkey").alias("b")),
        "tags": union(tagged),
        "fields": cells.select(F.concat("record", F.lit("."), "name").alias("field"), "record", "table", "name", "value", F.lit("string").alias("datatype")),
        "field_decls": nation.select(_id("N", "n_nationkey").alias("table"), F.explode(F.array(*map(F.lit, QUASI))).alias("name"), F.lit("Quasi").alias("label")),
        "labels": spark.createDataFrame(LABELS, E.SCHEMAS["labels"]),
        "label_facets": spark.createDataFrame(FACETS, E.SCHEMAS["label_facets"]),
        "frameworks": spark.createDataFrame(FRAMEWORKS, E.SCHEMAS["frameworks"]),
    }


def environment(spark: SparkSession, sf_dir: str, lines: bool = False) -> E.Env:
    """lines: orders hold their line items, and those that came back are tagged."""
    found = tables(spark, sf_dir)
    if lines:
        line = read(spark, sf_dir, "lineitem").select(
            _id("O", "l_orderkey").alias("parent"), F.concat(_id("L", "l_orderkey"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("child"), "l_returnflag"
        )
        found["contains"] = found["contains"].unionByName(line.select("parent", "child"))
        found["containers"] = found["containers"].unionByName(line.select(F.col("child").alias("container"), F.lit("cell").alias("kind"), F.col("child").alias("name")))
        found["tags"] = found["tags"].unionByName(line.where("l_returnflag = 'R'").select(F.col("child").alias("container"), F.lit("Returned").alias("label")))
        found["labels"] = found["labels"].unionByName(spark.createDataFrame([("Returned", "strict")], E.SCHEMAS["labels"]))
    return E.Env(spark, found, E.Rules(propagations=PROPAGATIONS, subclasses=SUBCLASSES))
