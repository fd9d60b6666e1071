"""k-anonymity: signatures of quasi-identifiers, and the smallest cohort of each table and scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.storage import spread

QUASI_IDENTIFIER, ANALYSIS, FRAMEWORK, PARAM = "IndirectIdentifier", "KAnonymityAnalysis", "BaseFramework", "minimumCohortSize"


def signatures(fields: DataFrame, quasi: DataFrame, as_text: bool = True) -> DataFrame:
    """(table, scope, record, signature): name=value of a record's quasi-identifiers, in order of name, joined by semicolons. The text escapes nothing, so
    different records can share it; with as_text=False the signature is the array of (name, value) itself, by which k is counted.

    fields: (field, record, table, name, value); quasi: (container, scope) of fields that are quasi-identifiers. Records without any have no row.
    A record's fields are few, so the list is bounded by the table's width."""
    named = spread(quasi.select(F.col("container").alias("field"), "scope"), "field").distinct()
    own = spread(fields, "field").join(named, "field").where("name IS NOT NULL AND value IS NOT NULL")
    found = spread(own, "table", "scope", "record").groupBy("table", "scope", "record").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("signature"))
    text = F.array_join(F.transform("signature", lambda x: F.concat(x["name"], F.lit("="), x["value"])), ";")
    return found.withColumn("signature", text) if as_text else found


def k_anonymity(signed: DataFrame) -> DataFrame:
    """(table, scope, k): distinct records per signature, of either form, and the least of these. Both groupings pre-aggregate."""
    sizes = signed.groupBy("table", "scope", "signature").agg(F.count_distinct("record").alias("n"))
    return sizes.groupBy("table", "scope").agg(F.min("n").alias("k"))


def as_assertions(k: DataFrame, label: str = ANALYSIS, framework: str = FRAMEWORK) -> DataFrame:
    return k.select(
        F.col("table").alias("container"), F.lit(label).alias("label"), "scope", F.lit(framework).alias("framework"),
        F.create_map(F.lit(PARAM), F.col("k").cast("string")).alias("params"),
    )
