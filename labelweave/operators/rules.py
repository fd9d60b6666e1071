"""Single steps of the rules, as joins. Each gives new facts as (container, label, scope, framework, ...), not yet made distinct against known ones.

Rule tables are vocabularies, at most MAX_RULES rows (checked where they are built), so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RULES = 100_000
AVAILABLE, EXTERNAL = "Available", "ExternalFramework"


def rule_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    if len(rows) > MAX_RULES:
        raise ValueError(f"{len(rows)} rules; at most {MAX_RULES} are broadcast")
    return F.broadcast(spark.createDataFrame(rows, schema))


def labelled(assertions: DataFrame) -> DataFrame:
    """(container, label, scope), whatever the framework."""
    return assertions.select("container", "label", "scope").distinct()


def visibility(avail: DataFrame) -> DataFrame:
    return avail.select("container", F.lit(AVAILABLE).alias("label"), "scope", F.lit(EXTERNAL).alias("framework"))


def _introduced(labels: DataFrame) -> DataFrame:
    """(label, framework). A vocabulary goes to the tags, however many they are of a label: dealt by label, few tasks would get them all."""
    intro = labels.select("label", F.col("introduced_by").alias("framework"))
    return F.broadcast(intro) if labels.limit(MAX_RULES + 1).count() <= MAX_RULES else intro


def tags(tag_table: DataFrame, labels: DataFrame, avail: DataFrame) -> DataFrame:
    """Tagged and available containers have the tag under the framework that introduces it."""
    intro = _introduced(labels)
    return tag_table.join(intro, "label").join(avail, "container").select("container", "label", "scope", "framework").distinct()


def field_declarations(decls: DataFrame, fields: DataFrame, labels: DataFrame, avail: DataFrame) -> DataFrame:
    """Fields carry the labels that their table declares for their name, wherever the table is available."""
    intro = _introduced(labels)
    where = avail.select(F.col("container").alias("table"), "scope")
    found = fields.select(F.col("field").alias("container"), "table", "name").join(decls.select("table", "name", "label").distinct(), ["table", "name"])
    return found.join(intro, "label").join(where, "table").select("container", "label", "scope", "framework").distinct()


def field_tags(tag_table: DataFrame, fields: DataFrame, labels: DataFrame, avail: DataFrame) -> DataFrame:
    """A table carries the tags of its fields (extension)."""
    intro = _introduced(labels)
    own = tag_table.withColumnRenamed("container", "field").join(fields.select("field", "table"), "field")
    return own.select(F.col("table").alias("container"), "label", F.col("field").alias("on_field")).join(intro, "label").join(avail, "container").select("container", "label", "scope", "framework", "on_field").distinct()


def inherit(rules: DataFrame, chain: DataFrame, overrides: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Rules of a framework and of those that it extends. Rules (name in `key`) that a framework overrides stay out of it and of what extends it.

    overrides: (framework, <key>)."""
    columns = rules.columns
    out = rules.withColumnRenamed("framework", "ancestor").join(F.broadcast(chain), "ancestor")
    if overrides is not None:
        # an override by any framework between the rule's own and the heir counts
        between = chain.select("framework", F.col("ancestor").alias("by")).join(overrides.withColumnRenamed("framework", "by"), "by")
        above = chain.select(F.col("framework").alias("by"), "ancestor").where("by <> ancestor")
        blocked = between.join(above, "by").select("framework", "ancestor", key).distinct()
        out = out.join(blocked, ["framework", "ancestor", key], "left_anti")
    return out.select(*columns).distinct()


def effective(rules: DataFrame, chain_depth: DataFrame, key: list[str]) -> DataFrame:
    """Inherited rules where a nearer framework's rule of the same key replaces a farther one's. chain_depth: (framework, ancestor, depth)."""
    found = rules.withColumnRenamed("framework", "ancestor").join(F.broadcast(chain_depth), "ancestor")
    nearest = found.groupBy("framework", *key).agg(F.min("depth").alias("depth"))
    return found.join(nearest, ["framework", *key, "depth"]).select(*rules.columns).distinct()


def _named(has: DataFrame, labels: DataFrame) -> DataFrame:
    """Of has, the labels in the one column of `labels`: a semi-join, which Spark moves below what makes `has` distinct, so other labels are neither grouped nor shuffled."""
    return has.join(F.broadcast(labels.toDF("label").distinct()), "label", "left_semi")


def subclass(has: DataFrame, rules: DataFrame) -> DataFrame:
    """has: (container, label, scope); rules: (framework, source, target, rule)."""
    has = _named(has, rules.select("source"))
    return has.join(rules, has["label"] == rules["source"]).select("container", F.col("target").alias("label"), "scope", "framework", "rule")


def implication(has: DataFrame, rules: DataFrame, holds: DataFrame | None = None) -> DataFrame:
    """rules: (framework, rule, source, target[, condition]); holds: (condition, container, scope)."""
    found = _named(has, rules.select("source")).withColumnRenamed("label", "source").join(rules, "source")
    if holds is not None:
        found = found.join(holds, ["condition", "container", "scope"], "left_semi")
    return found.select("container", F.col("target").alias("label"), "scope", "framework", "rule")


def implication_all(has: DataFrame, rules: DataFrame, holds: DataFrame | None = None) -> DataFrame:
    """rules: (framework, rule, sources array, target[, condition]): all sources on one container in one scope (relational division)."""
    need = rules.withColumn("sources", F.array_distinct("sources"))
    parts = need.select("rule", F.size("sources").alias("n"), F.explode("sources").alias("label")).distinct()
    own = _named(has.select("container", "label", "scope").distinct(), parts.select("label"))
    full = own.join(F.broadcast(parts), "label").groupBy("rule", "n", "container", "scope").agg(F.count_distinct("label").alias("k")).where("k = n")
    found = full.select("rule", "container", "scope").join(F.broadcast(need.drop("sources")), "rule")
    if holds is not None:
        found = found.join(holds, ["condition", "container", "scope"], "left_semi")
    return found.select("container", F.col("target").alias("label"), "scope", "framework", "rule")


def _moves(assertions: DataFrame, rules: DataFrame, direction: str) -> DataFrame:
    own = rules.where(F.col("direction") == direction).select("framework", "label")
    return assertions.join(F.broadcast(own), ["framework", "label"])


def _extra(assertions: DataFrame) -> list[Column]:
    return [F.col("params")] if "params" in assertions.columns else []


def _landed(found: DataFrame, avail: DataFrame | None, assertions: DataFrame) -> DataFrame:
    found = found.select("container", "label", "scope", "framework", *_extra(assertions), "source")
    return found if avail is None else found.join(avail, ["container", "scope"], "left_semi")


def propagate_inward(assertions: DataFrame, rules: DataFrame, contains: DataFrame, avail: DataFrame | None = None) -> DataFrame:
    edges = contains.select(F.col("parent").alias("source"), F.col("child").alias("container"))
    return _landed(_moves(assertions, rules, "Inward").withColumnRenamed("container", "source").join(edges, "source"), avail, assertions)


def propagate_outward(assertions: DataFrame, rules: DataFrame, contains: DataFrame, avail: DataFrame | None = None) -> DataFrame:
    edges = contains.select(F.col("child").alias("source"), F.col("parent").alias("container"))
    return _landed(_moves(assertions, rules, "Outward").withColumnRenamed("container", "source").join(edges, "source"), avail, assertions)


def propagate_peer(assertions: DataFrame, rules: DataFrame, contains: DataFrame, avail: DataFrame | None = None) -> DataFrame:
    """Through the parent: labels of a parent's children, made distinct there, go to all its children. No pairs of siblings: one that has
    the label already gains nothing, so the source need not differ from the target."""
    up = contains.select(F.col("child").alias("source"), "parent")
    at_parent = _moves(assertions, rules, "Peer").withColumnRenamed("container", "source").join(up, "source")
    keys = ["parent", "label", "scope", "framework"]
    one = [F.min_by("params", "source").alias("params")] if "params" in assertions.columns else []
    at_parent = at_parent.groupBy(*keys).agg(F.min("source").alias("source"), *one)
    return _landed(at_parent.join(contains.select("parent", F.col("child").alias("container")), "parent"), avail, assertions)


def propagate_joinable(assertions: DataFrame, rules: DataFrame, joinable: DataFrame, avail: DataFrame | None = None) -> DataFrame:
    """joinable: (a, b) in both directions."""
    edges = joinable.select(F.col("a").alias("source"), F.col("b").alias("container"))
    return _landed(_moves(assertions, rules, "Joinable").withColumnRenamed("container", "source").join(edges, "source"), avail, assertions)


def parent_framework(assertions: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Facts of a sub-framework hold in its parent too: one level, for facts that this rule itself has made stay out (is_parent)."""
    up = frameworks.where("sub_framework_of IS NOT NULL").select("framework", F.col("sub_framework_of").alias("parent_framework")).distinct()
    own = assertions.where("NOT coalesce(derived_via = 'ParentFramework', false)") if "derived_via" in assertions.columns else assertions
    return own.join(F.broadcast(up), "framework").select("container", "label", "scope", F.col("parent_framework").alias("framework"), *_extra(assertions))


def containment(assertions: DataFrame, closure: DataFrame, avail: DataFrame, needed: DataFrame | None = None) -> DataFrame:
    """(container, label, scope, framework): the container itself or something inside it has the label; only labels asked for (needed)."""
    own = assertions.select("container", "label", "scope", "framework").distinct()
    if needed is not None:
        own = own.join(F.broadcast(needed.select("label").distinct()), "label", "left_semi")
    up = own.join(closure.select(F.col("descendant").alias("container"), "ancestor"), "container").select(F.col("ancestor").alias("container"), "label", "scope", "framework")
    return own.unionByName(up).distinct().join(avail, ["container", "scope"], "left_semi")
