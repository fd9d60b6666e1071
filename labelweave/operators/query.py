"""Lookups over a fixed point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def query_assertions(a: DataFrame, container: str | None = None, label: str | None = None, scope: str | None = None, framework: str | None = None, is_ground: bool | None = None) -> DataFrame:
    """Facts by any of their parts; filters reach the scan."""
    for name, value in (("container", container), ("label", label), ("scope", scope), ("framework", framework), ("is_ground", is_ground)):
        if value is not None:
            a = a.where(F.col(name) == value)
    return a


def exists(a: DataFrame, container: str, label: str, scope: str, framework: str) -> bool:
    return not query_assertions(a, container, label, scope, framework).limit(1).isEmpty()


def labels_for_container(a: DataFrame, container: str | None = None, scope: str | None = None) -> DataFrame:
    """(container, scope, framework, labels): sorted distinct labels by framework; of all containers and scopes where none is named."""
    return query_assertions(a, container, scope=scope).groupBy("container", "scope", "framework").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def compare_frameworks(a: DataFrame, frameworks: Sequence[str], container: str | None = None, scope: str | None = None) -> DataFrame:
    """(container, scope, label, a boolean per framework)."""
    own = query_assertions(a, container, scope=scope).where(F.col("framework").isin(*frameworks))
    flags = [F.coalesce(F.max(F.when(F.col("framework") == f, F.lit(True))), F.lit(False)).alias(f) for f in frameworks]
    return own.groupBy("container", "scope", "label").agg(*flags)


def differing_labels(a: DataFrame, frameworks: Sequence[str]) -> DataFrame:
    """(container, scope, labels): labels that some but not all of the frameworks give."""
    own = a.where(F.col("framework").isin(*frameworks)).groupBy("container", "scope", "label").agg(F.count_distinct("framework").alias("n"))
    return own.where(F.col("n") < len(frameworks)).groupBy("container", "scope").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def with_label(a: DataFrame, label: str, scope: str, framework: str, chain: DataFrame) -> DataFrame:
    """Containers with the label in the scope under the framework or one that it extends."""
    ups = chain.where(F.col("framework") == framework).select(F.col("ancestor").alias("framework"))
    return query_assertions(a, label=label, scope=scope).join(F.broadcast(ups), "framework", "left_semi").select("container").distinct()


def in_facet(a: DataFrame, label_facets: DataFrame, facet: str) -> DataFrame:
    """Facts whose label belongs to the facet."""
    return a.join(F.broadcast(label_facets.where(F.col("facet") == facet).select("label").distinct()), "label", "left_semi")


def in_scope(avail: DataFrame, scope: str) -> DataFrame:
    return avail.where(F.col("scope") == scope).select("container").distinct()


def is_joinable(joinable: DataFrame, a: str, b: str) -> bool:
    """Either way round."""
    return not joinable.where(((F.col("a") == a) & (F.col("b") == b)) | ((F.col("a") == b) & (F.col("b") == a))).limit(1).isEmpty()


def parameter_index(facts: DataFrame) -> DataFrame:
    """(container, scope, label, param, value) of all facts' parameters."""
    return facts.select("container", "scope", "label", F.explode("params").alias("param", "value")).distinct()


def children(contains: DataFrame) -> DataFrame:
    """(parent, child) in order of child within parent: one row an edge, not a list that grows with the parent."""
    return contains.distinct().repartition("parent").sortWithinPartitions("parent", "child")


def top_new(now: DataFrame, before: DataFrame, n: int = 20) -> DataFrame:
    """The first n of the rows that are new, in order of all columns; rows that stand several times count as often as there are more of them than before. They
    are counted by one pre-aggregated grouping, and a partition keeps no more than its first n rows; only these are repeated."""
    names = now.columns
    both = now.select("*", F.lit(1).alias("_n")).unionByName(before.select(*names, F.lit(-1).alias("_n")))
    more = both.groupBy(*names).agg(F.sum("_n").alias("_n")).where("_n > 0").orderBy(*names).limit(n)
    often = F.sequence(F.lit(1), F.least("_n", F.lit(n)).cast("int"))
    return more.select(*names, F.explode(often).alias("_k")).orderBy(*names).limit(n).drop("_k")


#: The triples that make a fact, and the column of each.
PARTS = (("assertedOn", "container"), ("assertsLabel", "label"), ("assertedInScope", "scope"), ("assertedByFramework", "framework"))


def node_of_fact() -> Column:
    """A fact's subject in triples()."""
    return F.concat_ws("|", "container", "label", "scope", "framework")


def triples(assertions: DataFrame, contains: DataFrame, joinable: DataFrame, avail: DataFrame) -> DataFrame:
    """Everything as (s, p, o)."""
    facts = assertions.select(node_of_fact().alias("s"), F.explode(F.create_map(F.lit("assertedOn"), F.col("container"), F.lit("assertsLabel"), F.col("label"), F.lit("assertedInScope"), F.col("scope"), F.lit("assertedByFramework"), F.col("framework"))).alias("p", "o"))
    edge = lambda df, a, p, b: df.select(F.col(a).alias("s"), F.lit(p).alias("p"), F.col(b).alias("o"))
    out = facts.unionByName(edge(contains, "parent", "contains", "child")).unionByName(edge(joinable, "a", "joinableWith", "b"))
    return out.unionByName(edge(avail, "container", "availableInScope", "scope")).distinct()


def facts_in(triples: DataFrame) -> DataFrame:
    """(container, label, scope, framework) of each subject that has all four."""
    found = triples.where(F.col("p").isin([p for p, _ in PARTS])).groupBy("s").agg(*(F.min(F.when(F.col("p") == p, F.col("o"))).alias(c) for p, c in PARTS))
    return found.dropna().select(*(c for _, c in PARTS)).distinct()
