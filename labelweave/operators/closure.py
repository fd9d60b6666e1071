"""Closures over edge tables, by semi-naive iteration: each round joins only what the last one found."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.storage import drop, observed, written

MAX_ROUNDS = 1000


def grow(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str] | None = None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """The least set that holds seed and step(x) for each x of it; step must be linear. Cycles end, for known rows do not come back."""
    keys = keys or seed.columns
    delta, seen = observed(seed.dropDuplicates(keys), "grown")
    parts, rows = [delta], seen["n"]
    for _ in range(max_rounds):
        known = reduce(DataFrame.unionByName, parts)
        delta, seen = observed(step(delta).select(*seed.columns).dropDuplicates(keys).join(known.select(*keys), keys, "left_anti"), "grown")
        if not seen["n"]:
            drop(delta)
            known._rows = rows  # for callers that ask whether it is small
            return known
        parts, rows = [*parts, delta], rows + seen["n"]
        if len(parts) > 8:  # deep: one table again
            before, parts = parts, [written(known.unionByName(delta))]
            drop(*before[:-1])
    raise RuntimeError(f"no fixed point within {max_rounds} rounds")


#: Rows up to which what a round starts from goes to all executors, so that the edges stay where they are.
SENT_ROWS = 50_000


@dataclass
class Down:
    """Distinct edges (parent, child, again, more), written. again: ways may meet at the child, for it has several parents or is a start itself; more: it has children."""

    edges: DataFrame
    rows: int
    meeting: int

    def drop(self) -> None:
        drop(self.edges)


def down(contains: DataFrame, starts: DataFrame | None = None) -> Down:
    """starts: (container) that a closure begins at, as if they were inside something."""
    one = contains.groupBy("child").agg(F.min("parent").alias("parent"), F.max("parent").alias("_last"), F.count("parent").alias("_named"), F.count(F.lit(1)).alias("_all"))
    several = (F.col("parent") != F.col("_last")) | ((F.col("_named") > 0) & (F.col("_named") < F.col("_all")))
    inner = contains.select(F.col("parent").alias("child")).distinct().withColumn("more", F.lit(True))
    one = one.select("parent", "child", F.coalesce(several, F.lit(False)).alias("several")).join(inner, "child", "left")
    begun = F.lit(False)
    if starts is not None:
        one, begun = one.join(starts.select(F.col("container").alias("child")).distinct().withColumn("_begun", F.lit(True)), "child", "left"), F.coalesce("_begun", F.lit(False))
    one = one.select("parent", "child", "several", (F.col("several") | begun).alias("again"), F.coalesce("more", F.lit(False)).alias("more"))
    edges, seen = observed(one, "edges", several=F.count_if("several"), again=F.count_if("again"))
    if seen["several"]:  # each of their edges has a row
        first, own = edges, contains.join(edges.where("several").select("child", "again", "more"), "child").select("parent", "child", "again", "more").distinct()
        edges, seen = observed(first.where("NOT several").select("parent", "child", "again", "more").unionByName(own), "edges", again=F.count_if("again"))
        drop(first)
    return Down(edges, seen["n"], seen["again"])


def descend(seed: DataFrame, at: str, below: Down, turns: str | None = None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """The least set that holds seed (distinct, with a column `more`) and, of each row, those with a child of `at` in its place. A round meets the edges only from
    rows that have children, and known rows only where ways may meet: elsewhere a row comes once, from the one parent's row, which comes once.
    turns: a column; a row that has the same name in it as in `at` is not followed, for it has come back to where it began."""
    keys = [c for c in seed.columns if c != "more"]
    others = [c for c in keys if c != at]
    small = lambda df, n: F.broadcast(df) if n <= SENT_ROWS else df
    steps = below.edges.select(F.col("parent").alias(at), F.col("child").alias("_next"), "again", "more")
    meet = small(steps.where("again"), below.meeting)
    onward = F.col("more") if turns is None else F.col("more") & F.coalesce(F.col(turns) != F.col(at), F.lit(True))
    delta, seen = observed(seed.select(*keys, "more"), "grown", more=F.count_if("more"))
    parts, rows = [delta], seen["n"]
    for _ in range(max_rounds):
        known = reduce(DataFrame.unionByName, parts).select(*keys)
        if not seen["more"]:
            break
        new = small(delta.where("more").select(*keys), seen["more"])
        move = lambda edges: new.join(edges, at).select(*others, F.col("_next").alias(at), "more").select(*keys, onward.alias("more"))  # noqa: B023, E731
        found = move(steps.where("NOT again"))
        if below.meeting:
            there = known.join(meet.select(F.col("_next").alias(at)).distinct(), at, "left_semi")
            found = found.unionByName(move(meet).dropDuplicates(keys).join(there, keys, "left_anti"))
        delta, seen = observed(found, "grown", more=F.count_if("more"))
        if not seen["n"]:
            drop(delta)
            break
        parts, rows = [*parts, delta], rows + seen["n"]
        if len(parts) > 8:  # deep: one table again
            before, parts = parts, [written(reduce(DataFrame.unionByName, parts))]
            drop(*before[:-1])
    else:
        raise RuntimeError(f"no fixed point within {max_rounds} rounds")
    known._rows = rows  # for callers that ask whether it is small
    known._inner = reduce(DataFrame.unionByName, parts).where("more").select(*keys)  # and for those that look at containers with children alone
    return known


def symmetric(joinable: DataFrame) -> DataFrame:
    """Both directions of (a, b)."""
    return joinable.select("a", "b").unionByName(joinable.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def contains_edges(*edges: DataFrame) -> DataFrame:
    """One (parent, child) set of specialised containment edges; the first two columns of each count."""
    out = None
    for e in edges:
        e = e.select(F.col(e.columns[0]).alias("parent"), F.col(e.columns[1]).alias("child"))
        out = e if out is None else out.unionByName(e)
    return out.distinct()


def ancestors(contains: DataFrame) -> DataFrame:
    """(ancestor, descendant): the transitive closure of (parent, child)."""
    below = down(contains)
    # what is below a container that is inside itself is below it already
    seed = below.edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), (F.col("more") & F.coalesce(F.col("parent") != F.col("child"), F.lit(True))).alias("more"))
    found = descend(seed, "descendant", below, turns="ancestor")
    below.drop()
    return found


def available(availability: DataFrame, contains: DataFrame | Down) -> DataFrame:
    """(container, scope): what is inside an available container is available. contains: edges, or those of down() with availability's containers as starts."""
    below = contains if isinstance(contains, Down) else down(contains, availability)
    inner = below.edges.select(F.col("parent").alias("container")).distinct().withColumn("more", F.lit(True))
    seed = availability.select("container", "scope").distinct().join(inner, "container", "left").select("container", "scope", F.coalesce("more", F.lit(False)).alias("more"))
    found = descend(seed, "container", below)
    if below is not contains:
        below.drop()
    return found


def inside(held: DataFrame, contains: DataFrame) -> DataFrame:
    """What is strictly inside the container of a row of held (distinct: container, ...), with the row's other columns, distinct. Goes down from these containers alone."""
    keys = held.columns
    below = down(contains, held)
    inner = below.edges.select(F.col("parent").alias("container")).distinct().withColumn("more", F.lit(True))
    seed, seen = observed(held.join(inner, "container", "left").select(*keys, F.coalesce("more", F.lit(False)).alias("more")), "held")
    found = descend(seed, "container", below)
    few = lambda df: F.broadcast(df) if seen["n"] <= SENT_ROWS else df
    # rows of held are among those found; they are inside another only if a parent of theirs is found with the same columns
    up = few(seed.select(*keys)).join(below.edges.select(F.col("child").alias("container"), "parent"), "container").withColumnsRenamed({"container": "_own", "parent": "container"})
    again = few(up).join(found, keys).select(*(F.col("_own").alias(c) if c == "container" else F.col(c) for c in keys)).distinct()
    return found.join(few(seed.select(*keys)), keys, "left_anti").unionByName(again)


def framework_chain(frameworks: DataFrame) -> DataFrame:
    """(framework, ancestor): each framework, itself first, and those that it extends."""
    edges = frameworks.where("extends IS NOT NULL").select(F.col("framework").alias("ancestor"), F.col("extends").alias("_next")).distinct()
    seed = frameworks.select("framework", F.col("framework").alias("ancestor"))
    return grow(seed, lambda d: d.join(F.broadcast(edges), "ancestor").select("framework", F.col("_next").alias("ancestor")))  # a vocabulary: bounded


def with_root(contains: DataFrame) -> DataFrame:
    """(parent, child), and containers that nothing contains as children of the empty name."""
    roots = contains.select("parent").distinct().join(contains.select(F.col("child").alias("parent")), "parent", "left_anti").select(F.lit("").alias("parent"), F.col("parent").alias("child"))
    return contains.select("parent", "child").unionByName(roots)


def siblings(contains: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(container, sibling) with a shared parent, of the containers asked for (of: container), or of all; roots are siblings of one another. Pairs: for
    lookups of few containers; propagation and conditions go through the parent instead."""
    contains = with_root(contains)
    own = contains.select("parent", F.col("child").alias("container"))
    if of is not None:
        own = own.join(of.select("container").distinct(), "container", "left_semi")
    other = contains.select("parent", F.col("child").alias("sibling"))
    return own.join(other, "parent").where("container <> sibling").select("container", "sibling").distinct()


def forest(contains: DataFrame, containers: DataFrame, depth: int = 10) -> DataFrame:
    """(container, depth, path): every root and what is below it, to a depth; path joins names by '/'. Names sort siblings."""
    roots = containers.join(contains, containers["container"] == contains["child"], "left_anti").select("container", F.lit(0).alias("depth"), F.col("name").alias("path"))
    edges = contains.select(F.col("parent").alias("container"), "child").join(containers.select(F.col("container").alias("child"), "name"), "child")

    def step(d: DataFrame) -> DataFrame:
        return d.where(F.col("depth") < depth).join(edges, "container").select(F.col("child").alias("container"), (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", "name").alias("path"))

    return grow(roots, step)
