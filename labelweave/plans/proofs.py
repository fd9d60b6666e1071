"""Proofs: for asked facts, the steps that lead to them from facts that were given.

A fact's rank is the round that it came in, and whatever it follows from has a lower one. Backward from the asked facts, each level finds the premises of its
facts by the rule that each names: sources of label rules and propagations, and for conditions the facts that made them hold, through composites (of alternatives
one, of all parts each). Where several facts would do, the one of lowest rank is taken, then the smallest by name: so premises are chosen, not pairs listed, and a
look at many (children, siblings, descendants) is a grouping. A fact that serves several is proved once. The steps are written level by level, and there are at most as
many levels as rounds; a level reads the facts once for all of its looks but siblings and comparisons.

Given facts (ground, tags, declarations, availability, k-anonymity, users' texts) have no premises and are leaves. A comparison that held by a default, which
a later fact has replaced, cannot be seen any more: what rests on it alone is a leaf too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave import env as E
from labelweave.operators import closure as closure_of
from labelweave.operators import conditions as C
from labelweave.operators import rules as R
from labelweave.storage import observed, written

#: Ways to a fact that are no rules of an environment: along an edge, and from a framework to the one that it is part of.
ALONG, UP = -1, -2
#: What is kept of a premise; rank first, so that the smallest is the one to take.
PREMISE = ["round", "container", "label", "framework", "derived_via", "derived_from"]
FACT = [*E.KEY, "round", "derived_via", "derived_from"]
#: A way to a fact, and the place in it that a premise fills: sources -1, -2, ...; conditions by their number.
WAY = [*FACT, "alt"]


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _cost() -> Column:
    """The highest rank among premises."""
    return F.coalesce(F.array_max(F.transform("premises", lambda p: p["round"])), F.lit(-1))


class Prover:
    """engine: one that has run; facts: its Result.by_round."""

    def __init__(self, engine, facts: DataFrame):
        self.spark, self.rules, self.batch, self.edges, self.chain = engine.env.spark, engine.rules, engine.rules.conditions, engine.state.edges, engine.chain
        self.frameworks, self.facts, self.sent = engine.env.frameworks, facts, engine._sent
        r = engine.rules
        ways = [(rule, f, target, [source], -1) for source, target, f, rule in r.label_steps] + [(rule, f, target, [source], c) for f, rule, source, target, c in r.conditional]
        ways += [(rule, f, target, list(sources), c) for f, rule, sources, target, c in r.every] + [(rule, f, target, [], c) for f, rule, target, c in r.bare]
        self.ways = [(i, *w, [-1 - k for k in range(len(w[3]))] + ([w[4]] if w[4] >= 0 else [])) for i, w in enumerate(ways)]
        self.looks: dict[str, list[tuple]] = {}  # kind of look: (alt, slot, label)
        self.compared: list[tuple] = []  # alt, slot
        for alt, *_, condition, _ in self.ways:
            for node in self.batch.below({condition}) if condition >= 0 else ():
                c = self.batch.nodes[node]
                if isinstance(c, E.Compare):
                    self.compared.append((alt, node))
                elif not isinstance(c, (E.All, E.Any)):
                    kind = "Self" if isinstance(c, E.Has) else c.relation if isinstance(c, E.Related) else type(c).__name__
                    self.looks.setdefault(kind, []).append((alt, node, c.label))
        labels = {x for w in self.ways for x in w[4]} | {x for rows in self.looks.values() for *_, x in rows} | {x for _, x, _ in r.propagations}
        #: Facts that may be premises of rules, looks, propagations and parts of frameworks.
        self.premises = facts.where(F.col("label").isin(sorted(labels)) | F.col("framework").isin(sorted(engine.above)))
        self.follows = F.col("derived_via").isin(sorted({w[1] for w in self.ways} | {*E.DIRECTIONS, "ParentFramework"}))

    def __call__(self, asked: DataFrame) -> DataFrame:
        """asked: (container, label, scope, framework), all kinds of rows; what is no fact has no proof. Gives (container, label, scope, framework, round, rule, part,
        of_container, of_label, of_framework, of_round): a row for each premise (part, from 0), all in the fact's scope; one row without premise for a leaf."""
        front = self.facts.join(asked.select(*E.KEY).distinct(), E.KEY, "left_semi").select(*FACT)
        known, steps = [], []
        while True:
            level, seen = observed(front, "level", follows=F.count_if(self.follows))
            if not seen["n"] and steps:
                return _union(steps)
            if not seen["follows"]:  # leaves alone: no facts are read
                none = {"part": "int", "of_container": "string", "of_label": "string", "of_framework": "string", "of_round": level.schema["round"].dataType}
                leaves = level.select(*E.KEY, "round", F.col("derived_via").alias("rule"), *(F.lit(None).cast(kind).alias(x) for x, kind in none.items()))
                return _union([*steps, leaves])
            found = written(self._steps(self.sent(level, seen["n"])), "proof")
            steps.append(found.select(*E.KEY, "round", F.col("derived_via").alias("rule"), "part", *(F.col(f"premise.{x}").alias(f"of_{x}") for x in ("container", "label", "framework", "round"))))
            known.append(level.select(*E.KEY))
            front = found.where("premise IS NOT NULL").select("scope", "premise.*").select(*FACT).distinct().join(_union(known), E.KEY, "left_anti")

    # --- one level

    def _steps(self, level: DataFrame) -> DataFrame:
        """The level's facts with their premises (part, premise), both null for leaves."""
        ruled = level.join(R.rule_table(self.spark, [w[:4] for w in self.ways], "alt int, derived_via string, framework string, label string"), ["derived_via", "framework", "label"]).select(*WAY)
        filled = self._filled(self._asks(level, ruled))
        if "Sibling" in self.looks:
            filled = filled.unionByName(self._siblings(ruled))
        for alt, slot in sorted(set(self.compared)):
            filled = filled.unionByName(self._comparison(ruled.where(F.col("alt") == alt), slot))
        for depth in range(1, self.batch.deepest + 1):
            filled = filled.unionByName(self._composed(filled, depth))
        needs = [(ALONG, -1, 1), (UP, -1, 1), *((w[0], slot, len(w[6])) for w in self.ways for slot in w[6])]
        whole = filled.join(R.rule_table(self.spark, needs, "alt int, slot int, needed int"), ["alt", "slot"]).groupBy(*WAY, "needed")
        whole = whole.agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("premises")))).alias("premises")).where("n = needed")
        best = whole.groupBy(*E.KEY).agg(F.min(F.struct(_cost().alias("cost"), F.size("premises").alias("size"), "alt", "premises")).alias("best"))
        return level.join(best, E.KEY, "left").select(*FACT, F.posexplode_outer("best.premises").alias("part", "premise"))

    def _asks(self, level: DataFrame, ruled: DataFrame) -> DataFrame:
        """Places to look for premises: (way, slot, of_container, of_label, of_framework; null: any)."""
        ask = lambda df, slot, container, label, framework: df.select(*WAY, slot.alias("slot"), container.alias("of_container"), label.alias("of_label"), framework.alias("of_framework"))
        c, one, anyone = F.col, F.lit(-1), F.lit(None).cast("string")
        along = level.where(c("derived_via").isin(list(E.DIRECTIONS)) & c("derived_from").isNotNull()).withColumn("alt", F.lit(ALONG))
        up = level.where("derived_via = 'ParentFramework'").withColumn("alt", F.lit(UP))
        parts = self.frameworks.where("sub_framework_of IS NOT NULL").select(c("framework").alias("sub"), c("sub_framework_of").alias("framework")).distinct()
        asks = [ask(along, one, c("derived_from"), c("label"), c("framework")), ask(up.join(F.broadcast(parts), "framework"), one, c("container"), c("label"), c("sub"))]
        sources = [(w[0], -1 - k, source) for w in self.ways for k, source in enumerate(w[4])]
        if sources:
            own = ruled.join(R.rule_table(self.spark, sources, "alt int, slot int, source string"), "alt")
            if self.chain is not None:
                own = own.join(F.broadcast(self.chain), "framework")
            asks.append(ask(own, c("slot"), c("container"), c("source"), anyone if self.chain is None else c("ancestor")))
        for kind, rows in self.looks.items():
            if kind != "Sibling":
                at = ruled.join(R.rule_table(self.spark, rows, "alt int, slot int, of_label string"), "alt")
                asks.append(ask(self._reached(at, kind), c("slot"), c("of_container"), c("of_label"), anyone))
        return _union(asks)

    def _reached(self, at: DataFrame, kind: str) -> DataFrame:
        """Rows with the containers (of_container) that a look from their container meets."""
        e, pair = self.edges, lambda df, a, b: df.select(F.col(a).alias("container"), F.col(b).alias("of_container"))
        inside = lambda df: df.unionByName(df.withColumnRenamed("of_container", "ancestor").join(e.closure, "ancestor").drop("ancestor").withColumnRenamed("descendant", "of_container"))
        if kind == "Self":
            return at.withColumn("of_container", F.col("container"))
        if kind == "Contains":
            return inside(at.withColumn("of_container", F.col("container")))
        if kind == "JoinableTo":
            return inside(at.join(pair(e.joinable, "a", "b"), "container"))
        edges = {"Parent": (e.contains, "child", "parent"), "Child": (e.contains, "parent", "child")}
        edges = edges[kind] if kind in edges else (e.closure, "descendant", "ancestor") if kind == "Ancestor" else (e.closure, "ancestor", "descendant")
        return at.join(pair(*edges), "container")

    def _filled(self, asks: DataFrame) -> DataFrame:
        """Of each slot the premise of lowest rank, below the fact's."""
        there = self.premises.select(*(F.col(x).alias(f"of_{x}") for x in PREMISE), F.col("scope").alias("of_scope"))
        same = (asks["of_container"] == there["of_container"]) & (asks["of_label"] == there["of_label"]) & (asks["scope"] == there["of_scope"]) & (there["of_round"] < asks["round"])
        same &= asks["of_framework"].isNull() | (asks["of_framework"] == there["of_framework"])
        premise = F.struct(*(there[f"of_{x}"].alias(x) for x in PREMISE))
        found = asks.join(there, same).select(*(asks[x] for x in [*WAY, "slot"]), premise.alias("p"))
        return found.groupBy(*WAY, "slot").agg(F.array(F.min("p")).alias("premises"))

    def _siblings(self, ruled: DataFrame) -> DataFrame:
        """The same for siblings: of each parent's children the best premise and the best of another child, so no pairs of siblings are made."""
        asked = R.rule_table(self.spark, self.looks["Sibling"], "alt int, slot int, of_label string")
        rooted = closure_of.with_root(self.edges.contains).select("parent", F.col("child").alias("container"))
        own = self.facts.join(F.broadcast(asked.select(F.col("of_label").alias("label")).distinct()), "label", "left_semi").join(rooted, "container")
        key = ["parent", "label", "scope"]
        child = own.groupBy(*key, "container").agg(F.min(F.struct(*PREMISE)).alias("p"))
        first = child.groupBy(*key).agg(F.min("p").alias("first"))
        other = child.join(first, key).where("container <> first.container").groupBy(*key).agg(F.min("p").alias("other"))
        best = first.join(other, key, "left").withColumnsRenamed({"label": "of_label", "scope": "of_scope"})
        at = ruled.join(asked, "alt").join(rooted, "container").withColumn("of_scope", F.col("scope")).join(best, ["parent", "of_label", "of_scope"])
        at = at.withColumn("p", F.when(F.col("first.container") != F.col("container"), F.col("first")).otherwise(F.col("other"))).where("p.round < round")
        return at.groupBy(*WAY, "slot").agg(F.array(F.min("p")).alias("premises"))

    def _comparison(self, at: DataFrame, slot: int) -> DataFrame:
        """The same for a comparison: the facts whose parameters it compares."""
        c, found = self.batch.nodes[slot], at
        for k, side in enumerate((c.left, c.right, c.upper)):
            rest = F.coalesce(F.lit(side.literal).cast("string"), F.lit(side.default).cast("string")) if side else F.lit(None).cast("string")
            values = self.facts.where(F.col("label") == side.label) if side and side.label else self.facts.limit(0)
            values = values.select(F.col("container").alias("c_"), F.col("scope").alias("s_"), F.struct(*PREMISE).alias(f"p{k}"), F.col("params")[side.param if side and side.param else ""].alias("v_")).where("v_ IS NOT NULL")
            on = (found["container"] == values["c_"]) & (found["scope"] == values["s_"]) & (values[f"p{k}"]["round"] < found["round"])
            found = found.join(values, on, "left").withColumn(f"v{k}", F.coalesce("v_", rest)).drop("c_", "s_", "v_")
        found = found.where(C.compare(F.col("v0"), c.op, F.col("v1"), F.col("v2") if c.upper else None))
        found = found.withColumn("premises", F.array_compact(F.array("p0", "p1", "p2"))).withColumn("slot", F.lit(slot))
        return found.groupBy(*WAY, "slot").agg(F.min(F.struct(_cost().alias("cost"), "premises")).alias("b")).select(*WAY, "slot", "b.premises")

    def _composed(self, filled: DataFrame, depth: int) -> DataFrame:
        """Composites of a depth: all parts' premises, or those of the cheapest part."""
        rows = [(p, i, n, isinstance(self.batch.nodes[p], E.All)) for p, i, n in self.batch.parts(depth)]
        met = filled.join(R.rule_table(self.spark, rows, "parent int, slot int, needed int, every boolean"), "slot").groupBy(*WAY, F.col("parent").alias("slot"), "needed", "every")
        met = met.agg(F.count("*").alias("n"), F.flatten(F.collect_list("premises")).alias("together"), F.min(F.struct(_cost().alias("cost"), "premises")).alias("b")).where("n >= needed")
        return met.select(*WAY, "slot", F.when(F.col("every"), F.col("together")).otherwise(F.col("b.premises")).alias("premises"))
