"""Rules with conditions or several sources, by demand and by change.

Demand: a condition matters only where its rule's sources are. These places are marks (condition, container, scope), passed on to the parts of composite
conditions; nothing is looked up elsewhere. Conditions of rules without a source matter everywhere and have no marks.

Change: what was found to hold is kept. Facts that came since the last time are looked at from every mark, new marks at all facts; a composite is counted again only
where one of its parts, or its mark, is new. A rule is asked again only for new sources, newly held conditions, and places where one of several sources is new.
So a round reads what changed, beside the kept rows that it meets by key.

Facts that are taken back (plans/retract.py) take back what was found through them: `forget`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.operators import rules as R
from labelweave.operators.conditions import Batch, Edges
from labelweave.plans.compile import Compiled
from labelweave.storage import Kept

MARK = ["condition", "container", "scope"]
MARKS = "condition int, container string, scope string"
_EVERY = "framework string, rule string, sources array<string>, target string, condition int"


def union(frames) -> DataFrame | None:
    out = None
    for x in frames:
        if x is not None:
            out = x if out is None else out.unionByName(x)
    return out


def less(df: DataFrame, known: DataFrame | None, keys: list[str]) -> DataFrame:
    return df if known is None else df.join(known.select(*keys), keys, "left_anti")


class Conditional:
    """seen: facts with the rules that they trigger, under the engine's visibility."""

    def __init__(self, spark, rules: Compiled, edges: Edges, seen: Callable[[DataFrame, DataFrame], DataFrame], chained: bool):
        self.spark, self.rules, self.edges, self.seen, self.chained = spark, rules, edges, seen, chained
        self.batch: Batch = rules.conditions
        self.free = self.batch.below({x[3] for x in rules.bare})
        roots = {x[4] for x in [*rules.conditional, *rules.every] if x[4] >= 0}
        self.marked = self.batch.below(roots - self.free) - self.free
        self.marks, self.holds = Kept("marks"), Kept("holds")
        self.again: DataFrame | None = None
        self.started = False

    @property
    def idle(self) -> bool:
        """No such rules at all."""
        return not (self.rules.conditional or self.rules.every or self.rules.bare)

    # --- what is asked for

    def _roots(self, facts: DataFrame, delta: DataFrame) -> DataFrame | None:
        rows = sorted({(x[2], x[4], x[0]) for x in self.rules.conditional if x[4] in self.marked})
        single = self.seen(delta, R.rule_table(self.spark, rows, "source string, condition int, framework string")).select(*MARK) if rows else None
        every = [x for x in self.rules.every if x[4] in self.marked]
        return union([single, self._complete(facts, delta, every).select(*MARK) if every else None])

    def _asked(self, facts: DataFrame, delta: DataFrame) -> DataFrame | None:
        """New marks, of all depths."""
        roots = self._roots(facts, delta)
        if roots is None:
            return None
        out = roots.distinct()
        for depth in range(self.batch.deepest, 0, -1):
            if parts := self.batch.parts(depth, self.marked):
                down = out.withColumnRenamed("condition", "parent").join(R.rule_table(self.spark, [p for p in parts if p[1] in self.marked], "parent int, condition int, n int"), "parent")
                out = out.unionByName(down.select(*MARK))
        return less(out.distinct(), self.marks.table, MARK)

    # --- what holds

    def _compared(self, facts: DataFrame, delta: DataFrame, new_marks: DataFrame | None) -> DataFrame | None:
        named = sorted(set().union(*([o.label for o in (c.left, c.right, c.upper) if o and o.label] for c in self.batch.comparing()))) if self.batch.comparing() else []
        touched = delta.where(F.col("label").isin(named)).select("container", "scope")
        free = self.batch.comparisons(facts, self.edges, touched if self.started else self.edges.avail, self.free)
        at_marks = None
        if self.marked and self.marks.table is not None:
            places = union([self.marks.table.join(touched.distinct(), ["container", "scope"], "left_semi"), new_marks])
            at_marks = self.batch.comparisons(facts, self.edges, places, self.marked, marked=True)
        return union([free, at_marks])

    def _found(self, facts: DataFrame, delta: DataFrame, new_marks: DataFrame | None) -> DataFrame | None:
        """New rows of what holds."""
        found = [self.batch.leaves(delta, self.edges, self.free), self._compared(facts, delta, new_marks)]
        if self.marked and self.marks.table is not None:
            found.append(self.batch.leaves(delta, self.edges, self.marked, self.marks.table))
            if new_marks is not None and self.started:  # the first time all facts are new
                found.append(self.batch.leaves(facts, self.edges, self.marked, new_marks))
        if self.again is not None:
            found += [self.batch.leaves(facts, self.edges, self.free, self.again), self.batch.comparisons(facts, self.edges, self.again, self.free, marked=True)]
        new = union(found)
        if new is None:
            return None
        new = less(new.distinct(), self.holds.table, MARK)
        for depth in range(1, self.batch.deepest + 1):
            rows = self.batch.parts(depth)
            if not rows:
                continue
            parts = R.rule_table(self.spark, rows, "parent int, condition int, n int")
            own = sorted({r[0] for r in rows})
            touched = new.join(parts, "condition").select(F.col("parent").alias("condition"), "container", "scope")
            if self.marked and self.marks.table is not None:
                mine = [i for i in own if i in self.marked]
                asked = touched.where(F.col("condition").isin(mine)).join(self.marks.table, MARK, "left_semi")
                touched = union([touched.where(~F.col("condition").isin(mine)), asked, new_marks.where(F.col("condition").isin(mine)) if new_marks is not None else None])
            if self.again is not None:
                touched = touched.unionByName(self.again.where(F.col("condition").isin(own)))
            touched = touched.distinct()
            kept = union([new, self.holds.table])
            met = kept.join(parts, "condition").join(touched.withColumnRenamed("condition", "parent"), ["parent", "container", "scope"], "left_semi")
            met = met.groupBy("parent", "n", "container", "scope").agg(F.count_distinct("condition").alias("k")).where("k >= n")
            new = new.unionByName(less(met.select(F.col("parent").alias("condition"), "container", "scope"), self.holds.table, MARK))
        return new

    # --- what follows

    def _complete(self, facts: DataFrame, delta: DataFrame, rows: list[tuple], more: DataFrame | None = None) -> DataFrame:
        """(rule, framework, container, scope, target, condition) where all sources of a rule are, at places that the delta touched (and more: container, scope)."""
        table = R.rule_table(self.spark, rows, _EVERY)
        sources = sorted({s for x in rows for s in x[2]})
        at = union([delta.where(F.col("label").isin(sources)).select("container", "scope"), more]).distinct()
        own = facts.where(F.col("label").isin(sources)).join(at, ["container", "scope"], "left_semi")
        parts = self.seen(own, F.broadcast(table.select("framework", "rule", F.explode("sources").alias("source"))))
        full = parts.groupBy("rule", "framework", "container", "scope").agg(F.count_distinct("source").alias("k"))
        return full.join(table, ["rule", "framework"]).where(F.col("k") == F.size("sources")).select("rule", "framework", "container", "scope", "target", "condition")

    def round(self, facts: DataFrame, delta: DataFrame) -> DataFrame:
        """(container, label, scope, framework, rule): what follows now that delta is among the facts."""
        rules, new = self.rules, None
        if self.batch.nodes:
            asked = self._asked(facts, delta) if self.marked else None
            new_marks = union([self.marks.add(asked) if asked is not None else None, self._again_marks()])
            found = self._found(facts, delta, new_marks)
            new = self.holds.add(found) if found is not None else None
        out = []
        shape = ["container", F.col("target").alias("label"), "scope", "framework", "rule"]
        if rules.conditional and self.holds.table is not None:
            table = R.rule_table(self.spark, rules.conditional, "framework string, rule string, source string, target string, condition int")
            out.append(self.seen(delta, table).join(self.holds.table, MARK, "left_semi").select(*shape))
            if new is not None and self.started:
                near = facts.join(new.select("container", "scope").distinct(), ["container", "scope"], "left_semi")
                out.append(self.seen(near, table).join(new, MARK, "left_semi").select(*shape))
        if plain := [x for x in rules.every if x[4] < 0]:
            out.append(self._complete(facts, delta, plain).select(*shape))
        if (held := [x for x in rules.every if x[4] >= 0]) and self.holds.table is not None:
            more = new.select("container", "scope") if new is not None and self.started else None
            out.append(self._complete(facts, delta, held, more).join(self.holds.table, MARK, "left_semi").select(*shape))
        if rules.bare and new is not None:
            table = R.rule_table(self.spark, rules.bare, "framework string, rule string, target string, condition int")
            out.append(new.join(table, "condition").join(self.edges.avail, ["container", "scope"], "left_semi").select(*shape))
        self.started, self.again = True, None
        found = union(out)
        return found if found is not None else self.spark.createDataFrame([], "container string, label string, scope string, framework string, rule string")

    def _again_marks(self) -> DataFrame | None:
        """Marks under which something was taken back: to be looked from once more."""
        if self.again is None or not self.marked or self.marks.table is None:
            return None
        return self.marks.table.join(self.again, MARK, "left_semi")

    # --- what no longer follows

    def touched(self, frontier: DataFrame) -> DataFrame | None:
        """(condition, container, scope): where these facts may have made a condition hold, composites by any of their parts."""
        if not self.batch.nodes:
            return None
        found = self.batch.leaves(frontier, self.edges)
        compared = [
            frontier.where(F.col("label").isin([o.label for o in (c.left, c.right, c.upper) if o and o.label])).select(F.lit(self.batch.of[c]).alias("condition"), "container", "scope") for c in self.batch.comparing()
        ]
        found = union([found, *compared])
        for depth in range(1, self.batch.deepest + 1):
            parts = R.rule_table(self.spark, self.batch.parts(depth), "parent int, condition int, n int")
            found = found.unionByName(found.join(parts, "condition").select(F.col("parent").alias("condition"), "container", "scope"))
        return found.distinct()

    def dependents(self, frontier: DataFrame, touched: DataFrame | None) -> DataFrame | None:
        """(container, label, scope, framework) that one of the rules may have given from these facts, or from conditions touched by them."""
        rules, out = self.rules, []
        shape = ["container", F.col("target").alias("label"), "scope", "framework"]
        if rules.conditional:
            table = R.rule_table(self.spark, rules.conditional, "framework string, rule string, source string, target string, condition int")
            out += [self.seen(frontier, table).select(*shape), touched.join(table, "condition").select(*shape)]
        if rules.every:
            table = R.rule_table(self.spark, rules.every, _EVERY)
            out.append(self.seen(frontier, table.select("framework", "target", F.explode("sources").alias("source"))).select(*shape))
            if touched is not None:
                out.append(touched.join(table.where("condition >= 0"), "condition").select(*shape))
        if rules.bare:
            table = R.rule_table(self.spark, rules.bare, "framework string, rule string, target string, condition int")
            out.append(touched.join(table, "condition").select(*shape))
        return union(out)

    def forget(self, touched: DataFrame | None) -> None:
        """Nothing is held any more where a condition was touched; the next round looks there again."""
        if touched is None or self.holds.table is None:
            return
        self.holds.replace(self.holds.table.join(touched, MARK, "left_anti"))
        self.again = touched

    def drop(self) -> None:
        self.marks.drop()
        self.holds.drop()
