"""Conditions, evaluated bottom-up: each node of a tree becomes one DataFrame (container, scope) of where it holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.env import All, Any, Compare, Contains, Has, JoinableTo, Operand, Related, labels_in
from labelweave.operators import closure as closure_of
from labelweave.operators import rules as R


def related(has: DataFrame, relation: str, contains: DataFrame, closure: DataFrame) -> DataFrame:
    """(container, label, scope) for each label that a container in the relation has. Siblings share a parent, or are both roots. Without a closure, ancestors
    are looked at by going down from the labelled containers alone."""
    pick = lambda edges, theirs, ours: has.withColumnRenamed("container", "other").join(edges.select(F.col(theirs).alias("other"), F.col(ours).alias("container")), "other")
    if relation == "Self":
        return has.select("container", "label", "scope")
    if relation == "Parent":
        found = pick(contains, "parent", "child")
    elif relation == "Child":
        found = pick(contains, "child", "parent")
    elif relation == "Ancestor":
        if closure is None:
            return closure_of.inside(has.select("container", "label", "scope").distinct(), contains)
        found = pick(closure, "ancestor", "descendant")
    elif relation == "Descendant":
        found = pick(closure, "descendant", "ancestor")
    else:
        # per parent and label: who has it, or that several do; no pairs
        contains = closure_of.with_root(contains)
        at = has.join(contains.withColumnRenamed("child", "container"), "container").groupBy("parent", "label", "scope").agg(F.min("container").alias("lo"), F.max("container").alias("hi"))
        found = at.join(contains.withColumnRenamed("child", "container"), "parent").where("lo <> hi OR lo <> container")
    return found.select("container", "label", "scope").distinct()


def compare(left: Column, op: str, right: Column, upper: Column | None = None) -> Column:
    """Of strings: as numbers where both sides are numbers, else as text for (in)equality alone; anything else is false."""
    a, b = left.try_cast("double"), right.try_cast("double")
    both = a.isNotNull() & b.isNotNull()
    if op == "inRange":
        c = upper.try_cast("double")
        return F.coalesce((a >= b) & (a <= c), F.lit(False))
    if op in ("==", "!="):
        same = F.when(both, a == b).otherwise(left == right)
        return F.coalesce(same if op == "==" else ~same, F.lit(False))
    order = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return F.coalesce(both & order, F.lit(False))


class Edges:
    """What conditions look along; the closure is worked out when one looks along it."""

    def __init__(self, avail: DataFrame, contains: DataFrame, joinable: DataFrame, closure: Callable[[], DataFrame]):
        self.avail, self.contains, self.joinable, self._closure = avail, contains, joinable, closure

    @property
    def closure(self) -> DataFrame:
        return self._closure()


class Evaluator:
    """Where conditions hold, given facts (container, label, scope[, params]). closure: all of it, or what works it out once a condition needs all of it."""

    def __init__(self, facts: DataFrame, avail: DataFrame, contains: DataFrame, closure: DataFrame | Callable[[], DataFrame] | None, joinable: DataFrame):
        self.facts, self.has = facts, facts.select("container", "label", "scope").distinct()
        self.avail, self.contains, self._closure, self.joinable = avail, contains, closure, joinable
        self._known: dict = {}

    @property
    def closure(self) -> DataFrame:
        return self._closure() if callable(self._closure) else self._closure

    def __call__(self, condition) -> DataFrame:
        if condition not in self._known:
            self._known[condition] = self._evaluate(condition).select("container", "scope").distinct()
        return self._known[condition]

    def _evaluate(self, c) -> DataFrame:
        if isinstance(c, Has):
            return self.has.where(F.col("label") == c.label)
        if isinstance(c, Related):
            needed = c.relation == "Descendant" or c.relation == "Ancestor" and not callable(self._closure)
            return related(self.has.where(F.col("label") == c.label), c.relation, self.contains, self.closure if needed else None)
        if isinstance(c, Contains):
            return self._contains(c.label)
        if isinstance(c, JoinableTo):
            inside = self._contains(c.label).withColumnRenamed("container", "b")
            return inside.join(self.joinable, "b").select(F.col("a").alias("container"), "scope")
        if isinstance(c, Any):
            return self._union([self(p) for p in c.parts])
        if isinstance(c, All):
            parts = list(dict.fromkeys(c.parts))
            each = self._union([self(p).withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
            return each.groupBy("container", "scope").agg(F.count_distinct("part").alias("n")).where(F.col("n") == len(parts))
        if isinstance(c, Compare):
            found = self.avail
            for k, side in enumerate((c.left, c.right, c.upper)):
                if side is not None:
                    found = self._value(found, side, f"_{k}")
            return found.where(compare(F.col("_0"), c.op, F.col("_1"), F.col("_2") if c.upper else None))
        raise TypeError(f"no condition: {c!r}")

    def _contains(self, label: str) -> DataFrame:
        own = self.has.where(F.col("label") == label).select("container", "scope")
        up = own.join(self.closure.select(F.col("descendant").alias("container"), "ancestor"), "container").select(F.col("ancestor").alias("container"), "scope")
        return own.unionByName(up).distinct().join(self.avail, ["container", "scope"], "left_semi")

    def _value(self, found: DataFrame, side: Operand, name: str) -> DataFrame:
        rest = F.coalesce(F.lit(side.literal).cast("string"), F.lit(side.default).cast("string"))
        if not side.label:
            return found.withColumn(name, rest)
        values = self.facts.where(F.col("label") == side.label).select("container", "scope", F.col("params")[side.param].alias("_v")).where("_v IS NOT NULL").distinct()
        return found.join(values, ["container", "scope"], "left").withColumn(name, F.coalesce("_v", rest)).drop("_v")

    @staticmethod
    def _union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out


class Batch:
    """All conditions of a rule set at once: leaves of a kind share one join, composites of a depth one grouping, so the plan's size does
    not follow the number of rules. Distinct nodes of all trees are numbered; `of` gives a condition's number."""

    def __init__(self, wanted: list):
        self.of: dict = {}
        self.depth: dict[int, int] = {}
        for c in wanted:
            self._number(c)
        self.nodes = {i: c for c, i in self.of.items()}

    def _number(self, c) -> int:
        if c not in self.of:
            depth = 1 + max((self.depth[self._number(p)] for p in c.parts), default=-1) if isinstance(c, (All, Any)) else 0
            self.of[c] = len(self.of)
            self.depth[self.of[c]] = depth
        return self.of[c]

    @property
    def over_closure(self) -> bool:
        """Some condition looks at ancestors or descendants."""
        return any(isinstance(c, (Contains, JoinableTo)) or isinstance(c, Related) and c.relation in ("Ancestor", "Descendant") for c in self.nodes.values())

    def labels(self) -> set[str]:
        return {x for c in self.nodes.values() if not isinstance(c, (All, Any)) for x in labels_in(c)}

    def comparing(self) -> list[Compare]:
        return [c for c in self.nodes.values() if isinstance(c, Compare)]

    def below(self, numbers) -> set[int]:
        """The nodes of these trees."""
        out: set[int] = set()
        for i in numbers:
            out |= {i} | self.below(self.of[p] for p in self.nodes[i].parts) if isinstance(self.nodes[i], (All, Any)) else {i}
        return out

    def parts(self, depth: int, nodes: set[int] | None = None) -> list[tuple[int, int, int]]:
        """(parent, condition, how many parts it takes) of the composites of a depth."""
        return [
            (i, self.of[p], len(set(c.parts)) if isinstance(c, All) else 1)
            for i, c in self.nodes.items() if self.depth[i] == depth and depth and (nodes is None or i in nodes) for p in dict.fromkeys(c.parts)
        ]

    @property
    def deepest(self) -> int:
        return max(self.depth.values(), default=0)

    def leaves(self, facts: DataFrame, edges: Edges, nodes: set[int] | None = None, marks: DataFrame | None = None) -> DataFrame | None:
        """(condition, container, scope) of leaves but comparisons, of all or of these nodes, so far as these facts go; a union of facts gives the union of the
        rows. marks (condition, container, scope) says where they are asked for: looks up (at the container itself, its parent, ancestors, siblings, what it joins) start
        from the marks and meet the facts there; looks down start from the labelled facts, for what is inside a container is many, and end at the marks."""
        has = facts.select("container", "label", "scope").distinct()
        kinds: dict[str, list[tuple[int, str]]] = {}
        for i, c in self.nodes.items():
            if (nodes is None or i in nodes) and not isinstance(c, (All, Any, Compare)):
                kind = "Self" if isinstance(c, Has) else c.relation if isinstance(c, Related) else type(c).__name__
                kinds.setdefault(kind, []).append((i, c.label))
        out = None
        for kind, rows in kinds.items():
            asked = R.rule_table(has.sparkSession, rows, "condition int, label string")
            own = has.join(F.broadcast(asked.select("label").distinct()), "label", "left_semi")
            if marks is None:
                found = self._looked(own, kind, edges).join(asked, "label")
            else:
                found = self._looked_from(marks.join(asked, "condition"), own, kind, edges)
            found = found.select("condition", "container", "scope")
            out = found if out is None else out.unionByName(found)
        return out if out is None else out.distinct()

    @staticmethod
    def _inside(own: DataFrame, edges: Edges) -> DataFrame:
        up = own.join(edges.closure.select(F.col("descendant").alias("container"), "ancestor"), "container").select(F.col("ancestor").alias("container"), "label", "scope")
        return own.select("container", "label", "scope").unionByName(up).distinct().join(edges.avail, ["container", "scope"], "left_semi")

    def _looked(self, own: DataFrame, kind: str, edges: Edges) -> DataFrame:
        """(container, label, scope) where the look finds one of the labelled facts."""
        if kind == "Contains":
            return self._inside(own, edges)
        if kind == "JoinableTo":
            return self._inside(own, edges).withColumnRenamed("container", "b").join(edges.joinable, "b").select(F.col("a").alias("container"), "label", "scope")
        return related(own, kind, edges.contains, edges.closure if kind in ("Ancestor", "Descendant") else None)

    def _looked_from(self, marks: DataFrame, own: DataFrame, kind: str, edges: Edges) -> DataFrame:
        """The marks (condition, container, scope, label) from which the look finds one of the labelled facts."""
        there = lambda df: df.withColumnRenamed("container", "other")
        if kind == "Self":
            return marks.join(own, ["container", "label", "scope"], "left_semi")
        if kind == "Parent":
            up = edges.contains.select(F.col("child").alias("container"), F.col("parent").alias("other"))
        elif kind == "Ancestor":
            up = edges.closure.select(F.col("descendant").alias("container"), F.col("ancestor").alias("other"))
        elif kind == "JoinableTo":
            up, own = edges.joinable.select(F.col("a").alias("container"), F.col("b").alias("other")), self._inside(own, edges)
        elif kind == "Sibling":
            rooted = closure_of.with_root(edges.contains).select("parent", F.col("child").alias("container"))
            asked = marks.join(rooted, "container")
            at = own.join(rooted, "container").join(asked.select("parent").distinct(), "parent", "left_semi")
            at = at.groupBy("parent", "label", "scope").agg(F.min("container").alias("lo"), F.max("container").alias("hi"))
            return asked.join(at, ["parent", "label", "scope"]).where("lo <> hi OR lo <> container")
        else:
            return marks.join(self._looked(own, kind, edges), ["container", "label", "scope"], "left_semi")
        return marks.join(up, "container").join(there(own), ["other", "label", "scope"], "left_semi")

    def comparisons(self, facts: DataFrame, edges: Edges, where: DataFrame, nodes: set[int] | None = None, marked: bool = False) -> DataFrame | None:
        """As leaves(), of comparisons, at these places (container, scope); marked: at each node's own places (condition, container, scope)."""
        out = None
        for i, c in self.nodes.items():
            if isinstance(c, Compare) and (nodes is None or i in nodes):
                places = where.where(F.col("condition") == i).drop("condition") if marked else where
                one = Evaluator(facts, edges.avail.join(places.distinct(), ["container", "scope"], "left_semi"), edges.contains, None, edges.joinable)
                found = one(c).select(F.lit(i).alias("condition"), "container", "scope")
                out = found if out is None else out.unionByName(found)
        return out

    def composed(self, found: DataFrame) -> DataFrame:
        """Rows of leaves, and of the composites that they make."""
        for depth in range(1, self.deepest + 1):
            parts = R.rule_table(found.sparkSession, self.parts(depth), "parent int, condition int, n int")
            met = found.join(parts, "condition").groupBy("parent", "n", "container", "scope").agg(F.count_distinct("condition").alias("k")).where("k >= n")
            found = found.unionByName(met.select(F.col("parent").alias("condition"), "container", "scope"))
        return found

    def evaluate(self, facts: DataFrame, avail: DataFrame, contains: DataFrame, closure: DataFrame | None, joinable: DataFrame) -> DataFrame:
        """(condition, container, scope) of every node, wherever it holds."""
        edges = Edges(avail, contains, joinable, lambda: closure)
        found = [x for x in (self.leaves(facts, edges), self.comparisons(facts, edges, avail)) if x is not None]
        if not found:
            return facts.sparkSession.createDataFrame([], "condition int, container string, scope string")
        return self.composed(Evaluator._union(found).distinct())


def demanded(has: DataFrame, rules: DataFrame) -> DataFrame:
    """Marks: (condition, container, scope) where a rule's condition matters: its source label is there, its target is not."""
    asked = has.withColumnRenamed("label", "source").join(rules, "source")
    done = has.select("container", F.col("label").alias("target"), "scope")
    return asked.join(done, ["container", "target", "scope"], "left_anti").select("condition", "container", "scope").distinct()


def demanded_all(has: DataFrame, rules: DataFrame) -> DataFrame:
    """Marks of rules that need all of several sources."""
    full = R.implication_all(has, rules)
    done = has.select("container", "label", "scope")
    return full.join(done, ["container", "label", "scope"], "left_anti").join(rules.select("rule", "condition"), "rule").select("condition", "container", "scope").distinct()
