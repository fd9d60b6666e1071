"""Facts that users take back: a stratum of its own, with truth maintenance by over-deletion and re-derivation.

When nothing more follows, each text says which facts go and which come. What it takes back stays out for good, whatever would give it again; so every round takes
back more or ends, and the result is the least fixed point of the rules without the facts taken back, the same as of a run that had barred them from the start.

Work follows what was touched. From the facts that go, rules are followed one step at a time through known facts: whatever may rest on them goes too, but for
facts that the data itself says. Of these, what the remaining facts around them still give comes back, and the rounds go on from there; conditions are looked
at again only where one was touched. Facts of user rules all go and come again, for such a rule may have looked anywhere.

k-anonymity is not counted again: where a quasi-identifier is taken back, the engine's check of drift says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave import env as E
from labelweave.plans.conditional import less, union
from labelweave.storage import drop, observed, written

#: Labels that a filter names at most.
LABELS = 1000
#: What needs no other fact.
SAID = ("Ground", "Availability", "Tag", "FieldDeclaration", "KAnonymity")


def run(engine, facts: DataFrame) -> DataFrame:
    for _ in range(engine.max_rounds):
        asked = [rule(facts) for rule in engine.retracts]
        gone, seen = _some(engine, union(x for x, _ in asked), facts)
        n = seen["n"]
        new = union(y for _, y in asked)
        if new is not None:
            new = less(less(new, facts, E.KEY), engine.barred, E.KEY).join(gone.select(*E.KEY), E.KEY, "left_anti") if n else less(less(new, facts, E.KEY), engine.barred, E.KEY)
            new, added = observed(new.select(*E.KEY).distinct(), "added")
            if not added["n"]:
                drop(new)
                new = None
        if not n and new is None:
            return facts
        seed = engine._shape(new, "extra") if new is not None else None
        changed = None
        if n:
            engine.barred = union([engine.barred, gone.select(*E.KEY)])
            facts, back, changed = withdraw(engine, facts, gone, seen)
            seed = union([seed, back])
        facts = engine._fixpoint("S5", facts, seed, changed, told=new is not None)
    raise RuntimeError(f"facts are still taken back after {engine.max_rounds} rounds")


def _some(engine, asked: DataFrame, facts: DataFrame) -> tuple[DataFrame, dict]:
    """The facts asked for that there are, as rows of facts, and counts of them."""
    keys = written(less(asked.select(*E.KEY).distinct(), engine.barred, E.KEY), "asked")
    own, _ = _by_label(facts, keys)
    found, seen = observed(own.join(keys, E.KEY, "left_semi"), "gone", **engine._starting())
    drop(keys)
    return found, seen


def _by_label(facts: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The facts with a label that one of the keys (written) has, and the others; all of them, and None, where there are too many labels to name."""
    names = [x[0] for x in keys.select("label").distinct().limit(LABELS + 1).collect()]
    if len(names) > LABELS or None in names:
        return facts, None
    return facts.where(F.col("label").isin(names)), facts.where(~F.coalesce(F.col("label").isin(names), F.lit(False)))


def withdraw(engine, facts: DataFrame, gone: DataFrame, counts: dict | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(the facts without `gone` and without what may rest on it; of this, what the others give; facts that conditions are to be asked about again)."""
    removed, frontier, touched = [gone], gone, []
    if engine.extra:
        own, seen = observed(less(facts.where("derived_via = 'extra'"), gone, E.KEY), "gone")
        if seen["n"]:
            removed.append(own)
            frontier, counts = union(removed), None
    while True:
        near = engine.state.touched(frontier)
        if near is not None:
            near = written(near, "touched")
            touched.append(near)
        moved = engine._linear(frontier, counts)
        resting = union([moved.select(*E.KEY) if moved is not None else None, engine.state.dependents(frontier, near)])
        if resting is None:
            break
        resting = resting.distinct()
        candidates = facts.where(~F.col("derived_via").isin(*SAID)).join(resting, E.KEY, "left_semi")
        frontier, counts = observed(less(candidates, union(removed), E.KEY), "gone", **engine._starting())
        if not counts["n"]:
            break
        removed.append(frontier)
    away = written(union(removed).select(*E.KEY), "away")
    own, others = _by_label(facts, away)
    left = written(own.join(away, E.KEY, "left_anti"), "facts")
    if others is not None:  # they stay where they were written
        left = left.unionByName(others)
    lost = written(less(away, engine.barred, E.KEY), "lost")
    touched = union(touched)
    engine.state.forget(written(touched.distinct(), "touched") if touched is not None else None)

    # the rules that take one fact to one look from the facts at, above, below and beside what was lost
    at = lost.select("container").distinct()
    edges, contains = engine.edges, engine.contains
    around = [at, edges.join(at, "container").select(F.col("source").alias("container"))]
    if any(d == "Peer" for _, _, d in engine.rules.propagations):
        parents = contains.join(at.withColumnRenamed("container", "child"), "child").select("parent").distinct()
        around.append(contains.join(parents, "parent").select(F.col("child").alias("container")))
    premises = left.where(engine._starts()).join(union(around).distinct(), "container", "left_semi")
    back = engine._linear(premises)
    back = back.join(lost, E.KEY, "left_semi") if back is not None else None
    for rule in engine.extra:
        names = [c for c in left.columns if c != "round"]
        back = union([back, engine._shape(rule(left.select(*names), left.select(*names)), "extra")])
    back = written(back, "back") if back is not None else None
    # of rules with conditions or several sources: as if what stands beside the lost ones had just come
    changed = None if engine.state.idle else written(left.join(lost.select("container", "scope").distinct(), ["container", "scope"], "left_semi"), "changed")
    drop(*removed[1:], away, lost)  # those that a user took back stay, to be barred
    return left, back, changed
