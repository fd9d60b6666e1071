"""Proofs against the plain evaluator: premises have lower ranks, give the fact by themselves, and all ends in given facts."""

import naive
import pytest
from test_engine import interpreted, random_world  # noqa: F401

from labelweave import env as E
from labelweave.plans.compile import overridden
from labelweave.plans.engine import infer
from labelweave.sources import frameworks
from labelweave.sources.graph import rules_from_graph

GIVEN = {"Ground", "Availability", "Tag", "FieldDeclaration"}


def checked(result, asked, rows, rules):
    ranks = {tuple(r[:4]): (r[4], r[5]) for r in result.by_round.select(*E.KEY, "round", "params").collect()}
    steps, premises = result.proofs(asked).collect(), {}
    for s in steps:
        fact = tuple(s[k] for k in E.KEY)
        assert ranks[fact][0] == s["round"]
        of = premises.setdefault(fact, set())
        if s["of_container"] is None:
            assert s["rule"] in GIVEN, s
            continue
        premise = (s["of_container"], s["of_label"], s["scope"], s["of_framework"])
        assert ranks[premise][0] == s["of_round"] < s["round"]
        of.add(premise)
    assert all(p in premises for of in premises.values() for p in of)
    for fact, of in premises.items():
        if of:
            alone = rows | {"tags": [], "ground": [(*p, ranks[p][1]) for p in of]}
            assert fact in naive.evaluate(rules, alone), (fact, of)
    return premises


@pytest.mark.parametrize("seed", [0, 2])
def test_every_fact_is_proved(spark, seed):
    rows, rules = random_world(seed)
    result = infer(E.from_rows(spark, rules, **rows), with_k=False, inherit=())
    everything = {tuple(r) for r in result.assertions.select(*E.KEY).collect()}
    assert set(checked(result, result.assertions, rows, rules)) == everything


def test_looks_of_all_kinds(spark):
    """One rule for each kind of condition, over a tree; comparisons and composites too."""
    tree = [("d", "t"), ("d", "u"), ("t", "r"), ("t", "q"), ("u", "v")]
    rows = {
        "contains": tree, "availability": [("d", "s"), ("z", "s")], "joinable": [("z", "t")], "frameworks": [("f", None, None, "core"), ("p", None, None, "core"), ("sub", None, "p", "core")],
        "ground": [*((k, "go", "s", "f", None) for k in "dtuzrqv"), ("r", "x", "s", "f", None), ("t", "y", "s", "sub", {"n": "7"}), ("q", "big", "s", "f", {"n": "9"})],
    }
    looks = {r: E.Related("x", r) for r in E.RELATIONS} | {"contains": E.Contains("x"), "joins": E.JoinableTo("x"), "has": E.Has("x"), "more": E.Compare(E.Operand("y", "n"), ">", E.Operand(literal=5))}
    looks |= {"none": E.Any((E.Has("no"), E.All((E.Related("x", "Child"), E.Related("y", "Self"))))), "default": E.Compare(E.Operand("big", "n", default=1), "<", E.Operand(literal=5))}
    rules = E.Rules(
        implications=(*(E.Implication("f", ("go",), (f"by {k}",), (c,), False, k) for k, c in looks.items()), E.Implication("f", ("by Child", "by more"), ("two",), (E.Related("x", "Descendant"),), True, "all")),
        conditionals=(E.Conditional("f", E.Contains("two"), "holds two"),), propagations=(E.Propagation("f", "Peer", "by joins"), E.Propagation("f", "Inward", "two")),
    )
    result = infer(E.from_rows(spark, rules, **rows), with_k=False)
    found = checked(result, result.assertions, rows, rules)
    of = lambda c, label, f="f": {(p[0], p[1]) for p in found[c, label, "s", f]}
    assert of("q", "by Sibling") == {("q", "go"), ("r", "x")} and of("t", "by more") == {("t", "go"), ("t", "y")}
    assert of("z", "by joins") == {("z", "go"), ("r", "x")} and of("t", "by none") == {("t", "go"), ("r", "x"), ("t", "y")}
    assert of("t", "two") == {("t", "by Child"), ("t", "by more"), ("r", "x")} and of("d", "holds two") == {("t", "two")}
    assert of("v", "by default") == {("v", "go")} and of("t", "y", "p") == {("t", "y")} and ("q", "by default", "s", "f") not in found


def test_only_what_is_asked(spark):
    rows = {"contains": [("b", "a"), ("c", "b"), ("x", "w")], "availability": [(k, "s") for k in "abcwx"], "frameworks": [("f", None, None, "core")], "ground": [("a", "l", "s", "f", None), ("w", "l", "s", "f", None)]}
    result = infer(E.from_rows(spark, E.Rules(propagations=(E.Propagation("f", "Outward", "l"),)), **rows), with_k=False)
    ask = lambda *facts: result.proofs(spark.createDataFrame(facts, "container string, label string, scope string, framework string"))
    got = ask(("c", "l", "s", "f"), ("c", "l", "s", "f"), ("a", "none", "s", "f"), (None, "l", "s", "f"))
    assert sorted((r["container"], r["rule"], r["of_container"]) for r in got.collect()) == [("a", "Ground", None), ("b", "Outward", "a"), ("c", "Outward", "b")]
    assert ask(("a", "none", "s", "f")).count() == 0


def test_overrides_of_modules(spark, tmp_path):
    """mid does without r1, and low with it; side, another way from top to low, brings r1 to low where it is there."""
    for name, text in {
        "top": 'name = "top"\nlabels = ["x", "y", "z"]\n[[subclass]]\nname = "r1"\nany = ["x"]\nto = "y"\n[[subclass]]\nname = "r2"\nany = ["x"]\nto = "z"\n', "mid": 'name = "mid"\nextends = "top"\noverrides = ["r1"]\n',
        "low": 'name = "low"\nextends = "mid"\n',
    }.items():
        (tmp_path / f"{name}.toml").write_text(text)
    modules = frameworks.Modules()
    for name in ("top", "mid", "low"):
        modules.load(tmp_path / f"{name}.toml")
    edges = [("top", None), ("mid", "top"), ("low", "mid")]
    assert overridden(modules.rules, edges) == {("mid", "top", "r1"), ("low", "top", "r1")}
    assert overridden(modules.rules, [*edges, ("side", "top"), ("low", "side")]) == {("mid", "top", "r1")}
    got = infer(modules.environment(spark, ground=[("c", "x", "s", "top", None)], availability=[("c", "s")]), with_k=False).assertions.where("label IN ('y', 'z')")
    assert {(r["label"], r["framework"]) for r in got.collect()} == {("y", "top"), ("z", "top"), ("z", "mid"), ("z", "low")}


def test_overrides_of_a_graph(spark):
    v = "http://x.org/v#"
    triples = [("top", "declaresSubclassOf", "d"), ("d", "fromLabel", "x"), ("d", "isSubclassOf", "y"), ("mid", "overrides", "d")]
    rules = rules_from_graph(spark.createDataFrame([(v + s, v + p, v + o) for s, p, o in triples], "s string, p string, o string"))
    assert rules.overrides == (E.Override("mid", f"{v}d"),) and overridden(rules, [("top", None), ("mid", "top")]) == {("mid", "top", f"{v}d")}


def test_given_facts_are_not_looked_for(spark, monkeypatch):
    """Premises are looked for among facts of labels that some way may take, and a level of given facts alone looks for none."""
    from labelweave.plans import proofs

    rows = {"contains": [("d", "t"), ("t", "r")], "availability": [("d", "s")], "frameworks": [("f", None, None, "core")], "labels": [("x", "f"), ("other", "f")], "tags": [("r", "x"), ("t", "other")]}
    rules = E.Rules(propagations=(E.Propagation("f", "Outward", "x"),))
    result = infer(E.from_rows(spark, rules, **rows), with_k=False)
    assert {r[0] for r in proofs.Prover(result.engine, result.by_round).premises.select("label").collect()} == {"x"}
    levels, steps = [], proofs.Prover._steps
    monkeypatch.setattr(proofs.Prover, "_steps", lambda self, level: levels.append(level) or steps(self, level))
    found = sorted(tuple(r) for r in result.proofs(result.assertions.where("container = 'd' AND label = 'x'")).select("container", "rule", "part", "of_container", "of_round").collect())
    assert found == [("d", "Outward", 0, "t", 1), ("r", "Tag", None, None, None), ("t", "Outward", 0, "r", 0)] and len(levels) == 2
    levels.clear()
    given = result.proofs(result.assertions.where("label = 'other'")).collect()
    assert [(r["container"], r["rule"], r["part"], r["of_label"]) for r in given] == [("t", "Tag", None, None)] and not levels
    assert result.proofs(result.assertions.where("label = 'nowhere'")).count() == 0
