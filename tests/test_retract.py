"""Facts that users take back, against a plain evaluation that bars them from the start; conditions by demand."""

import naive
import pytest
from test_engine import interpreted, random_world  # noqa: F401

from labelweave import env as E
from labelweave.plans import sparql
from labelweave.plans.engine import infer
from labelweave.sources import frameworks


def facts(result):
    return {tuple(r) for r in result.assertions.select(*E.KEY).collect()}


def without_parents(rows):
    # a fact that came by way of a parent framework does not go further up: which one it is depends on the order of derivations
    return rows | {"frameworks": [(f, None, None, t) for f, _, _, t in rows["frameworks"]]}


@pytest.mark.parametrize("seed", [0, 3])
def test_taking_back_equals_a_run_without(spark, seed):
    rows, rules = random_world(seed)
    rows = without_parents(rows)
    full = naive.evaluate(rules, rows)
    label = max({l for _, l, _, _ in full if l.startswith("l")}, key=lambda l: (len({x for x in full if x[1] == l}), l))
    text = f"DELETE {{ ?n <assertsLabel> '{label}' }} WHERE {{ ?n <assertsLabel> '{label}' . ?n <assertedOn> ?c . ?c <contains> ?d }}"
    parents, barred = {p for p, _ in rows["contains"]}, frozenset()
    while gone := {x for x in naive.evaluate(rules, rows, barred=barred) if x[1] == label and x[0] in parents}:
        barred |= gone
    env = E.from_rows(spark, rules, **rows)
    got = facts(infer(env, with_k=False, inherit=(), retracts=tuple(sparql.retracts(env, [text]))))
    assert barred and got == naive.evaluate(rules, rows, barred=barred)


def test_other_support_keeps_a_fact(spark):
    """y of b rests on x of a and on x of c; only the former goes. What rests on it alone goes too, a cycle of support included."""
    rows = {
        "contains": [("b", "a"), ("b", "c"), ("e", "d")], "availability": [(k, "s") for k in "abcde"], "frameworks": [("f", None, None, "core")],
        "ground": [("a", "x", "s", "f", None), ("c", "x", "s", "f", None), ("d", "x", "s", "f", None), ("a", "bad", "s", "f", None), ("d", "bad", "s", "f", None)],
    }
    rules = E.Rules(
        propagations=(E.Propagation("f", "Outward", "y"), E.Propagation("f", "Inward", "y")), subclasses=(E.Subclass("f", ("x",), "y"),),
        implications=(E.Implication("f", ("y",), ("z",), (E.Related("y", "Child"),)),), conditionals=(E.Conditional("f", E.Contains("z"), "w"),),
    )
    env = E.from_rows(spark, rules, **rows)
    text = "DELETE { ?n <assertsLabel> 'x' } INSERT { ?k <assertedOn> ?c . ?k <assertsLabel> 'was' . ?k <assertedInScope> 's' . ?k <assertedByFramework> 'f' } WHERE { ?n <assertsLabel> 'x' . ?n <assertedOn> ?c . ?m <assertedOn> ?c . ?m <assertsLabel> 'bad' . BIND(CONCAT('k', ?c) AS ?k) }"
    got = {(c, label) for c, label, _, f in facts(infer(env, with_k=False, retracts=tuple(sparql.retracts(env, [text])))) if f == "f"}
    assert got == {("a", "bad"), ("d", "bad"), ("a", "was"), ("d", "was"), ("c", "x"), *((k, "y") for k in "abc"), ("b", "z"), ("b", "w")}
    with pytest.raises(ValueError):
        sparql.retracts(env, ["DELETE { ?a <contains> ?b } WHERE { ?a <contains> ?b }"])


def test_manifest_with_files_and_a_delete(spark, tmp_path):
    """A folder with [files] in both forms; its update takes facts of its own construct back."""
    for name, text in {
        "model/m.ttl": "@prefix : <http://x.org/v#> . @prefix a: <http://x.org/a#> . a:T a :Table ; :availableInScope a:S . a:DB :hasTables a:T ; :availableInScope a:S .",
        "constructs/c.rq": "CONSTRUCT { ?n <assertedOn> ?c . ?n <assertsLabel> 'Seen' . ?n <assertedInScope> ?g . ?n <assertedByFramework> 'Own' } WHERE { ?c <availableInScope> ?g . BIND(CONCAT('n', ?c, ?g) AS ?n) }",
        "updates/u.rq": "DELETE { ?n <assertsLabel> 'Seen' } WHERE { ?n <assertsLabel> 'Seen' . ?n <assertedOn> ?c . ?c <contains> ?d }",
        "framework.toml": 'name = "Own"\ntype = "custom"\nversion = "1"\nlabels = ["Seen"]\n[files]\nconstructs = ["constructs/c.rq"]\nupdates = ["updates/u.rq"]\n[files.model]\nfiles = ["model/m.ttl"]\n',
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    module = frameworks.Modules().load(tmp_path)
    assert module.models and module.constructs and module.updates
    env = module.environment(spark)
    run = lambda **x: {r["container"] for r in infer(env, with_k=False, extra=tuple(module.in_rounds(env)), **x).assertions.where("label = 'Seen'").collect()}
    assert run() == {"T", "DB"} and run(retracts=tuple(module.retracts(env))) == {"T"}
    (tmp_path / "framework.toml").write_text('name = "Own"\n[files]\nmodels = ["model/m.ttl"]\n')
    with pytest.raises(ValueError):
        frameworks.Modules().load(tmp_path)
    (tmp_path / "framework.toml").write_text('name = "Own"\n[files]\nmodel = ["model/none.ttl"]\n')
    with pytest.raises(FileNotFoundError):
        frameworks.Modules().load(tmp_path)


def test_conditions_are_asked_where_their_rule_is(spark):
    names = [f"t{k}" for k in range(6)]
    rows = {
        "contains": [("d", t) for t in names], "availability": [("d", "s")], "frameworks": [("f", None, None, "core")],
        "ground": [*((t, "x", "s", "f", None) for t in names), ("t1", "asks", "s", "f", None), ("d", "up", "s", "f", None)],
    }
    rules = E.Rules(implications=(E.Implication("f", ("asks",), ("got",), (E.All((E.Related("x", "Sibling"), E.Any((E.Related("up", "Parent"), E.Has("none"))))),)),))
    found = infer(E.from_rows(spark, rules, **rows), with_k=False, keep_conditions=True)
    assert {r["container"] for r in found.marks.collect()} == {"t1"} == {r["container"] for r in found.holds.collect()}
    assert found.marks.count() == 5 and found.holds.count() == 4 and found.assertions.where("label = 'got'").count() == 1


def test_counts_come_from_the_writes(spark):
    rows, rules = random_world(1)
    result = infer(E.from_rows(spark, rules, **rows), with_k=False)
    table = result.metrics_table().collect()
    assert sum(r["facts"] for r in table) == result.assertions.count()
    assert abs(sum(r["seconds"] for r in table) - sum(m[3] for m in result.metrics)) < 1e-6
