import random

import medical
import naive
import pytest

from labelweave import env as E
from labelweave.operators import kanon, query
from labelweave.plans.compile import chains, compile_rules, inherited, topological
from labelweave.plans.engine import Engine, infer


@pytest.fixture(autouse=True, scope="module")
def interpreted(spark):
    """Hundreds of small plans: compiling each takes longer than running it."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")


def random_world(seed):
    rng = random.Random(seed)
    n = 12
    names = [f"c{i}" for i in range(n)]
    rows = {
        "contains": [(names[rng.randrange(i)], names[i]) for i in range(1, n)] + [(names[0], names[n - 1])],
        "availability": [(rng.choice(names[:4]), g) for g in ("g1", "g2")], "joinable": [tuple(rng.sample(names, 2)) for _ in range(4)],
        "tags": [(rng.choice(names), f"l{rng.randrange(5)}") for _ in range(8)], "labels": [(f"l{i}", f"f{i % 3}") for i in range(8)], "label_facets": [("l1", "x"), ("l2", "x")],
        "frameworks": [("f0", None, None, "core"), ("f1", None, None, "privacy"), ("f2", None, "f0", "custom")],
        "ground": [(rng.choice(names), "l7", "g1", "f1", {"k": str(rng.randrange(6))})],
    }
    leaf = lambda: rng.choice([E.Has(f"l{rng.randrange(8)}"), E.Contains(f"l{rng.randrange(8)}"), E.JoinableTo("l1"), E.Related(f"l{rng.randrange(8)}", rng.choice(E.RELATIONS)), E.Compare(E.Operand("l7", "k"), rng.choice("<>"), E.Operand(literal=3))])
    label = lambda: f"l{rng.randrange(8)}"
    framework = lambda: f"f{rng.randrange(3)}"
    rules = E.Rules(
        tuple(E.Propagation(framework(), d, label=label()) for d in E.DIRECTIONS) + (E.Propagation("f1", "Inward", facet="x"),),
        tuple(E.Subclass(framework(), (label(), label()), label()) for _ in range(2)),
        (E.Implication(framework(), (label(),), (label(), label()), (E.All((leaf(), E.Any((leaf(), leaf())))), leaf())), E.Implication(framework(), (label(), label()), (label(),), (), True)),
        (E.Equivalence(framework(), (label(), label()), label()),),
        (E.Conditional(framework(), leaf(), label()),),
    )
    return rows, rules


@pytest.mark.parametrize("seed", range(3))
def test_engine_equals_plain_evaluation(spark, seed):
    rows, rules = random_world(seed)
    got = infer(E.from_rows(spark, rules, **rows), with_k=False, inherit=()).assertions
    assert {tuple(r) for r in got.select(*E.KEY).collect()} == naive.evaluate(rules, rows)
    assert got.count() == got.select(*E.KEY).distinct().count()


def test_label_closure_and_rerun_change_nothing(spark):
    rows, rules = random_world(7)
    env = E.from_rows(spark, rules, **rows)
    facts = lambda **x: {tuple(r) for r in infer(env, with_k=False, **x).assertions.select(*E.KEY).collect()}
    one = facts(close_labels=True)
    assert one == facts(close_labels=False)
    again = env.with_tables(ground=spark.createDataFrame([(*f, None) for f in one], E.SCHEMAS["ground"]))
    assert {tuple(r) for r in infer(again, with_k=False).assertions.select(*E.KEY).collect()} == one


@pytest.fixture(scope="module")
def joined(spark):
    return infer(medical.environment(spark), on_drift="warn")


def found(result, container, label, scope):
    return {r[0] for r in query.query_assertions(result.assertions, container, label, scope).select("framework").collect()}


def test_context_decides(joined, spark):
    assert {"BaseFramework", "GDPRFramework"} <= found(joined, "ProvidersInfo", "Individual", "HumanResources")
    assert {"BaseFramework", "GDPRFramework"} <= found(joined, "ProvidersInfo", "Individual", "Research")
    assert found(joined, "ProvidersInfo", "ProtectedHealthInformation", "Research") == {"HIPAAFramework"}
    assert not found(joined, "ProvidersInfo", "ProtectedHealthInformation", "HumanResources")
    assert "GDPRFramework" in found(joined, "PatientTreatments", "SpecialCategoryData", "Research")
    assert not found(joined, "ProvidersInfo", "SpecialCategoryData", "Research")


def test_without_joins(spark):
    apart = infer(medical.environment(spark, cross=False, frameworks=("base", "hipaa", "gdpr"), rows=3))
    assert not query.query_assertions(apart.assertions, "ProvidersInfo", "ProtectedHealthInformation").count()
    assert query.query_assertions(apart.assertions, "PatientInfo", "ProtectedHealthInformation").count()


def test_k_and_divergence(joined):
    k = {r["table"]: r["k"] for r in joined.k.where("scope = 'Research'").collect()}
    assert k == {"AggregatedHealth": 3, "AggregatedHealth12": 12, "PatientInfo": 1, "PatientEncounters": 1, "ProvidersInfo": 1}
    verdict = {}
    for t in k:
        verdict[t] = (
            not found(joined, t, "hipaa:HighReidentificationRisk", "Research"),
            "EMAFramework" not in found(joined, t, "gdpr:HighReidentificationRisk", "Research"),
            "ItalianDPAFramework" not in found(joined, t, "PersonalData", "Research"),
        )
    assert verdict == {"AggregatedHealth": (True, False, False), "AggregatedHealth12": (True, True, False), "PatientInfo": (False,) * 3, "PatientEncounters": (False,) * 3, "ProvidersInfo": (False,) * 3}
    assert not joined.assertions.where("container LIKE 'AggregatedHealth5%'").count()
    size = query.query_assertions(joined.assertions, "AggregatedHealth", "KAnonymityAnalysis", "Research").select("params").first()[0]
    assert size == {"minimumCohortSize": "3"}


def test_views_and_metrics(joined, spark):
    joined.register_views()
    assert spark.sql("SELECT count(DISTINCT container) AS n FROM assertions").first()["n"] > 100
    assert joined.metrics_table().where("stratum = 'S4'").count()
    assert joined.containment(["DirectIdentifier"]).where("container = 'PatientInfo'").count()


def test_signatures_escape_nothing(spark):
    fields = spark.createDataFrame([("f1", "r1", "t", "a", "x;y", "s"), ("f2", "r1", "t", "b", "ü=~ #", "s"), ("f3", "r2", "t", "b", "q", "s"), ("f4", "r3", "t", "z", "q", "s")], E.SCHEMAS["fields"])
    quasi = spark.createDataFrame([("f1", "g"), ("f2", "g"), ("f3", "g")], "container string, scope string")
    assert {tuple(r) for r in kanon.signatures(fields, quasi).collect()} == {("t", "g", "r1", "a=x;y;b=ü=~ #"), ("t", "g", "r2", "b=q")}
    assert kanon.k_anonymity(kanon.signatures(fields, quasi)).collect()[0]["k"] == 1


def test_inheritance_and_overrides():
    chain = chains([("a", None), ("b", "a"), ("c", "b")])
    assert chain == {"a": ["a"], "b": ["b", "a"], "c": ["c", "b", "a"]}
    rules = E.Rules(subclasses=(E.Subclass("a", ("x",), "t", "far"), E.Subclass("b", ("y",), "t", "near"), E.Subclass("a", ("x",), "u", "other")))
    got = {(r.framework, r.name) for r in inherited(rules, chain, ("subclasses",)).subclasses}
    assert got == {("a", "far"), ("b", "near"), ("a", "other"), ("b", "other"), ("c", "near"), ("c", "other")}
    assert topological([("c", "b"), ("b", "a"), ("a", None)]) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        topological([("a", "b"), ("b", "a")])


def test_chain_visibility(spark):
    rows = {"frameworks": [("f", None, None, "core"), ("g", "f", None, "core"), ("h", None, None, "core")], "ground": [("c", "x", "s", "f", None), ("d", "x", "s", "h", None)], "availability": [("c", "s"), ("d", "s")]}
    rules = E.Rules(subclasses=(E.Subclass("g", ("x",), "y"),), implications=(E.Implication("g", ("x", "y"), ("z",), (), True),))
    own = lambda v: {tuple(r) for r in infer(E.from_rows(spark, rules, **rows), visibility=v, with_k=False, inherit=()).assertions.where("label IN ('y', 'z')").select("container", "label", "framework").collect()}
    assert own("any") == {(c, l, "g") for c in "cd" for l in "yz"}
    # z asks for y under g and x under f, which g extends
    assert own("chain") == {("c", "y", "g"), ("c", "z", "g")}


def test_user_rules_and_limits(spark):
    env = E.from_rows(spark, E.Rules(), ground=[("c", "x", "s", "f", None)], availability=[("c", "s")])
    extra = lambda facts, delta: delta.where("label = 'x'").selectExpr("container", "'y' AS label", "scope", "framework")
    assert infer(env, extra=(extra,)).assertions.where("label = 'y'").count() == 1
    with pytest.raises(RuntimeError):
        Engine(env, max_rounds=0).run()
    with pytest.raises(ValueError):
        E.Propagation("f", "Sideways", label="x")
    assert not infer(E.from_rows(spark, E.Rules())).assertions.count()


def test_lint(spark):
    env = E.from_rows(spark, E.Rules(subclasses=(E.Subclass("f", ("known",), "lost"),)), labels=[("known", "f")], frameworks=[("f", None, None, "core")])
    assert any("lost" in x for x in E.lint(env))


def test_compiled_rules_are_distinct(spark):
    env = medical.environment(spark, rows=1)
    c = compile_rules(env)
    assert len(set(c.label_steps)) == len(c.label_steps) and all(p[2] in E.DIRECTIONS for p in c.propagations)


def test_k_counts_pairs_and_no_texts(spark):
    fields = spark.createDataFrame([("f1", "r1", "t", "a", "x;b=y", "s"), ("f2", "r2", "t", "a", "x", "s"), ("f3", "r2", "t", "b", "y", "s")], E.SCHEMAS["fields"])
    quasi = spark.createDataFrame([(f"f{i}", "g") for i in (1, 2, 3)], "container string, scope string")
    assert {r["signature"] for r in kanon.signatures(fields, quasi).collect()} == {"a=x;b=y"}
    assert kanon.k_anonymity(kanon.signatures(fields, quasi, as_text=False)).collect()[0]["k"] == 1
