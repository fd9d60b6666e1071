"""What a run reads and moves: closures, rounds and user texts do not go through all that is known again."""

import random

import pytest
from pyspark.sql import DataFrame

from labelweave import env as E
from labelweave.operators import closure
from labelweave.plans import engine


def brute(seed, edges):
    found = set(seed)
    while more := {(c, x) for a, x in found for p, c in edges if p == a} - found:
        found |= more
    return found


@pytest.mark.parametrize("kind", ["tree", "ring", "any"])
def test_closures_of_any_graph(spark, monkeypatch, kind):
    rng = random.Random(5)
    edges = {(f"c{rng.randrange(i)}", f"c{i}") for i in range(1, 14)}
    if kind == "ring":
        edges = {(f"c{i}", f"c{(i + 1) % 5}") for i in range(5)} | {("c6", "c6")}
    if kind == "any":
        edges |= {(f"c{rng.randrange(14)}", f"c{rng.randrange(14)}") for _ in range(7)}
    contains = spark.createDataFrame([*edges, *list(edges)[:3]], "parent string, child string")
    met, join = [], DataFrame.join
    monkeypatch.setattr(DataFrame, "join", lambda self, other, on=None, how=None: met.append(how) or join(self, other, on, how))
    got = {tuple(r) for r in closure.ancestors(contains).collect()}
    assert got == {(a, d) for a in {p for p, _ in edges} for d, _ in brute({(c, a) for p, c in edges if p == a}, edges)}
    assert kind != "tree" or "left_anti" not in met  # ways never meet in a tree, so known rows are not read
    starts = [("c0", "g"), ("c3", "g"), ("c3", "h"), ("c3", "h")]
    found = closure.available(spark.createDataFrame(starts, "container string, scope string"), contains)
    assert sorted(map(tuple, found.collect())) == sorted(brute(set(starts), edges)) and found._rows == found.count()


def world(spark, rules):
    return E.from_rows(
        spark, rules, contains=[("d", "t1"), ("d", "t2"), ("t1", "r1")], availability=[("d", "s")], frameworks=[("F", None, None, "core")],
        labels=[("x", "F"), ("y", "F"), ("u", "F")], tags=[("r1", "x"), ("t1", "x"), ("t1", "u"), ("t2", "x")],
    )


def test_rounds_write_only_what_rules_start_from(spark, monkeypatch):
    wrote, observed = [], engine.observed
    monkeypatch.setattr(engine, "observed", lambda df, what, **x: wrote.append((what, df)) or observed(df, what, **x))
    result = engine.infer(world(spark, E.Rules(propagations=(E.Propagation("F", "Outward", label="u"),))), with_k=False)
    assert {r[0] for r in result.assertions.where("label = 'u'").select("container").collect()} == {"t1", "d"}
    facts = [df for what, df in wrote if what == "facts"]
    assert len(facts) == 3  # the tags, u on d, and nothing above d
    wrote.clear()
    none = engine.infer(world(spark, E.Rules(propagations=(E.Propagation("F", "Outward", label="nowhere"),))), with_k=False)
    assert [what for what, _ in wrote].count("facts") == 1 and none.rounds == 1  # no round is run that nothing can follow in
    assert none.assertions.where("label = 'Available'").count() == 4


@pytest.mark.parametrize("kind", ["tree", "ring", "any"])
def test_inside_labelled_containers_without_a_closure(spark, monkeypatch, kind):
    rng = random.Random(7)
    edges = {(f"c{rng.randrange(i)}", f"c{i}") for i in range(1, 14)}
    if kind == "ring":
        edges = {(f"c{i}", f"c{(i + 1) % 5}") for i in range(5)} | {("c6", "c6")}
    if kind == "any":
        edges |= {(f"c{rng.randrange(14)}", f"c{rng.randrange(14)}") for _ in range(7)}
    held = [("c1", "x", "s"), ("c3", "x", "s"), ("c3", "x", "t"), ("c0", "y", "s"), ("c6", "y", "s")]
    got = closure.inside(spark.createDataFrame(held, "container string, label string, scope string"), spark.createDataFrame([*edges], "parent string, child string"))
    assert sorted(map(tuple, got.collect())) == sorted({(d, label, s) for c, label, s in held for d, _ in brute({(x, c) for p, x in edges if p == c}, edges)})


def test_conditions_work_out_no_closure_that_they_do_not_need(spark):
    from labelweave.operators import conditions

    def closed():
        raise AssertionError("a closure is worked out")

    rows = lambda x, schema: spark.createDataFrame(x, schema)
    facts, avail = rows([("t1", "x", "s", {"n": "3"}), ("d", "y", "s", None)], "container string, label string, scope string, params map<string,string>"), rows([("t1", "s"), ("t2", "s")], "container string, scope string")
    holds = conditions.Evaluator(facts, avail, rows([("d", "t1"), ("d", "t2"), ("t2", "r")], "parent string, child string"), closed, rows([], "a string, b string"))
    assert [r[0] for r in holds(E.Related("x", "Sibling")).collect()] == ["t2"]
    assert [r[0] for r in holds(E.Compare(E.Operand("x", "n"), "<=", E.Operand(literal=3))).collect()] == ["t1"]
    assert sorted(r[0] for r in holds(E.Related("y", "Ancestor")).collect()) == ["r", "t1", "t2"]


def test_a_task_holds_a_part_of_the_rows_of_a_small_file(spark, tmp_path):
    """Texts and records are dealt into as many parts as shuffles have, whatever the files' sizes."""
    from labelweave.operators import kanon
    from labelweave.sources import turtle

    spark.range(400).selectExpr("concat('@prefix x: <http://x/> . x:p', id % 300, ' x:q ', id % 300, ' .') AS text").coalesce(1).write.parquet(str(tmp_path / "texts"))
    parsed = turtle.read_texts(spark.read.parquet(str(tmp_path / "texts")))
    dealt = ", REPARTITION_BY_NUM"
    assert dealt in parsed._jdf.queryExecution().executedPlan().toString() and parsed.count() == 300
    fields = spark.createDataFrame([(f"r{i}.a", f"r{i}", "t", "a", str(i % 3)) for i in range(9)], "field string, record string, table string, name string, value string")
    signed = kanon.signatures(fields, fields.selectExpr("field AS container", "'g' AS scope"), as_text=False)
    assert signed._jdf.queryExecution().executedPlan().toString().count(dealt) == 3 and kanon.k_anonymity(signed).collect()[0]["k"] == 3


def test_saturation_asks_patterns_about_new_triples_alone(spark, monkeypatch):
    from labelweave.plans import sparql
    from labelweave.storage import spread

    rng = random.Random(11)
    edges = {(f"c{rng.randrange(i)}", f"c{i}") for i in range(1, 12)} | {("c9", "c2"), ("c5", "c5")}
    triples = spark.createDataFrame([(a, "in", b) for a, b in edges] + [("c1", "k", "2")], "s string, p string, o string")
    texts = ["CONSTRUCT { ?a <up> ?b } WHERE { ?a <in> ?b }", "CONSTRUCT { ?a <up> ?c } WHERE { ?a <up> ?b . ?b <up> ?c }", "CONSTRUCT { ?a <far> ?c } WHERE { ?a <up> ?c . ?c <k> ?n FILTER(?n > 1) }"]
    plain = {tuple(r) for r in sparql.saturate(texts, triples, ["INSERT { ?a <in> ?b } WHERE { ?a <in> ?b }"])[0].collect()}
    asked = []
    monkeypatch.setattr(sparql, "query", lambda text, known: asked.append(text))
    got = sparql.saturate(texts, triples)[0].collect()
    closed = {(a, d) for a in {p for p, _ in edges} for d, _ in brute({(c, a) for p, c in edges if p == a}, edges)}
    assert not asked and len(got) == len(set(got)) and set(map(tuple, got)) == plain and {(r[0], r[2]) for r in got if r[1] == "up"} == closed
    assert {(r[0], r[2]) for r in got if r[1] == "far"} == {(a, d) for a, d in closed if d == "c1"}
    for some in ("{ ?x <on> ?y } WHERE { ?x ?p ?y }", "{ ?x ?p <y> } WHERE { ?x ?p ?y }"):  # any predicate
        monkeypatch.undo()
        text = [f"CONSTRUCT {some}"]
        assert {tuple(r) for r in sparql.saturate(text, triples)[0].collect()} == {tuple(r) for r in sparql.saturate(text, triples, ["INSERT { ?a <in> ?b } WHERE { ?a <in> ?b }"])[0].collect()}
    assert spread(triples, "s", rows=5 << 20).rdd.getNumPartitions() == 5
