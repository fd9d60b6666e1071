"""Texts of users look at facts by their parts, not at a table of all triples."""

from labelweave import env as E
from labelweave.operators import query
from labelweave.plans import engine, sparql


def world(spark, rules):
    return E.from_rows(
        spark, rules, contains=[("d", "t1"), ("d", "t2"), ("t1", "r1")], availability=[("d", "s")], frameworks=[("F", None, None, "core")],
        labels=[("x", "F"), ("y", "F"), ("u", "F")], tags=[("r1", "x"), ("t1", "x"), ("t1", "u"), ("t2", "x")],
    )


def test_user_texts_filter_facts(spark, monkeypatch):
    def none(*_):
        raise AssertionError("all triples are put together")

    monkeypatch.setattr(query, "triples", none)
    env = world(spark, E.Rules(propagations=(E.Propagation("F", "Outward", label="x"),)))
    text = "DELETE { ?n <assertsLabel> 'x' } WHERE { ?n <assertsLabel> 'x' . ?n <assertedOn> ?c . ?m <assertedOn> ?c . ?m <assertsLabel> 'u' }"
    found = engine.infer(env, with_k=False, retracts=tuple(sparql.retracts(env, [text]))).assertions
    assert {r[0] for r in found.where("label = 'x'").select("container").collect()} == {"r1", "t2", "d"}
    more = "CONSTRUCT { ?n <assertedOn> ?p . ?n <assertsLabel> 'y' . ?n <assertedInScope> ?g . ?n <assertedByFramework> 'F' } WHERE { ?a <assertsLabel> 'u' . ?a <assertedOn> ?c . ?a <assertedInScope> ?g . ?p <contains> ?c . BIND(CONCAT('n', ?p, ?g) AS ?n) }"
    found = engine.infer(env, with_k=False, extra=tuple(sparql.in_rounds(env, [more]))).assertions
    assert [tuple(r) for r in found.where("label = 'y'").select(*E.KEY).collect()] == [("d", "y", "s", "F")]
