import pytest
from pyspark.sql import functions as F

from labelweave import env as E
from labelweave.operators import query
from labelweave.plans.engine import infer
from labelweave.sources import graph, inputs, turtle

TTL = '''
@prefix : <http://x.org/v#> .
@prefix app: <http://x.org/a#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
app:DB a :Database ; :hasTables app:T, app:U ; :hasTag :Health .   # tags
app:DB :availableInScope app:S .
app:T :joinableWith app:U ; :declaresField [ :forFieldName "ssn" ; :hasLabel :SSN ] , [ :forFieldName "zip" ; :hasLabel :Zip ] ;
   :hasRecords app:r1, app:r2 .
app:r1 :hasField [ :fieldName "ssn" ; :fieldValue "1; 2#3" ] , [ :fieldName "zip" ; :fieldValue 9 ] .
app:r2 :hasField [ :fieldName "zip" ; :fieldValue "9"^^xsd:integer ] .
:Health :introducedByFramework :F . :SSN :introducedByFramework :F . :Zip :introducedByFramework :F .
:F a :Framework ;
   :declaresImplication [ :fromAnyLabel ( :SSN :Passport ) ; :toLabel :Direct ] ;
   :declaresImplication [ :fromAnyLabel ( :Zip ) ; :toLabel :IndirectIdentifier ] ;
   :hasPropagationRule [ :propagatesLabel :Health ; :propagationBehavior :Inward ] ;
   :declaresConditional [ :toLabel :Holder ; :hasCondition [ a :CompositeCondition ; :logicalOperator :AND ;
       :hasCondition [ a :ContainsLabelCondition ; :requiresContains :Direct ] ; :hasCondition [ a :RelationLabelCondition ; :onRelation :Self ; :requiresLabel :Health ] ] ] .
'''


def test_terms():
    got = turtle.parse('@prefix p: <http://p#> . p:a p:b 1, -2.5, 1e3, true, "x\\n\\u00e9"@en, """a"b""", <http://o>, _:n ; a p:C . [] p:q [ p:r () ] .')
    objects = [(t[2], t[3], t[4]) for t in got]
    assert ("1", "literal", turtle.XSD + "integer") in objects and ("-2.5", "literal", turtle.XSD + "decimal") in objects and ("1e3", "literal", turtle.XSD + "double") in objects
    assert ("x\né", "literal", turtle.RDF + "langString") in objects and ("x\né", "en") in [(t[2], t[5]) for t in got] and ('a"b', "literal", turtle.XSD + "string") in objects and (turtle.RDF + "nil", "iri", None) in objects
    assert turtle.parse("<a> <b> <c> .", base="http://z/")[0][0] == "http://z/a"
    with pytest.raises(ValueError):
        turtle.parse("p:a p:b p:c .")


def test_graph_to_fixed_point(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TTL)
    triples = turtle.read(spark, str(tmp_path / "a.ttl"))
    env = graph.environment(triples, graph.rules_from_graph(triples))
    assert env.fields.count() == 3 and env.field_decls.count() == 2
    assert {tuple(r) for r in graph.list_items(triples).select("item").distinct().collect()} == {("http://x.org/v#SSN",), ("http://x.org/v#Passport",), ("http://x.org/v#Zip",)}
    result = infer(env, quasi=("IndirectIdentifier", "F"))
    assert {r[0] for r in query.query_assertions(result.assertions, label="Holder").select("container").collect()} == {"DB", "T", next(iter({r[0] for r in result.assertions.where("label = 'Direct'").select("container").collect()})), "r1"}
    assert result.k.select("table", "k").collect()[0].asDict() == {"table": "T", "k": 2}


def test_folder_module(spark, tmp_path):
    """A folder with a manifest and one without: model, rule text and CONSTRUCT change the fixed point."""
    from labelweave.plans import engine
    from labelweave.sources import frameworks

    for name in ("with", "without"):
        d = tmp_path / name
        d.mkdir()
        (d / "own.toml").write_text('name = "Own"\ntype = "custom"\nlabels = ["Seen", "Known"]\n[[propagation]]\nlabel = "Seen"\ndirection = "Outward"\n')
        (d / "model.ttl").write_text("@prefix : <http://x.org/v#> . @prefix a: <http://x.org/a#> . a:T a :Table ; :availableInScope a:S . a:DB :hasTables a:T ; :availableInScope a:S .")
        (d / "seen.rq").write_text("CONSTRUCT { ?n <assertedOn> 'T' . ?n <assertsLabel> 'Seen' . ?n <assertedInScope> ?g . ?n <assertedByFramework> 'Own' } WHERE { 'T' <availableInScope> ?g . BIND(CONCAT('n', ?g) AS ?n) }")
        (d / "known.rules").write_text('[k: (?a assertsLabel "Seen") (?a assertedOn ?c) (?a assertedInScope ?g) makeSkolem(?c, ?g, ?n) -> (?n assertedOn ?c) (?n assertsLabel "Known") (?n assertedInScope ?g) (?n assertedByFramework "Own")]')
    (tmp_path / "with" / "framework.toml").write_text('name = "Top"\ntype = "core"\nmodel = ["model.ttl"]\nrules = ["known.rules"]\nconstructs = ["seen.rq"]\n')
    modules = [frameworks.Modules().load(tmp_path / "with").load(tmp_path / "with" / "own.toml"), frameworks.Modules().load(tmp_path / "without")]
    for m in modules:
        env = m.environment(spark)
        facts = engine.infer(env, with_k=False, extra=tuple(m.in_rounds(env))).assertions
        got = {(r["container"], r["label"], r["scope"]) for r in facts.where("label IN ('Seen', 'Known')").collect()}
        assert got == {(c, label, "S") for c in ("T", "DB") for label in ("Seen", "Known")}
    with pytest.raises(ValueError):
        frameworks.Modules()._add({"name": "x", "depends_on": ["absent"]})


def test_scaled_environment(spark):
    env = E.from_rows(spark, fields=[("r/a", "r", "t", "a", "1", "string"), ("r/b", "r", "t", "b", "2", "string"), ("q/a", "q", "u", "a", "3", "string")], contains=[("t", "r"), ("r", "r/a"), ("r", "r/b"), ("u", "q"), ("q", "q/a")])
    big = inputs.scaled(env, 4)
    assert {r["table"]: r["n"] for r in big.fields.groupBy("table").agg(F.count_distinct("record").alias("n")).collect()} == {"t": 4, "u": 4}
    edges = {tuple(r) for r in big.contains.collect()}
    assert {(r["table"], r["record"]) for r in big.fields.collect()} | {(r["record"], r["field"]) for r in big.fields.collect()} == edges
    assert {r["value"] for r in big.fields.where("name = 'b'").collect()} == {"2"}
