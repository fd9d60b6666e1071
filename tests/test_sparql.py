import pytest

from labelweave.plans import sparql

P = "PREFIX : <http://x#> PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> "
ROWS = """a1 on t1|a1 label PHI|a1 scope R|a1 by H|a2 on t2|a2 label PD|a2 scope R|a2 by G|a3 on t1|a3 label PD|a3 scope R|a3 by G|a4 on t1|a4 label PD|a4 scope M|a4 by G|a3 k 3|a2 k 12
db has t1|db has t2|t1 has f1|t2 has f2|l1 first x|l1 rest l2|l2 first y|l2 rest nil|r any l1|t1 name A|f1 join f2"""


@pytest.fixture(scope="module")
def triples(spark):
    known = {"first": sparql.RDF_TYPE[:-4] + "first", "rest": sparql.RDF_TYPE[:-4] + "rest"}
    name = lambda x: x if x.isdigit() or x == "A" else "http://x#" + x
    return spark.createDataFrame([(name(s), known.get(p, "http://x#" + p), name(o)) for s, p, o in (r.split() for r in ROWS.replace("\n", "|").split("|"))], "s string, p string, o string").coalesce(1)


def run(text, triples):
    return [tuple(x and x.replace("http://x#", "") if isinstance(x, str) else x for x in r) for r in sparql.query(P + text, triples).collect()]


CASES = {
    "SELECT DISTINCT ?c ?l WHERE { ?a :on ?c ; :label ?l ; :scope :R . FILTER(?l IN (:PHI, :PD)) } ORDER BY ?c DESC(?l)": [("t1", "PHI"), ("t1", "PD"), ("t2", "PD")],
    "SELECT ?a ?k WHERE { ?a :label :PD . OPTIONAL { ?a :k ?k } } ORDER BY ?a": [("a2", "12"), ("a3", "3"), ("a4", None)],
    "SELECT ?a (IF(BOUND(?k) && ?k < 12, 'NO', 'YES') AS ?v) WHERE { ?a :by :G OPTIONAL { ?a :k ?k FILTER(?k > 3) } } ORDER BY ?a": [("a2", "YES"), ("a3", "YES"), ("a4", "YES")],
    "SELECT ?c WHERE { ?x :has ?c . FILTER NOT EXISTS { ?a :on ?c } } ORDER BY ?c": [("f1",), ("f2",)],
    "SELECT ?c WHERE { :db :has ?c . FILTER EXISTS { ?a :on ?c ; :scope ?g . FILTER(?g = :M) } }": [("t1",)],
    "SELECT ?a ?b WHERE { ?a :on ?c . ?b :on ?c . FILTER(?a != ?b && STR(?a) < STR(?b)) } ORDER BY ?a ?b": [("a1", "a3"), ("a1", "a4"), ("a3", "a4")],
    "SELECT ?c (COUNT(DISTINCT ?l) AS ?n) (GROUP_CONCAT(DISTINCT ?s; separator=';') AS ?g) WHERE { ?a :on ?c ; :label ?l ; :scope ?s } GROUP BY ?c HAVING (COUNT(?a) > 1)": [("t1", "2", "M;http://x#R".replace("http://x#", ""))],
    "SELECT (MIN(?k) AS ?m) (MAX(?k) AS ?x) (SUM(?k) AS ?s) (AVG(?k) AS ?v) (COUNT(*) AS ?n) WHERE { ?a :k ?k }": [("3", "12", "15", "7.5", "2")],
    "SELECT ?i WHERE { :r :any/rdf:rest*/rdf:first ?i } ORDER BY ?i": [("x",), ("y",)],
    "SELECT ?d WHERE { :db :has+ ?d } ORDER BY ?d": [("f1",), ("f2",), ("t1",), ("t2",)],
    "SELECT ?p WHERE { :f1 ^:has ?p }": [("t1",)],
    "SELECT ?x WHERE { { :db :has ?x } UNION { ?x :join ?y } MINUS { ?x :name ?n } } ORDER BY ?x": [("f1",), ("t2",)],
    "SELECT ?v ?w WHERE { VALUES ?v { :a :b } VALUES (?w) { (1) } } ORDER BY ?v": [("a", "1"), ("b", "1")],
    "SELECT ?n WHERE { { SELECT ?c (COUNT(?a) AS ?n) WHERE { ?a :on ?c } GROUP BY ?c } FILTER(?n >= 2) }": [("3",)],
    "SELECT ?u WHERE { :t1 :name ?n BIND(CONCAT('urn:', ENCODE_FOR_URI('a b/~'), STRAFTER(STR(:t1), '#'), LCASE(?n), STR(2 * 3 - 1)) AS ?u) }": [("urn:a%20b%2F~t1a5",)],
    "SELECT ?a WHERE { ?a :k ?k FILTER(?k + 1 > 12 || !BOUND(?k)) }": [("a2",)],
    "SELECT ?a WHERE { ?a :by :G } ORDER BY DESC(?a) LIMIT 1 OFFSET 1": [("a3",)],
    "CONSTRUCT { ?c :labelled ?l } WHERE { ?a :on ?c ; :label ?l ; :by :H }": [("t1", "labelled", "PHI")],
}


@pytest.mark.parametrize("text", CASES)
def test_query(text, triples):
    assert run(text, triples) == [tuple(x for x in r) for r in CASES[text]]


def test_update(triples):
    got = sparql.update(P + "DELETE { ?a :k ?k } INSERT { ?a :size ?n } WHERE { ?a :k ?k BIND(?k * 2 AS ?n) }", triples)
    assert {(r[0][9:], r[2]) for r in got.where("p = 'http://x#size'").collect()} == {("a2", "24"), ("a3", "6")} and not got.where("p = 'http://x#k'").count()


def test_saturate(triples):
    texts = [P + "CONSTRUCT { ?a :has ?c } WHERE { ?a :has ?b . ?b :has ?c }", P + "CONSTRUCT { ?y :join ?x } WHERE { ?x :join ?y }"]
    got, rounds = sparql.saturate(texts, triples, [P + "INSERT { ?a :checked 'yes' } WHERE { ?a :k ?k FILTER NOT EXISTS { ?a :checked ?z } }"])
    assert rounds <= 3 and got.where("p = 'http://x#has'").count() == 6 and got.where("p = 'http://x#join'").count() == 2 and got.where("o = 'yes'").count() == 2


def test_errors(triples):
    for bad in ("SELECT ?x WHERE { ?x y:z ?w }", "SELECT ?x { ?x :p ", "SELECT ?x WHERE { ?x :a/?v ?w }"):
        with pytest.raises(ValueError):
            sparql.query(P + bad, triples)


def test_ask_and_describe(triples):
    assert run("ASK { ?a :label :PHI }", triples) == [(True,)] and run("ASK WHERE { ?a :label :none }", triples) == [(False,)]
    assert run("DESCRIBE :t1", triples) and {r[0] for r in run("DESCRIBE :db ?c WHERE { ?a :on ?c ; :label :PHI }", triples)} == {"db", "t1"}
    assert {r[0] for r in run("DESCRIBE * WHERE { ?a :on :t2 }", triples)} == {"a2"} and run("DESCRIBE :nobody", triples) == []
    for text in ("DESCRIBE ?a", "DESCRIBE", "ASK { ?a :on ?c } LIMIT 1"):
        with pytest.raises(ValueError):
            run(text, triples)
