import pytest

from labelweave.plans import ruletext as X


@pytest.fixture(scope="module")
def triples(spark):
    rows = [("a", "contains", "b", "iri"), ("b", "contains", "c", "iri"), ("c", "contains", "a", "iri"), ("b", "age", "7", "literal"), ("c", "age", "30", "literal"), ("a", "name", "x#y", "literal"), ("a", "likes", "a", "iri")]
    return spark.createDataFrame(rows, X.TRIPLES)


def run(text, triples):
    return {tuple(r) for r in X.run_rules(X.parse_rules(text), triples)[0].select("s", "p", "o").collect()} - {tuple(r) for r in triples.select("s", "p", "o").collect()}


def test_closure_over_a_cycle(triples):
    assert run("[t: (?x contains ?y) (?y contains ?z) -> (?x contains ?z)]", triples) == {(a, "contains", b) for a in "abc" for b in "abc"} - {("a", "contains", "b"), ("b", "contains", "c"), ("c", "contains", "a")}


def test_builtins(triples):
    assert run("[r: (?x age ?n) greaterThan(?n, 9) sum(?n, 1, ?m) -> (?x next ?m)]", triples) == {("c", "next", "31")}
    assert run('[r: (?x name ?n) regex(?n, "#") strConcat(?n, "!", ?m) -> (?x loud ?m)]  # a comment', triples) == {("a", "loud", "x#y!")}
    assert run("[r: (?x contains ?y) noValue(?y age ?n) -> (?y is young)]", triples) == {("a", "is", "young")}
    assert run("[r: (?x likes ?x) isURI(?x) makeSkolem(?k, ?x, ?k2) -> (?x is own)]".replace("makeSkolem(?k, ?x, ?k2)", "makeSkolem(?x, ?k)"), triples) == {("a", "is", "own")}
    assert run("[r: (?x age ?n) isLiteral(?n) notEqual(?n, 7.0) -> (?x is other)]", triples) == {("c", "is", "other")}


def test_errors(triples):
    for bad in ("[r: (?x p) -> (?x q r)]", "[r: (?x p ?y) magic(?y) -> (?x q r)]", "[r: (?x p ?y) -> (?z q r)]"):
        with pytest.raises(ValueError):
            X.parse_rules(bad)
    with pytest.raises(ValueError):
        X.run_rules(X.parse_rules("[r: (?x age ?y) makeTemp(?z) -> (?x q ?z)]"), triples)
    assert X.apply_rule(X.parse_rules("[r: (?x age ?y) makeTemp(?z) -> (?x q ?z)]")[0], triples).count() == 2
