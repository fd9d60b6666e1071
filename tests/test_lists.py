"""Collections: shared ends, lists read from the middle, long ones, circles; lists in rule texts."""

import pytest
from pyspark.sql import functions as F

from labelweave.operators import lists
from labelweave.plans import ruletext

LIST = [("a", "rest", "b"), ("b", "rest", "c"), ("c", "rest", "nil"), ("x", "rest", "b"), ("one", "rest", "nil"), ("a", "first", "1"), ("b", "first", "2"), ("c", "first", "2"), ("x", "first", "9"), ("one", "first", "7"), ("h", "members", "a")]


def triples(spark, rows=LIST):
    return spark.createDataFrame(rows, "s string, p string, o string")


def test_items(spark):
    got = {tuple(r) for r in lists.items(triples(spark)).collect()}
    assert got == {("a", 0, "1"), ("a", 1, "2"), ("a", 2, "2"), ("x", 0, "9"), ("x", 1, "2"), ("x", 2, "2"), ("one", 0, "7")}
    asked = spark.createDataFrame([("b",), ("one",), ("none",)], "list string")
    assert {tuple(r) for r in lists.items(triples(spark), asked).collect()} == {("b", 0, "2"), ("b", 1, "2"), ("one", 0, "7")}
    assert lists.items(triples(spark, []), asked).count() == 0


@pytest.mark.parametrize("rows", [[("a", "rest", "b"), ("b", "rest", "a")], [("h", "rest", "a"), ("a", "rest", "b"), ("b", "rest", "a")], [("a", "rest", "a")]])
def test_circles(spark, rows):
    with pytest.raises(ValueError):
        lists.items(triples(spark, rows))


def test_long_list(spark):
    n = 100_000
    rest = spark.range(n).select(F.col("id").cast("string").alias("cell"), F.when(F.col("id") == n - 1, "nil").otherwise((F.col("id") + 1).cast("string")).alias("next"))
    got = lists.ranked(rest)
    assert got.where("list = '0' AND cast(position AS string) = cell").count() == n


def test_list_contains(spark):
    known = triples(spark, [*LIST, ("k", "text", "2 3")]).withColumn("kind", F.lit("iri"))
    ask = lambda p, item: {r["s"] for r in ruletext.apply_rule(ruletext.parse_rules(f'[r: (?x {p} ?l) listContains(?l, "{item}") -> (?x has "it")]')[0], known).collect()}
    assert ask("members", "2") == {"h"} and ask("members", "9") == set() and ask("text", "3") == {"k"} and ask("text", "4") == set()


def test_rounds_write_only_cells_that_have_not_reached_their_head(spark, monkeypatch):
    rest = [(f"s{i}a", f"s{i}b") for i in range(200)] + [(f"s{i}b", "nil") for i in range(200)] + [(f"l{i:02}", f"l{i + 1:02}" if i < 63 else "nil") for i in range(64)] + [("m", "l10")]
    wrote, observed = [], lists.observed

    def counting(df, what, **more):
        out, seen = observed(df, what, **more)
        wrote.append((what, seen["n"]))
        return out, seen

    monkeypatch.setattr(lists, "observed", counting)
    got = sorted(map(tuple, lists.ranked(spark.createDataFrame(rest, "cell string, next string")).collect()))
    want = [x for i in range(200) for x in ((f"s{i}a", f"s{i}a", 0), (f"s{i}a", f"s{i}b", 1))] + [("l00", f"l{i:02}", i) for i in range(64)] + [("m", "m", 0)] + [("m", f"l{i:02}", i - 9) for i in range(10, 64)]
    assert got == sorted(want)
    assert sum(n for what, n in wrote if what == "jumps") < 2 * len(want)
