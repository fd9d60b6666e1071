"""Steps of rules drop labels that no rule names before anything is made distinct."""

from labelweave.operators import rules as R


def test_labels_are_dropped_below_what_is_made_distinct(spark):
    rows = spark.createDataFrame([("c", "x", "s", "F"), ("c", "x", "s", "G"), ("c", "z", "s", "F"), ("c", "y", "s", "F")], "container string, label string, scope string, framework string")
    one = R.rule_table(spark, [("F", "r", "x", "t")], "framework string, rule string, source string, target string")
    every = R.rule_table(spark, [("F", "r", ["x", "y"], "t")], "framework string, rule string, sources array<string>, target string")
    for out in (R.implication(R.labelled(rows), one), R.subclass(R.labelled(rows), one), R.implication_all(R.labelled(rows), every)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        deepest = plan.rindex("Aggregate [container")
        assert "LeftSemi" in plan[deepest:]  # below the grouping that makes facts distinct
        assert [tuple(r) for r in out.collect()] == [("c", "t", "s", "F", "r")]


def test_tags_are_not_dealt_by_label(spark, monkeypatch):
    spark_rows = lambda rows, schema: spark.createDataFrame(rows, schema)
    tag, labels = spark_rows([("c", "x"), ("d", "x")], "container string, label string"), spark_rows([("x", "F"), ("x", "G")], "label string, introduced_by string")
    avail, fields = spark_rows([("c", "s"), ("t", "s")], "container string, scope string"), spark_rows([("f", "t", "n")], "field string, table string, name string")
    decls = spark_rows([("t", "n", "x")], "table string, name string, label string")
    for out, want in ((R.tags(tag, labels, avail), "c"), (R.field_declarations(decls, fields, labels, avail), "f")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [label" in plan and "Cartesian" not in plan
        assert sorted(map(tuple, out.collect())) == [(want, "x", "s", "F"), (want, "x", "s", "G")]
    monkeypatch.setattr(R, "MAX_RULES", 1)  # more labels than are broadcast: dealt, with the same rows
    assert sorted(map(tuple, R.tags(tag, labels, avail).collect())) == [("c", "x", "s", "F"), ("c", "x", "s", "G")]
