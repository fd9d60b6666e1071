"""Inputs, renderings, the cache, the command line and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from labelweave import cache, cli, sinks
from labelweave import env as E
from labelweave.operators import closure, query
from labelweave.plans.engine import infer
from labelweave.sources import frameworks, inputs
from labelweave.streaming import kanon as stream


@pytest.fixture(scope="module")
def small(spark):
    rules = E.Rules(subclasses=(E.Subclass("F", ("x",), "y"),), propagations=(E.Propagation("F", "Inward", label="y"),))
    return E.from_rows(
        spark, rules, containers=[("d", "database", "db"), ("t2", "table", "b"), ("t1", "table", "a")], contains=[("d", "t1"), ("d", "t2")], availability=[("d", "s")], frameworks=[("F", None, None, "core")],
        labels=[("x", "F")], tags=[("d", "x")], ground=[("t1", "z", "s", "F", {"k": "3", "a": "b"})], joinable=[("t1", "t2")],
    )


def test_forest_and_renderings(small, tmp_path):
    result = infer(small)
    text = sinks.forest(result)
    assert text.index("db") < text.index("    a") < text.index("    b") and "- z [F] (a=b, k=3)" in text and "Available" not in text
    own = result.assertions.where("label = 'y'").select("container", "label")
    assert sinks.render(own, "tuples", sort=True) == "('d', 'y')\n('t1', 'y')\n('t2', 'y')"
    assert sinks.render(own, "table", sort=True).splitlines()[0] == "container | label"
    assert json.loads(sinks.render(own, "json", sort=True))["head"]["vars"] == ["container", "label"]
    assert sinks.render(own.limit(0)) == "No results"
    assert [sinks.parse_value(x) for x in ("http://a#b", "7", "1.5", "q")] == [":b", 7, 1.5, "q"]
    assert json.loads(sinks.to_json(own.orderBy("container")).first()[0]) == {"container": "d", "label": "y"}
    triples = query.triples(result.assertions, small.contains, closure.symmetric(small.joinable), result.available)
    sinks.export_triples(triples, f"file://{tmp_path}/t")
    assert triples.sparkSession.read.text(f"file://{tmp_path}/t").count() == triples.count()


def test_cache(small, tmp_path):
    folder = f"file://{tmp_path}/cache"
    one, kept = cache.infer_cached(small, folder)
    two, again = cache.infer_cached(small, folder)
    assert not kept and again and {tuple(r) for r in one.select(*E.KEY).collect()} == {tuple(r) for r in two.select(*E.KEY).collect()}
    other = small.with_tables(tags=small.tags.limit(0))
    assert cache.content_key(small) != cache.content_key(other) != cache.content_key(other, visibility="chain")
    cache.remove(small.spark, folder)
    assert not cache.infer_cached(small, folder)[1]


def test_json_and_folders(spark, small, tmp_path):
    body = {"containers": [{"id": "a", "name": "A", "type": "Table"}, {"id": "b", "name": "B", "type": "Field", "parentId": "a"}], "scopes": [{"id": "s", "visibleContainerIds": ["a"]}], "joinable": [{"container1Id": "a", "container2Id": "b"}],
            "groundAssertions": [{"containerId": "a", "labelId": "x", "scopeId": "s", "frameworkId": "F", "parameters": {"k": "1"}}]}
    (tmp_path / "e.json").write_text(json.dumps(body))
    env = inputs.from_json(spark, f"file://{tmp_path}/e.json")
    assert {tuple(r) for r in env.availability.collect()} == {("a", "s"), ("b", "s")} and env.ground.first()["params"] == {"k": "1"}
    inputs.save(small, f"file://{tmp_path}/env")
    back = inputs.from_folder(spark, f"file://{tmp_path}/env", small.rules)
    assert cache.content_key(back) == cache.content_key(small)
    with pytest.raises(ValueError):
        E.Env(spark, {"tags": spark.createDataFrame([("a",)], "container string")})


def test_wide_tables_names_and_scaling(spark):
    wide = spark.createDataFrame([(1, "x", None), (2, "y", 5)], "id long, a string, b int")
    got = inputs.from_table(wide, "T", "id")
    assert {(r["record"], r["name"], r["value"]) for r in got["fields"].collect()} == {("T/1", "a", "x"), ("T/2", "a", "y"), ("T/2", "b", "5")}
    assert got["contains"].count() == 5
    named = spark.createDataFrame([("c1", "table", "Patient visits"), ("c2", "field", "SSN"), ("c3", "field", "other")], E.SCHEMAS["containers"])
    assert {tuple(r) for r in inputs.name_evidence(named).collect()} == {("c1", "Individual"), ("c1", "Healthcare"), ("c2", "SocialSecurityNumber")}
    more = inputs.scale_records(got["fields"], 6)
    assert more.select("record").distinct().count() == 6 and {tuple(r) for r in more.select("name", "value").distinct().collect()} == {("a", "x"), ("a", "y"), ("b", "5")}
    assert {tuple(r) for r in more.collect()} == {tuple(r) for r in inputs.scale_records(got["fields"], 6).collect()}
    assert {tuple(r) for r in inputs.scale_records(got["fields"], 1).collect()} == {tuple(r) for r in got["fields"].collect()}


def test_frameworks(tmp_path):
    with pytest.raises(ValueError):
        frameworks.Modules().load("hipaa")  # base must come first
    (tmp_path / "framework.toml").write_text('name = "Own"\nextends = "GDPRFramework"\n[[conditional]]\nto = "Big"\nwhen = ["compare", ["KAnonymityAnalysis", "minimumCohortSize"], "inRange", 2, 4]\n')
    own = frameworks.shipped("base", "gdpr").load(tmp_path)
    assert own.frameworks[-1][:2] == ("Own", "GDPRFramework") and own.rules.conditionals[-1].condition.upper == E.Operand(literal=4)
    (tmp_path / "framework.toml").write_text('name = "Own"\ntype = "odd"\n')
    with pytest.raises(ValueError):
        frameworks.Modules().load(tmp_path)
    assert [f[0] for f in frameworks.shipped().frameworks][:2] == ["BaseFramework", "HIPAAFramework"]


def test_command_line(spark, small, tmp_path, capsys):
    inputs.save(small.with_tables(ground=small.ground.withColumn("label", F.lit("Name")).withColumn("framework", F.lit("BaseFramework"))), f"file://{tmp_path}/env")
    (tmp_path / "q.sql").write_text("SELECT DISTINCT label FROM assertions WHERE framework = 'BaseFramework' AND container = 't1'")
    (tmp_path / "r.rules").write_text("[r: (?x contains ?y) -> (?y inside ?x)]")
    base = ["--frameworks", "base", "--data", f"file://{tmp_path}/env"]
    assert cli.main([*base, "--query", str(tmp_path / "q.sql"), "--sort", "--rules", str(tmp_path / "r.rules"), "--export", f"file://{tmp_path}/out", "--verbose"]) == 0
    shown = capsys.readouterr().out
    assert "DirectIdentifier" in shown and "Identifiable" in shown
    assert spark.read.text(f"file://{tmp_path}/out").where("value LIKE '% inside %'").count() == 2
    assert cli.main([*base, "--cache-dir", f"file://{tmp_path}/c"]) == 0
    assert cli.main([*base, "--display", "--display-mode", "forest"]) == 0
    assert "Name [BaseFramework]" in capsys.readouterr().out
    assert cli.main(["--compile", str(tmp_path / "r.rules")]) == 0
    assert "== Physical Plan ==" in capsys.readouterr().out
    assert cli.main(["--compile", str(tmp_path / "r.rules"), "--output", str(tmp_path / "plans"), "--separate"]) == 0
    assert [f.read_text().startswith("# r\n") for f in sorted((tmp_path / "plans").iterdir())] == [True] and capsys.readouterr().out == ""
    scope = small.availability.first()["scope"]
    assert cli.main([*base, "--debug-diff", "--prove", "t1", "DirectIdentifier", scope, "BaseFramework"]) == 0
    shown = capsys.readouterr().out
    assert "S2 round 0: " in shown and "  + " in shown and "of_container" in shown


def test_siblings_and_children(spark):
    contains = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "b"), ("q", "c")], "parent string, child string")
    assert {tuple(r) for r in closure.siblings(contains).collect()} == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("p", "q"), ("q", "p")}  # roots are siblings
    cyclic = contains.unionByName(spark.createDataFrame([("c", "q")], "parent string, child string"))
    assert ("q", "q") in {tuple(r) for r in closure.ancestors(cyclic).collect()}
    with pytest.raises(RuntimeError):
        closure.grow(spark.range(1).selectExpr("id"), lambda d: d.selectExpr("id + 1 AS id"), max_rounds=3)


def test_stream_of_cohorts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = stream.k_by_window(stream.cohorts(events, "ts", "user_id", ["event_type"], "1 day"))
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    running = stream.write_k(source, f"{tmp_path}/k", f"{tmp_path}/state", time="ts", record="user_id", quasi=["event_type"], window="1 day")
    running.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/k").select("window_start", "k").collect()}
    assert got and got <= {tuple(r) for r in want.collect()}


def test_top_new_counts_rows(spark):
    """Rows that stand several times, before and now, and missing values: as EXCEPT ALL, in order, without its unfolding of all rows before the first are taken."""
    rows = lambda x: spark.createDataFrame([(a, b) for a, b in x], "a string, b int")
    now, before = rows([("x", 1)] * 5 + [("a", None)] * 3 + [(None, 2)] * 2 + [("b", 7), ("c", 1)]), rows([("x", 1)] * 2 + [("a", None), ("b", 7), ("z", 1)])
    for n in (1, 3, 5, 20):
        got = query.top_new(now, before, n)
        assert got.columns == ["a", "b"] and got.collect() == now.exceptAll(before).orderBy("a", "b").limit(n).collect()
    plan = query.top_new(now, before, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.find("GlobalLimit", plan.index("Generate")) < plan.index("Aggregate")  # few rows are repeated
