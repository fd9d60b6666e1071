"""The registered queries against their SQL, the plain versions, and the pipeline's stages on their own inputs."""

import brute
import corpus
import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from labelweave.llm import common, queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda df: sorted(tuple(None if x != x or x is None else x for x in r) for r in df[columns].astype(object).itertuples(index=False, name=None))
    assert sorted(map(repr, plain(got.where(got.notna(), None)))) == sorted(map(repr, plain(want.astype(object).where(want.notna(), None)))) or [tuple(map(str, r)) for r in plain(got)] == [tuple(map(str, r)) for r in plain(want)]


@pytest.mark.parametrize("name, plain", [("op3_simhash_near_dedup", brute.simhash), ("op4_substring_dedup", brute.passages), ("op7_suffix_array_dedup", brute.repeats)])
def test_plain(name, plain, spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    columns = {"op3": ["doc_id", "fingerprint", "component_id"], "op4": ["doc_id", "n_words", "n_removed", "kept_sha256"], "op7": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]}[name[:3]]
    assert corpus.as_set(queries.queries()[name](spark, sf_dir).select(*columns).collect()) == corpus.as_set(plain(rows))


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in queries.queries()}
    assert set(queries.queries()) | {"pipeline"} <= set(__spark_entry__.queries())


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        out = common.written(stage(spark, docs, sf_dir))
        left = {r["doc_id"]: r for r in out.collect()}
        if k < 4:
            assert out.columns == columns
        if name == "quality_rules":
            assert not {r[0] for r in brute.quality(rows) if r[-1]} & set(left)
        elif name == "simhash_near_dedup":
            roots = brute.near(rows)
            groups = {}
            for (d, _), r in zip(rows, roots):
                groups.setdefault(r, []).append(d)
            assert set(left) == {min(g) for g in groups.values()}
        elif name == "suffix_array_dedup":
            assert len(left) == len(rows)
            want = {d: bytes(b for b, g in zip(data, gone) if not g).decode(errors="ignore") for d, data, gone in brute._windows(rows, lambda t: (t or "").encode(), 50)}
            assert {d: r["text"] for d, r in left.items()} == want and all(r["n_chars"] == len(r["text"]) for r in left.values())
        elif name == "benchmark_decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(left) == {r[0] for r in brute.contaminated(rows, items) if not r[-1]}
        else:
            assert set(left) == {d for d, _ in rows} and all(len(r["ids"]) == r["n_tokens"] for r in left.values())
        docs = out


def test_shuffle_files_of_a_stage_go_before_the_next(spark, sf_dir, monkeypatch):
    went = []
    settled = corpus_pipeline.common.settled
    monkeypatch.setattr(corpus_pipeline.common, "settled", lambda df, what: went.append(what) or settled(df, what))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(x, lambda spark, docs, sf_dir: docs.repartition(3, "doc_id")) for x in "abc"])
    assert corpus_pipeline.run(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and went == ["a", "b"]
