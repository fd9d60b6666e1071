"""Command line: load frameworks and data, infer, query, show."""

from __future__ import annotations

import argparse
import re
import sys
from pathlib import Path

from pyspark.sql import functions as F

from labelweave import sinks
from labelweave.cache import infer_cached, remove
from labelweave.env import KEY, Env
from labelweave.operators import closure, query
from labelweave.plans import engine, ruletext, sparql
from labelweave.session import local_session
from labelweave.sources import frameworks, graph, inputs, turtle


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m labelweave.cli", description=__doc__)
    p.add_argument("--frameworks", nargs="*", default=[], help="names of shipped frameworks, .toml files or folders, in order")
    p.add_argument("--data", nargs="*", default=[], help=".ttl files (frameworks in them are read too), .json environments or folders of Parquet tables")
    p.add_argument("--query", nargs="*", default=[], help="SQL files over the views assertions, containers, contains, ...; .rq files are SPARQL over the result's triples")
    p.add_argument("--construct", nargs="*", default=[], help="SPARQL CONSTRUCT files: facts that they make count in the rounds, and the result's triples are saturated with them")
    p.add_argument("--upsert", nargs="*", default=[], help="SPARQL INSERT and DELETE files: what they insert counts in the rounds, what they delete is taken back with all that rests on it")
    p.add_argument("--rules", nargs="*", default=[], help="rule texts, run over the triples of the result")
    p.add_argument("--export", help="folder for the result's triples")
    p.add_argument("--max-rounds", type=int, default=1000)
    p.add_argument("--verbose", action="store_true", help="facts by round and rule")
    p.add_argument("--debug-diff", action="store_true", help="the first new facts of each round, as it ends")
    p.add_argument("--prove", nargs=4, action="append", default=[], metavar=("CONTAINER", "LABEL", "SCOPE", "FRAMEWORK"), help="the steps from given facts to this one; may be repeated")
    p.add_argument("--display", action="store_true")
    p.add_argument("--display-mode", choices=("forest", "tuples", "json", "table"), default="table")
    p.add_argument("--sort", action="store_true")
    p.add_argument("--cache-dir", help="keep results under a hash of the inputs")
    p.add_argument("--rm-cache", action="store_true")
    p.add_argument("--compile", nargs="*", default=[], help="print what rule texts compile to, and stop")
    p.add_argument("--output", help="with --compile: a file to write to, or with --separate a folder")
    p.add_argument("--separate", action="store_true", help="with --compile: a file for each rule")
    return p


def load(args) -> frameworks.Modules:
    modules = frameworks.Modules()
    for f in args.frameworks:
        modules.load(f)
    modules.constructs += [Path(p).read_text() for p in args.construct]
    modules.updates += [Path(p).read_text() for p in args.upsert]
    return modules


def environment(spark, args, modules: frameworks.Modules) -> Env:
    envs = [modules.environment(spark)]
    for group, read in ((".ttl", lambda files: _graph(spark, files)), (".json", lambda files: inputs.merge(*(inputs.from_json(spark, f) for f in files)))):
        if files := [d for d in args.data if d.endswith(group)]:
            envs.append(read(files))
    envs += [inputs.from_folder(spark, d) for d in args.data if not d.endswith((".ttl", ".json"))]
    return inputs.merge(*envs)


def _graph(spark, files) -> Env:
    triples = turtle.read(spark, *files)
    return graph.environment(triples, graph.rules_from_graph(triples))


def compiled(spark, args) -> int:
    """The plans that rule texts compile to: to the screen, one file, or a file for each rule."""
    texts = {}
    for path in args.compile:
        for rule in ruletext.read_rules(path):
            plan = ruletext.apply_rule(rule, spark.createDataFrame([], ruletext.TRIPLES))._jdf.queryExecution().toString()
            texts[rule.name] = texts.get(rule.name, "") + f"# {rule.name}\n{plan}\n"
    if args.separate:
        if not args.output:
            raise SystemExit("--separate needs --output, a folder")
        Path(args.output).mkdir(parents=True, exist_ok=True)
        for k, (name, text) in enumerate(texts.items()):
            (Path(args.output) / f"{k:03d}-{re.sub(r'[^A-Za-z0-9_.-]', '_', name)}.txt").write_text(text)
    elif args.output:
        Path(args.output).write_text("".join(texts.values()))
    else:
        print("".join(texts.values()), end="")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = local_session()
    if args.compile:
        return compiled(spark, args)
    if args.rm_cache and args.cache_dir:
        remove(spark, args.cache_dir)
    modules = load(args)
    env = environment(spark, args, modules)
    extra, retracts = tuple(modules.in_rounds(env)), tuple(modules.retracts(env))
    if args.cache_dir and not (args.display or args.prove or args.debug_diff or extra or retracts):
        assertions, kept = infer_cached(env, args.cache_dir, max_rounds=args.max_rounds)
        assertions.createOrReplaceTempView("assertions")
        for name, df in env.tables.items():
            df.createOrReplaceTempView(name)
        print("kept result" if kept else "new result", file=sys.stderr)
    else:
        result = engine.infer(env, max_rounds=args.max_rounds, extra=extra, retracts=retracts, watch=sinks.diff if args.debug_diff else None)
        result.register_views()
        assertions = result.assertions
        if args.verbose:
            print(sinks.render(result.metrics_table().orderBy(F.desc("seconds"), "stratum", "round", "derived_via")))
        if args.prove:
            proof = result.proofs(spark.createDataFrame([tuple(x) for x in args.prove], ", ".join(f"{k} string" for k in KEY)))
            print(sinks.render(proof.orderBy(F.desc("round"), *KEY, "part")))
        if args.display:
            print(sinks.forest(result) if args.display_mode == "forest" else sinks.render(assertions.select("scope", "container", "framework", "label"), args.display_mode, args.sort))
    mode = args.display_mode if args.display_mode != "forest" else "table"
    sparql_files = [q for q in args.query if q.endswith(".rq")]
    triples = None
    if args.export or args.rules or modules.constructs or args.upsert or sparql_files:
        triples = query.triples(assertions, env.contains, closure.symmetric(env.joinable), closure.available(env.availability, env.contains))
        if args.rules:
            triples = ruletext.run_rules([r for p in args.rules for r in ruletext.read_rules(p)], triples.selectExpr("s", "p", "o", "'iri' AS kind"))[0]
        if modules.constructs or args.upsert:
            triples = sparql.saturate(modules.constructs, triples, [Path(p).read_text() for p in args.upsert])[0]
    for path in args.query:
        text = Path(path).read_text()
        print(sinks.render(sparql.query(text, triples) if path in sparql_files else spark.sql(text), mode, args.sort))
    if args.export:
        sinks.export_triples(triples, args.export)
    return 0


if __name__ == "__main__":
    sys.exit(main())
