"""Results as files and text."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.env import KEY
from labelweave.operators import closure
from labelweave.operators.rules import AVAILABLE

#: Rows that a rendering brings to the driver unless asked otherwise. One that leaves rows out says so; limit=None leaves out none.
SHOWN = 10_000
XSD = "http://www.w3.org/2001/XMLSchema#"
_DATATYPES = {T.BooleanType: "boolean", T.ByteType: "integer", T.ShortType: "integer", T.IntegerType: "integer", T.LongType: "integer", T.FloatType: "double", T.DoubleType: "double", T.DecimalType: "decimal", T.DateType: "date", T.TimestampType: "dateTime", T.TimestampNTZType: "dateTime"}


def export_triples(triples: DataFrame, path: str) -> None:
    """A line `s p o .` for each triple, as text files."""
    triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value")).write.mode("overwrite").text(path)


def to_json(df: DataFrame) -> DataFrame:
    """A JSON object per row; nulls are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def _shown(df: DataFrame, limit: int | None) -> tuple[list, bool]:
    """(rows, whether there are more)."""
    rows = df.collect() if limit is None else df.limit(limit + 1).collect()
    return (rows, False) if limit is None or len(rows) <= limit else (rows[:limit], True)


def _binding(value: object, kind: T.DataType) -> dict:
    if datatype := _DATATYPES.get(type(kind)):
        text = str(value).lower() if isinstance(value, bool) else value.isoformat() if hasattr(value, "isoformat") else str(value)
        return {"type": "literal", "value": text, "datatype": XSD + datatype}
    if isinstance(value, str) and value.startswith("_:"):
        return {"type": "bnode", "value": value[2:]}
    if isinstance(value, str) and re.match(r"(https?|urn|tel|mailto|file):[^\s<>\"]*$", value):
        return {"type": "uri", "value": value}
    return {"type": "literal", "value": str(value)}


def bindings(df: DataFrame, limit: int | None = SHOWN) -> str:
    """The result format of SPARQL queries: values are typed by their column, texts are URIs or blank nodes if they read so. Where rows are left out (limit), the head
    has "truncated": true."""
    rows, more = _shown(df, limit)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    head = {"vars": df.columns} | ({"truncated": True} if more else {})
    return json.dumps({"head": head, "results": {"bindings": [{k: _binding(v, kinds[k]) for k, v in r.asDict().items() if v is not None} for r in rows]}})


def parse_value(x: object) -> object:
    """An IRI as `:fragment`, else an integer, a float or the text."""
    if not isinstance(x, str):
        return x
    if re.match(r"https?://|urn:", x):
        return ":" + (x.rsplit("#", 1)[-1] if "#" in x else x.rstrip("/").rsplit("/", 1)[-1])
    for kind in (int, float):
        try:
            return kind(x)
        except ValueError:
            pass
    return x


def render(df: DataFrame, mode: str = "table", sort: bool = False, limit: int | None = SHOWN) -> str:
    """tuples, json or table; with sort, rows in order of all columns. A last line says if rows are left out (limit)."""
    if mode not in ("tuples", "json", "table"):
        raise ValueError("mode: tuples, json or table")
    df = df.orderBy(*df.columns) if sort else df
    if mode == "json":
        return bindings(df, limit)
    found, more = _shown(df, limit)
    rows, rest = [tuple(map(parse_value, r)) for r in found], [f"... more than the {limit} rows shown"] if more else []
    if not rows:
        return "No results"
    if mode == "tuples":
        return "\n".join([*map(repr, rows), *rest])
    cells = [list(df.columns), *([("" if v is None else str(v)) for v in r] for r in rows)]
    widths = [max(len(r[k]) for r in cells) for k in range(len(df.columns))]
    lines = [" | ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in cells]
    return "\n".join([lines[0], "-+-".join("-" * w for w in widths), *lines[1:], *rest])


def diff(stratum: str, round_: int, facts: DataFrame, n: int, shown: int = 20) -> None:
    """For the engine's `watch`: a round's first new facts, and how many more there are."""
    print(f"{stratum} round {round_}: {n} new facts")
    for r in facts.orderBy(*KEY).limit(shown).collect() if n else ():
        print(f"  + {r['container']} {r['label']} {r['scope']} {r['framework']} ({r['derived_via']})")
    if n > shown:
        print(f"  ... and {n - shown} more")


def forest_rows(result, depth: int = 10) -> DataFrame:
    """(scope, path, depth, container, assertions): available containers in order of their path, with `label [framework] (params)`."""
    tree = closure.forest(result.env.contains, result.env.containers, depth)
    shown = result.assertions.where(F.col("label") != AVAILABLE)
    params = F.when(F.size("params") > 0, F.concat(F.lit(" ("), F.array_join(F.array_sort(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ", "), F.lit(")"))).otherwise(F.lit(""))
    text = shown.groupBy("container", "scope").agg(F.array_sort(F.collect_set(F.concat("label", F.lit(" ["), "framework", F.lit("]"), params))).alias("assertions"))
    return tree.join(result.available, "container").join(text, ["container", "scope"], "left").select("scope", "path", "depth", "container", "assertions").orderBy("scope", "path")


def forest(result, depth: int = 10, limit: int | None = SHOWN) -> str:
    """forest_rows as indented text. A last line says if containers are left out (limit)."""
    out, scope = [], None
    rows, more = _shown(forest_rows(result, depth), limit)
    for r in rows:
        if r["scope"] != scope:
            scope = r["scope"]
            out.append(f"{scope}:")
        out.append("  " * (r["depth"] + 1) + r["path"].rsplit("/", 1)[-1] if r["depth"] else f"  {r['path']}")
        out += ["  " * (r["depth"] + 2) + f"- {a}" for a in r["assertions"] or ()]
    return "\n".join([*out, *([f"... more than the {limit} containers shown"] if more else [])])
