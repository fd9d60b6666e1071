"""RDF collections by list ranking: pointer doubling from every cell towards the head, so a list of n cells takes about log2(n) rounds, each a join of narrow rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.storage import drop, observed, written

NIL = "nil"


def _is(p: Column, name: str) -> Column:
    return (p == name) | F.endswith(p, F.lit(f"#{name}"))


def cells(triples: DataFrame) -> DataFrame:
    """(cell, next) of the rest-triples of (s, p, o); predicates by their local name."""
    return triples.where(_is(F.col("p"), "rest")).select(F.col("s").alias("cell"), F.col("o").alias("next")).distinct()


def ranked(rest: DataFrame) -> DataFrame:
    """(list, cell, position) of (cell, next): a list is named by its head, a cell that is no cell's next; positions count from 0. A cell that several lists share
    has a row for each. A cycle is an error."""
    nil = lambda c: (F.col(c) == NIL) | F.endswith(F.col(c), F.lit(f"#{NIL}"))
    rest, seen = observed(rest.select("cell", "next").distinct(), "cells")
    back = rest.where(~nil("next")).join(rest.select(F.col("cell").alias("next")).distinct(), "next", "left_semi").select(F.col("next").alias("cell"), F.col("cell").alias("at"))
    heads = written(rest.select("cell").distinct().join(back.select("cell").distinct(), "cell", "left_anti"), "heads")
    first = heads.select("cell", F.col("cell").alias("at"), F.lit(0).cast("long").alias("far"), F.lit(True).alias("home"))
    marked = heads.select(F.col("cell").alias("at"), F.lit(True).alias("home"))
    steps = back.join(marked, "at", "left").select("cell", "at", F.lit(1).cast("long").alias("far"), F.coalesce("home", F.lit(False)).alias("home"))
    # what reached its head stays where it was written; a round joins those that did not with what they point at
    known, state = observed(first.unionByName(steps), "jumps", open=F.count_if(~F.col("home")))
    done, n, asked = [known.where("home")], state["n"], [known]
    for _ in range(seen["n"].bit_length() + 1):
        if not state["open"]:
            break
        away = known.where("NOT home").select("cell", F.col("at").alias("by"), F.col("far").alias("gone"))
        there = asked[0] if len(asked) == 1 else asked[0].unionByName(asked[1])
        moved = away.join(there.select(F.col("cell").alias("by"), "at", "far", "home"), "by").select("cell", "at", (F.col("gone") + F.col("far")).alias("far"), "home")
        # a cell that nothing away points at now is not asked again: what is twice as far from it goes through a cell that would
        kept = written(there.where("home").join(away.select(F.col("by").alias("cell")).distinct(), "cell", "left_semi"), "asked")
        known, state = observed(moved, "jumps", open=F.count_if(~F.col("home")))
        done.append(known.where("home"))
        drop(*asked[1:])
        asked = [known, kept]
    drop(*asked[1:])
    if state["open"] or (seen["n"] and not n):
        raise ValueError("a list that runs in a circle")
    drop(rest, heads)
    return reduce(DataFrame.unionByName, done).select(F.col("at").alias("list"), "cell", F.col("far").alias("position"))


def items(triples: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """(list, position, item) of the collections in (s, p, o). lists: (list), cells to read from, heads or not; else all heads."""
    at = ranked(cells(triples))
    if lists is not None:
        asked = at.join(lists.select(F.col("list").alias("cell")).distinct(), "cell").select("list", F.col("cell").alias("start"), F.col("position").alias("from"))
        at = at.join(asked, "list").where("position >= from").select(F.col("start").alias("list"), "cell", (F.col("position") - F.col("from")).alias("position")).distinct()
    first = triples.where(_is(F.col("p"), "first")).select(F.col("s").alias("cell"), F.col("o").alias("item"))
    return at.join(first, "cell").select("list", "position", "item")
