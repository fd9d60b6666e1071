"""Rules as text, `[name: (s p o) (o p2 x) greaterThan(x, 3) -> (s p3 x)]`, compiled to joins over a triples table.

Triples: (s, p, o, kind), kind of the object: iri, literal or bnode. A pattern is a filter and a projection; patterns join on the variables
they share; built-ins become filters and columns, noValue an anti-join, in the order given. `run_rules` takes a rule set to its fixed
point, semi-naively: after the first round a rule is joined once for each pattern that the last round's triples can match, with that pattern over them alone.
makeTemp gives a fresh node per row and may not stand in a rule that is run to a fixed point.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.functions import builtins
from labelweave.operators import lists
from labelweave.operators.closure import grow  # noqa: F401  (linear rule sets may use it)
from labelweave.storage import written

TRIPLES = "s string, p string, o string, kind string"
_TERM = re.compile(r'"(?:[^"\\]|\\.)*"(?:\^\^\S+|@\w+)?|<[^>]*>|[^\s,()]+')


@dataclass(frozen=True)
class Rule:
    name: str
    body: tuple  # ("triple", (s, p, o)) or (builtin, (arg, ...))
    head: tuple[tuple[str, str, str], ...]

    @property
    def patterns(self) -> list[tuple]:
        return [args for kind, args in self.body if kind == "triple"]

    @property
    def variables(self) -> set[str]:
        return {t for kind, args in self.body for t in args if t.startswith("?")}


def _without_comments(text: str) -> str:
    text = re.sub(r"/\*.*?\*/", " ", text, flags=re.S)
    # '#' begins a comment only outside quotes and IRIs
    return "\n".join(re.sub(r'^((?:[^#"<]|"(?:[^"\\]|\\.)*"|<[^>]*>|<)*)#.*$', r"\1", line) for line in text.splitlines())


def parse_rules(text: str) -> list[Rule]:
    out, text = [], _without_comments(text)
    for found in re.finditer(r"\[\s*([\w.-]+)\s*:(.*?)->(.*?)\]", text, flags=re.S):
        body = []
        for name, args in re.findall(r'(\w+)?\s*\(((?:"(?:[^"\\]|\\.)*"|[^()"])*)\)', found[2]):
            terms = tuple(_TERM.findall(args))
            if not name and len(terms) != 3:
                raise ValueError(f"rule {found[1]}: a triple has three terms: {args!r}")
            if name and name not in {*builtins.FILTERS, *builtins.VALUES, *builtins.KINDS, "noValue", "makeTemp"}:
                raise ValueError(f"rule {found[1]}: unknown built-in {name}")
            body.append((name or "triple", terms))
        head = tuple(tuple(_TERM.findall(args)) for args in re.findall(r'\(((?:"(?:[^"\\]|\\.)*"|[^()"])*)\)', found[3]))
        if not head or any(len(h) != 3 for h in head):
            raise ValueError(f"rule {found[1]}: the head needs triples")
        rule = Rule(found[1], tuple(body), head)
        if unbound := {t for h in head for t in h if t.startswith("?")} - rule.variables:
            raise ValueError(f"rule {found[1]}: unbound {sorted(unbound)}")
        out.append(rule)
    return out


def read_rules(path: str) -> list[Rule]:
    return parse_rules(Path(path).read_text())


def _constant(term: str) -> str:
    if term[0] == '"':
        return re.sub(r"\\(.)", r"\1", re.match(r'"((?:[^"\\]|\\.)*)"', term)[1])
    return term[1:-1] if term[0] == "<" else term


def _pattern(triples: DataFrame, terms: tuple[str, str, str]) -> DataFrame:
    out, seen = triples, {}
    for column, term in zip("spo", terms):
        if term.startswith("?"):
            if term in seen:
                out = out.where(F.col(column) == F.col(seen[term]))
            else:
                seen[term] = column
        else:
            out = out.where(F.col(column) == _constant(term))
    columns = [F.col(c).alias(v) for v, c in seen.items()]
    if seen.get(terms[2]) == "o" and terms[2].startswith("?"):
        columns.append(F.col("kind").alias(f"{terms[2]}!kind"))
    return out.select(*columns, F.lit(1).alias("!")).drop(*([] if not columns else ["!"]))


def connected(patterns: list[tuple], first: int = 0) -> list[tuple[int, tuple]]:
    """Numbered triple patterns, beginning with a given one, in an order in which each shares a variable with those before it, if any order does."""
    own = lambda x: {t for t in x[1] if t.startswith("?")}
    rest, out, seen = list(enumerate(patterns)), [], set()
    while rest:
        nearest = next((x for x in rest if own(x) & seen), rest[0]) if out else rest[first]
        rest.remove(nearest)
        out.append(nearest)
        seen |= own(nearest)
    return out


def body(rule: Rule, triples: DataFrame, new: DataFrame | None = None, at: int = 0) -> DataFrame:
    """Solutions: a column for each variable. With new, only those in which the triple pattern numbered `at` is one of the new triples."""
    out = None

    def value(term: str) -> Column:
        return F.col(f"`{term}`") if term.startswith("?") else F.lit(_constant(term))

    for i, args in connected(rule.patterns, at):
        found = _pattern(triples if new is None or i != at else new, args)
        if out is None:
            out = found
            continue
        shared = [c for c in found.columns if c in out.columns and not c.endswith("!kind")]
        found = found.drop(*(c for c in found.columns if c.endswith("!kind") and c in out.columns))
        out = out.join(found, shared) if shared else out.crossJoin(found)  # the patterns themselves are unconnected
    for kind, args in (x for x in rule.body if x[0] != "triple"):
        if kind == "noValue":
            found = _pattern(triples, args)
            shared = [c for c in found.columns if c in out.columns and not c.endswith("!kind")]
            out = out.join(found.select(*(f"`{c}`" for c in shared)), shared, "left_anti") if shared else out.where(F.lit(found.isEmpty()))
        elif kind == "makeTemp":
            out = out.withColumn(args[0], F.concat(F.lit("_:"), F.uuid()))
        elif kind == "listContains" and args[0].startswith("?"):
            out = _members(out, triples, args[0], value(args[1]))
        elif kind in builtins.FILTERS:
            out = out.where(builtins.FILTERS[kind](*map(value, args)))
        elif kind in builtins.KINDS:
            out = out.where(F.coalesce(builtins.KINDS[kind](F.col(f"`{args[0]}!kind`")) if f"{args[0]}!kind" in out.columns else F.lit(kind in ("isURI", "notBNode")), F.lit(False)))
        else:
            out = out.withColumn(args[-1], builtins.VALUES[kind](*map(value, args[:-1])))
    return out


def _members(solutions: DataFrame, triples: DataFrame, held: str, wanted: Column) -> DataFrame:
    """Solutions whose variable is the head of a collection that has the wanted item, or a text that has it between blanks."""
    name = F.col(f"`{held}`")
    found = solutions.withColumn("!item", wanted.cast("string"))
    asked = found.select(name.alias("list")).distinct().join(lists.cells(triples).select(F.col("cell").alias("list")), "list", "left_semi")
    if asked.isEmpty():
        return found.where(builtins.FILTERS["listContains"](name, F.col("!item"))).drop("!item")
    items = lists.items(triples, asked).select(F.col("list").alias(held), F.col("item").alias("!item"), F.lit(True).alias("!in")).distinct()
    return found.join(items, [held, "!item"], "left").where(F.col("`!in`") | builtins.FILTERS["listContains"](name, F.col("`!item`"))).drop("!item", "!in")


def apply_rule(rule: Rule, triples: DataFrame, new: DataFrame | None = None, at: int = 0) -> DataFrame:
    """The triples that one application gives (those known too); `new` and `at` as in body. All heads come from one pass over the solutions."""
    solutions, heads = body(rule, triples, new, at), []
    for terms in rule.head:
        columns = [F.col(f"`{t}`") if t.startswith("?") else F.lit(_constant(t)) for t in terms]
        t = terms[2]
        kind = F.col(f"`{t}!kind`") if f"{t}!kind" in solutions.columns else F.lit("literal" if t.startswith('"') else "iri")
        heads.append(F.struct(*(c.cast("string").alias(n) for c, n in zip(columns, "spo")), kind.alias("kind")))
    return solutions.select(F.inline(F.array(*heads))).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct()


def _round(rules: list[Rule], known: DataFrame, new: DataFrame | None, changed: set[str]) -> DataFrame | None:
    """What the rules give in a round; new triples have the predicates `changed` ("" stands for those that no pattern names). None: no rule can fire."""
    parts = []
    for r in rules:
        if new is None:
            parts.append(apply_rule(r, known))
            continue
        # facts only grow, so a solution without new triples has been found before, and noValue has only become rarer
        parts += [apply_rule(r, known, new, i) for i, (_, p, _) in enumerate(r.patterns) if p.startswith("?") or _constant(p) in changed]
    out = parts[0] if parts else None
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def run_rules(rules: list[Rule], triples: DataFrame, max_rounds: int = 100) -> tuple[DataFrame, int]:
    """(all triples, rounds): rules applied together until they give nothing new."""
    if bad := [r.name for r in rules if any(kind in ("makeTemp", "now") for kind, _ in r.body)]:
        raise ValueError(f"{bad} make a new value each round; there would be no fixed point")
    known = written(triples.select("s", "p", "o", "kind").distinct())
    asked = sorted({_constant(p) for r in rules for _, p, _ in r.patterns if not p.startswith("?")})
    new, changed = None, set()
    for round_ in range(1, max_rounds + 1):
        found = _round(rules, known, new, changed)
        if found is None:
            return known, round_
        new = written(found.dropDuplicates(["s", "p", "o"]).join(known.select("s", "p", "o"), ["s", "p", "o"], "left_anti"))
        # at most as many rows as the rules name predicates, and one
        changed = {x[0] for x in new.select(F.when(F.col("p").isin(asked), F.col("p")).otherwise("").alias("p")).distinct().collect()}
        if not changed:
            return known, round_
        known = known.unionByName(new)
        if round_ % 8 == 0:
            known = written(known)
    raise RuntimeError(f"no fixed point within {max_rounds} rounds")
