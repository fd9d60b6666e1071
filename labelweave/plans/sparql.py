"""SPARQL text to DataFrame plans over a triples table: SELECT, CONSTRUCT, INSERT and DELETE with WHERE.

A pattern is a filtered projection of (s, p, o), patterns join on the variables that they share, OPTIONAL is a left join, EXISTS a semi-join, NOT EXISTS and
MINUS anti-joins, UNION a union by name, sub-selects nest; Catalyst orders and prunes the rest. Property paths have sequence, alternative, inverse, star and plus.

Terms are their text: IRIs in full, literals without type. Two terms that read as numbers compare as numbers, others as text. A variable that is unbound is null.
Not covered: named graphs, SERVICE, DESCRIBE, ASK, and the kinds of terms beyond isIRI and isLiteral by form.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property, reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.functions import text as T
from labelweave.functions.builtins import number
from labelweave.operators.closure import grow
from labelweave.storage import Kept, spread, written

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<var>[?$]\w+)|(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<blank>_:\w+)|(?P<lang>@[A-Za-z-]+)
    |(?P<name>[A-Za-z][\w-]*:(?:[\w%][\w.%-]*[\w%-]|[\w%])?|:(?:[\w%][\w.%-]*[\w%-]|[\w%])?)|(?P<word>[A-Za-z][\w]*)|(?P<mark>\^\^|&&|\|\||!=|<=|>=|[{}()\[\];,.*+/|^!=<>?-])""",
    re.X,
)
_AGGREGATES = {"COUNT", "MIN", "MAX", "SUM", "AVG", "SAMPLE", "GROUP_CONCAT"}


def _text(c: Column) -> Column:
    return c.cast("string")


def _compare(a: Column, op: str, b: Column) -> Column:
    a, b = _text(a), _text(b)
    x, y = a.try_cast("double"), b.try_cast("double")
    f: Callable = {"=": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q}[op]
    return F.when(x.isNotNull() & y.isNotNull(), f(x, y)).otherwise(f(a, b))


def _truth(c: Column) -> Column:
    return F.lower(_text(c)) == "true"


def _math(op: str, a: Column, b: Column) -> Column:
    x, y = _text(a).try_cast("double"), _text(b).try_cast("double")
    return number({"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[op])


def _untyped(name: str) -> Column:
    raise ValueError(f"{name}: the triples hold terms as text, without types and tags")


_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "STR": _text, "IRI": _text, "URI": _text, "BOUND": lambda x: x.isNotNull(), "COALESCE": lambda *x: F.coalesce(*map(_text, x)), "IF": lambda c, a, b: F.when(_truth(c), _text(a)).otherwise(_text(b)),
    "CONCAT": lambda *x: F.concat(*map(_text, x)), "ENCODE_FOR_URI": lambda x: T.encode_uri(_text(x)), "MD5": lambda x: F.md5(_text(x)), "SHA256": lambda x: F.sha2(_text(x), 256), "LCASE": lambda x: F.lower(_text(x)), "UCASE": lambda x: F.upper(_text(x)),
    "STRLEN": lambda x: F.length(_text(x)).cast("string"), "CONTAINS": lambda a, b: F.contains(_text(a), _text(b)), "STRSTARTS": lambda a, b: F.startswith(_text(a), _text(b)), "STRENDS": lambda a, b: F.endswith(_text(a), _text(b)),
    "STRAFTER": lambda a, b: _after(a, b), "STRBEFORE": lambda a, b: _before(a, b),
    "REGEX": lambda a, b, *f: F.regexp_like(_text(a), F.concat(F.lit("(?i)"), _text(b)) if f else _text(b)), "REPLACE": lambda a, b, c: F.regexp_replace(_text(a), _text(b), _text(c)), "ABS": lambda x: number(F.abs(_text(x).try_cast("double"))),
    "NOW": lambda: F.current_timestamp().cast("string"), "ISIRI": lambda x: T.literal_kind(_text(x)) == "iri", "ISURI": lambda x: T.literal_kind(_text(x)) == "iri", "ISLITERAL": lambda x: T.literal_kind(_text(x)) != "iri",
    "SUBSTR": lambda a, i, *n: F.substr(_text(a), _text(i).cast("int"), *(_text(k).cast("int") for k in n)), "DATATYPE": lambda *x: _untyped("DATATYPE"), "LANG": lambda *x: _untyped("LANG"), "SAMETERM": lambda a, b: _text(a) == _text(b),
}


def _after(a: Column, b: Column) -> Column:
    at = F.call_function("instr", _text(a), _text(b))
    return F.when(at > 0, F.substr(_text(a), at + F.length(_text(b)))).otherwise(F.lit(""))


def _before(a: Column, b: Column) -> Column:
    at = F.call_function("instr", _text(a), _text(b))
    return F.when(at > 1, F.substr(_text(a), F.lit(1), at - 1)).otherwise(F.lit(""))



class Query:
    """Parses and plans in one pass: each construct gives a DataFrame of its solutions, a column per variable."""

    def __init__(self, text: str, triples: DataFrame | View):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"no SPARQL at {text[at : at + 30]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.prefixes, self.fresh = 0, {}, count()
        self.view = triples if isinstance(triples, View) else None
        self.spark = self.view.known.env.spark if self.view else triples.sparkSession
        if not self.view:
            self.triples = triples.select("s", "p", "o")
        self.held: list[tuple[str, Column]] = []

    @cached_property
    def triples(self) -> DataFrame:
        """All of them, of a view: worked out when a pattern needs more than facts or edges of one kind."""
        return self.view.triples()

    # --- tokens

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else "end"

    def word(self, *wanted: str) -> bool:
        if self.peek().upper() in wanted and self.kind() != "str":
            self.at += 1
            return True
        return False

    def take(self, wanted: str | None = None) -> str:
        token = self.peek()
        if not token or wanted and token.upper() != wanted:
            raise ValueError(f"expected {wanted or 'more'}, found {token!r}")
        self.at += 1
        return token

    def new(self) -> str:
        return f"_b{next(self.fresh)}"

    # --- terms: ("var", name) or ("term", text)

    def term(self) -> tuple[str, str]:
        kind, token = self.kind(), self.take()
        if kind == "var":
            return "var", token[1:]
        if kind == "blank":
            return "var", "_" + token[2:]
        if kind == "iri":
            return "term", token[1:-1]
        if kind == "str":
            if self.peek() == "^^":
                self.take()
                self.term()
            elif self.kind() == "lang":
                self.take()
            return "term", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), token[1:-1])
        if kind == "num":
            return "term", token
        if kind == "name":
            prefix, _, local = token.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return "term", self.prefixes[prefix] + local
        if token in ("true", "false"):
            return "term", token
        if token == "a":
            return "term", RDF_TYPE
        if token == "-" or token == "+":
            return "term", token.replace("+", "") + self.take()
        raise ValueError(f"no term: {token!r}")

    # --- requests

    def prologue(self) -> None:
        while self.peek().upper() in ("PREFIX", "BASE"):
            if self.take().upper() == "PREFIX":
                name = self.take().rstrip(":")
                self.prefixes[name] = self.take()[1:-1]
            else:
                self.take()

    def run(self) -> DataFrame:
        self.prologue()
        kind = self.peek().upper()
        out = {"SELECT": self.select, "ASK": self.ask, "DESCRIBE": self.describe}.get(kind, self.construct)()
        if self.kind() != "end":
            raise ValueError(f"after the end: {self.peek()!r}")
        return out

    def construct(self) -> DataFrame:
        self.take("CONSTRUCT")
        pattern = self.template()
        self.word("WHERE")
        return self.instances(pattern, self.group())

    def ask(self) -> DataFrame:
        """One row: whether the pattern has a match."""
        self.take("ASK")
        self.word("WHERE")
        return self.group().limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))

    def describe(self) -> DataFrame:
        """The triples whose subjects are the named terms, or what the named variables (*: all) are in the matches of the pattern."""
        self.take("DESCRIBE")
        every, named = self.word("*"), []
        while not every and self.kind() != "end" and self.peek() != "{" and self.peek().upper() != "WHERE":
            named.append(self.term())
        self.word("WHERE")
        found = self.group() if self.peek() == "{" else None
        if any(k == "var" for k, _ in named) and found is None or not (every or named):
            raise ValueError("DESCRIBE takes terms, or variables of a pattern")
        columns = [c for c in found.columns if not c.startswith("_")] if every else [v for k, v in named if k == "var" and v in found.columns]
        subjects = self.triples.sparkSession.createDataFrame([(v,) for k, v in named if k == "term"], "s string")
        for c in columns:
            subjects = subjects.unionByName(found.select(F.col(f"`{c}`").alias("s")))
        return self.triples.select("s", "p", "o").join(subjects.distinct(), "s", "left_semi").select("s", "p", "o").distinct()

    def update(self) -> tuple[DataFrame, DataFrame]:
        """(deleted, inserted)."""
        self.prologue()
        gone, new = [], []
        while self.peek().upper() in ("DELETE", "INSERT"):
            (gone if self.take().upper() == "DELETE" else new).extend(self.template())
        self.take("WHERE")
        found = self.group()
        return self.instances(gone, found), self.instances(new, found)

    def deleted_predicates(self) -> set[str]:
        """Of an update that is only read: the predicates of its DELETE template."""
        self.prologue()
        out: set[str] = set()
        while self.peek().upper() in ("DELETE", "INSERT"):
            deletes = self.take().upper() == "DELETE"
            out |= {p[1] for _, p, _ in self.template() if deletes and p[0] == "term"}
        return out

    def template(self) -> list:
        self.take("{")
        out: list = []
        self.triples_block(out)
        self.take("}")
        if any(isinstance(p, DataFrame) for _, p, _ in out):
            raise ValueError("a template has no paths")
        return out

    def instances(self, pattern: list, found: DataFrame) -> DataFrame:
        out = self.spark.createDataFrame([], "s string, p string, o string")
        column = lambda t: F.col(f"`{t[1]}`") if t[0] == "var" and t[1] in found.columns else F.lit(None) if t[0] == "var" else F.lit(t[1])
        for terms in pattern:
            out = out.unionByName(found.select(*(_text(column(t)).alias(n) for t, n in zip(terms, "spo"))))
        return self.once(out.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL"))

    def once(self, found: DataFrame) -> DataFrame:
        return found.distinct()

    def select(self) -> DataFrame:
        self.take("SELECT")
        distinct = self.word("DISTINCT", "REDUCED")
        start = self.at
        depth = 0
        while depth or self.peek().upper() not in ("WHERE", "{"):  # expressions need the variables: first the pattern
            depth += {"(": 1, ")": -1}.get(self.peek(), 0)
            self.take()
        self.word("WHERE")
        found = self.group()
        after = self.at
        keys, aggregated = [], False
        if self.word("GROUP"):
            self.take("BY")
            aggregated = True
            while self.kind() == "var" or self.peek() == "(":
                if self.kind() == "var":
                    keys.append(self.take()[1:])
                else:
                    self.take("(")
                    value = self.expression(found)
                    self.take("AS")
                    keys.append(self.take()[1:])
                    found = found.withColumn(keys[-1], _text(value))
                    self.take(")")
            after = self.at
        self.at, names, columns = start, [], []
        self.held = []
        if self.word("*"):
            names = [c for c in found.columns if not c.startswith("_")]
            columns = [F.col(f"`{c}`") for c in names]
        else:
            while self.kind() == "var" or self.peek() == "(":
                if self.kind() == "var":
                    names.append(self.take()[1:])
                    columns.append(F.col(f"`{names[-1]}`") if names[-1] in found.columns else F.lit(None).cast("string"))
                else:
                    self.take("(")
                    value = self.expression(found, aggregates=True)
                    self.take("AS")
                    names.append(self.take()[1:])
                    columns.append(_text(value))
                    self.take(")")
        self.at = after
        having = []
        while self.word("HAVING") or having and self.peek() == "(":
            self.take("(")
            having.append(self.expression(found, aggregates=True))
            self.take(")")
        if self.held or aggregated:
            grouped = found.groupBy(*(f"`{k}`" for k in keys)) if keys else found.groupBy()
            found = grouped.agg(*(c.alias(n) for n, c in self.held)) if self.held else found.select(*(f"`{k}`" for k in keys)).distinct()
        for h in having:
            found = found.where(_truth(h))
        order = []
        if self.word("ORDER"):
            self.take("BY")
            while self.kind() in ("var", "word") and self.peek().upper() not in ("LIMIT", "OFFSET") or self.peek() == "(":
                down = self.word("DESC")
                if not down:
                    self.word("ASC")
                if self.peek() == "(":
                    self.take("(")
                    value = self.expression(None)
                    self.take(")")
                else:
                    value = F.col(f"`{self.take()[1:]}`")
                for v in (value.try_cast("double"), value):  # numbers by value, before text
                    order.append(v.desc() if down else v.asc())
        out = found.select(*(c.alias(n) for n, c in zip(names, columns)))
        if distinct:
            out = out.distinct()
        if order:
            out = out.orderBy(*order)
        cut = {}
        while self.peek().upper() in ("LIMIT", "OFFSET"):
            name = self.take().upper()
            cut[name] = int(self.take())
        out = out.offset(cut["OFFSET"]) if "OFFSET" in cut else out
        return out.limit(cut["LIMIT"]) if "LIMIT" in cut else out

    # --- patterns

    def group(self, seed: DataFrame | None = None) -> DataFrame:
        found, filters = self.group_parts(seed)
        for f in filters:
            found = f(found)
        return found

    def group_parts(self, seed: DataFrame | None = None) -> tuple[DataFrame, list]:
        self.take("{")
        found, filters = seed, []
        if self.peek().upper() == "SELECT":
            found = self.join(found, self.select())
        while not self.word("}"):
            if self.word("."):
                continue
            if self.word("FILTER"):
                filters.append(self.filter())
            elif self.word("OPTIONAL"):
                found = self.optional(self.unit(found))
            elif self.word("MINUS"):
                other = self.group()
                found = self.unit(found)
                if shared := [c for c in other.columns if c in found.columns]:
                    found = self.semi(found, other, shared, "left_anti")
            elif self.word("BIND"):
                self.take("(")
                found = self.unit(found)
                value = self.expression(found)
                self.take("AS")
                found = found.withColumn(self.take()[1:], _text(value))
                self.take(")")
            elif self.word("VALUES"):
                found = self.join(found, self.values())
            elif self.peek() == "{":
                other = self.group()
                while self.word("UNION"):
                    other = other.unionByName(self.group(), allowMissingColumns=True)
                found = self.join(found, other)
            else:
                block: list = []
                self.triples_block(block)
                for one in self.matches(block):
                    found = self.join(found, one)
        return self.unit(found), filters

    def unit(self, found: DataFrame | None) -> DataFrame:
        return self.spark.range(1).select(F.lit(1).alias("_unit")) if found is None else found

    def join(self, a: DataFrame | None, b: DataFrame) -> DataFrame:
        if a is None:
            return b
        shared = [c for c in b.columns if c in a.columns]
        if not shared:
            return a.crossJoin(b)
        return a.join(b, [f"{c}" for c in shared])

    def semi(self, a: DataFrame, b: DataFrame, shared: list[str], how: str) -> DataFrame:
        other = b.select(*(F.col(f"`{c}`").alias(f"{c}!") for c in shared)).distinct()
        same = F.lit(True)
        for c in shared:
            same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"`{c}!`"))
        return a.join(other, same, how)

    def optional(self, found: DataFrame) -> DataFrame:
        start = self.at
        right, filters = self.group_parts()
        if filters:  # they may look at the left side, so they are part of the join
            self.at = start
            right = self.group(seed=found.distinct())
        shared = [c for c in right.columns if c in found.columns]
        if not shared:
            return found.join(right, F.lit(True), "left")
        right = right.select(*(F.col(f"`{c}`").alias(f"{c}!" if c in shared else c) for c in right.columns)).distinct()
        same = F.lit(True)
        for c in shared:
            same = same & (F.col(f"`{c}`").eqNullSafe(F.col(f"`{c}!`")) if filters else F.col(f"`{c}`") == F.col(f"`{c}!`"))
        return found.join(right, same, "left").drop(*(f"{c}!" for c in shared))

    def values(self) -> DataFrame:
        many = self.word("(")
        names = []
        while self.kind() == "var":
            names.append(self.take()[1:])
        if many:
            self.take(")")
        self.take("{")
        rows = []
        while not self.word("}"):
            if many:
                self.take("(")
            rows.append(tuple(None if self.word("UNDEF") else self.term()[1] for _ in names))
            if many:
                self.take(")")
        return F.broadcast(self.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)))  # as long as the query's text

    def filter(self):
        negated = self.word("NOT")
        if self.word("EXISTS"):
            start = self.at
            self.skip()

            def apply(found: DataFrame) -> DataFrame:
                back, self.at = self.at, start
                inner = self.group(seed=found.distinct())
                self.at = back
                return self.semi(found, inner, found.columns, "left_anti" if negated else "left_semi")

            return apply
        start = self.at
        self.expression(None)

        def keep(found: DataFrame) -> DataFrame:
            back, self.at = self.at, start
            value = self.expression(found)
            self.at = back
            return found.where(_truth(value))

        return keep

    def skip(self) -> None:
        depth = 0
        while True:
            depth += {"{": 1, "}": -1}.get(self.take(), 0)
            if not depth:
                return

    def triples_block(self, out: list) -> None:
        while self.kind() in ("var", "iri", "name", "blank", "str", "num") or self.peek() in ("[", "("):
            subject = self.node(out)
            if self.peek() not in (".", "}"):
                self.properties(subject, out)
            if not self.word("."):
                return

    def properties(self, subject: tuple, out: list) -> None:
        while self.peek() not in (".", "}", "]", "") and self.peek().upper() not in ("FILTER", "OPTIONAL", "MINUS", "BIND", "VALUES"):
            verb = self.path()
            while True:
                out.append((subject, verb, self.node(out)))
                if not self.word(","):
                    break
            while self.word(";"):
                pass

    def node(self, out: list) -> tuple[str, str]:
        if self.word("["):
            own = ("var", self.new())
            if self.peek() != "]":
                self.properties(own, out)
            self.take("]")
            return own
        return self.term()

    def path(self):
        """A term, or a DataFrame (s, o) for a path that is more than one."""
        out = self.sequence()
        while self.word("|"):
            out = self.edges(out).unionByName(self.edges(self.sequence())).distinct()
        return out

    def sequence(self):
        out = self.step()
        while self.word("/"):
            right = self.edges(self.step()).select(F.col("s").alias("m"), "o")
            out = self.edges(out).select("s", F.col("o").alias("m")).join(right, "m").select("s", "o").distinct()
        return out

    def step(self):
        inverse = self.word("^")
        if self.word("("):
            out = self.path()
            self.take(")")
        else:
            out = self.term()
        if self.peek() in ("*", "+", "?") and self.kind() == "mark":
            sign = self.take()
            edges = self.edges(out)
            more = edges.select(F.col("s").alias("o"), F.col("o").alias("n"))
            if sign != "?":
                edges = grow(edges, lambda d: d.join(more, "o").select("s", F.col("n").alias("o")))
            if sign != "+":
                nodes = self.triples.select(F.col("s").alias("n")).unionByName(self.triples.select(F.col("o").alias("n"))).distinct()
                edges = edges.unionByName(nodes.select(F.col("n").alias("s"), F.col("n").alias("o"))).distinct()
            out = edges
        if inverse:
            out = self.edges(out).select(F.col("o").alias("s"), F.col("s").alias("o"))
        return out

    def edges(self, path) -> DataFrame:
        if isinstance(path, DataFrame):
            return path
        if path[0] == "var":
            raise ValueError("a path holds no variables")
        own = self.view.edges(path[1]) if self.view else None
        return (self.triples if own is None else own).where(F.col("p") == path[1]).select("s", "o").distinct()

    def matches(self, block: list) -> list[DataFrame]:
        """The matches of each triple pattern. Of a view, patterns on the parts of one fact (a variable as subject, a predicate of facts) are a filter of the facts."""
        own: dict[str, list] = {}
        if self.view:
            for s, p, o in block:
                if s[0] == "var" and not isinstance(p, DataFrame) and p[0] == "term" and p[1] in self.view.columns:
                    own.setdefault(s[1], []).append((p[1], o))
        out, done = [], set()
        for s, p, o in block:
            if s[0] == "var" and s[1] in own and not isinstance(p, DataFrame) and (p[1], o) in own[s[1]]:
                if s[1] not in done:
                    done.add(s[1])
                    out.append(self.fact(s[1], own[s[1]]))
            else:
                out.append(self.pattern(s, p, o))
        return out

    def fact(self, name: str, parts: list) -> DataFrame:
        found, seen = self.view.nodes(), {name: "_node"}
        for p, (kind, value) in parts:
            column = self.view.columns[p]
            if kind == "term":
                found = found.where(F.col(column) == value)
            elif value in seen:
                found = found.where(F.col(column) == F.col(seen[value]))
            else:
                seen[value] = column
        return found.select(*(F.col(c).alias(v) for v, c in seen.items())).distinct()

    def pattern(self, s: tuple, p, o: tuple) -> DataFrame:
        own = self.view.edges(p[1]) if self.view and not isinstance(p, DataFrame) and p[0] == "term" else None
        found, parts = (p, (("s", s), ("o", o))) if isinstance(p, DataFrame) else (self.triples if own is None else own, (("s", s), ("p", p), ("o", o)))
        seen: dict[str, str] = {}
        for column, (kind, value) in parts:
            if kind == "term":
                found = found.where(F.col(column) == value)
            elif value in seen:
                found = found.where(F.col(column) == F.col(seen[value]))
            else:
                seen[value] = column
        columns = [F.col(c).alias(v) for v, c in seen.items()] or [F.lit(1).alias(f"_here{next(self.fresh)}")]
        return self.once(found.select(*columns))

    # --- expressions. found: what variables are bound in (None: while skipping)

    def expression(self, found: DataFrame | None, aggregates: bool = False) -> Column:
        self.scope, self.aggregates = found, aggregates
        return self.either()

    def either(self) -> Column:
        out = self.both()
        while self.word("||"):
            right = self.both()
            out = _truth(out) | _truth(right)
        return out

    def both(self) -> Column:
        out = self.relation()
        while self.word("&&"):
            right = self.relation()
            out = _truth(out) & _truth(right)
        return out

    def relation(self) -> Column:
        out = self.additive()
        if self.peek() in ("=", "!=", "<", "<=", ">", ">=") and self.kind() == "mark":
            op = self.take()
            return _compare(out, op, self.additive())
        negated = self.peek().upper() == "NOT" and self.peek(1).upper() == "IN"
        if negated:
            self.take()
        if self.word("IN"):
            self.take("(")
            options = []
            while not self.word(")"):
                options.append(self.either())
                self.word(",")
            hit = F.lit(False)
            for x in options:
                hit = hit | _compare(out, "=", x)
            return ~hit if negated else hit
        return out

    def additive(self) -> Column:
        out = self.product()
        while self.peek() in ("+", "-") and self.kind() == "mark":
            op = self.take()
            out = _math(op, out, self.product())
        return out

    def product(self) -> Column:
        out = self.unary()
        while self.peek() in ("*", "/") and self.kind() == "mark":
            op = self.take()
            out = _math(op, out, self.unary())
        return out

    def unary(self) -> Column:
        if self.word("!"):
            return ~_truth(self.unary())
        if self.word("-"):
            return _math("-", F.lit("0"), self.unary())
        if self.word("("):
            out = self.either()
            self.take(")")
            return out
        name = self.peek().upper()
        if self.peek(1) == "(" and name in _AGGREGATES and self.aggregates:
            return self.aggregate()
        if self.peek(1) == "(" and name in _FUNCTIONS and self.kind() == "word":
            self.take()
            return _FUNCTIONS[name](*self.call())
        if self.peek(1) == "(" and self.kind() in ("name", "iri"):  # a cast
            kind = self.term()[1].rsplit("#", 1)[-1]
            (value,) = self.call()
            return number(_text(value).try_cast("double")) if kind in ("integer", "decimal", "double", "float", "long", "int") else _text(value)
        kind, value = self.term()
        if kind == "term":
            return F.lit(value)
        return F.col(f"`{value}`") if self.scope is None or value in self.scope.columns else F.lit(None).cast("string")

    def call(self) -> list[Column]:
        self.take("(")
        out = []
        while not self.word(")"):
            out.append(self.either())
            self.word(",")
        return out

    def aggregate(self) -> Column:
        kind = self.take().upper()
        self.take("(")
        distinct = self.word("DISTINCT")
        self.aggregates = False
        value = F.lit("1") if self.word("*") else _text(self.either())
        separator = " "
        if self.word(";"):
            self.take("SEPARATOR")
            self.take("=")
            separator = self.term()[1]
        self.take(")")
        self.aggregates = True
        n = value.try_cast("double")
        if kind == "COUNT":
            out = (F.count_distinct(value) if distinct else F.count(value)).cast("string")
        elif kind == "GROUP_CONCAT":
            out = F.array_join(F.array_sort(F.collect_set(value) if distinct else F.collect_list(value)), separator)
        elif kind in ("MIN", "MAX"):
            f = F.min if kind == "MIN" else F.max
            out = F.when(F.count(value) == F.count(n), number(f(n))).otherwise(f(value))
        elif kind == "SAMPLE":
            out = F.min(value)
        else:
            out = number((F.sum_distinct(n) if distinct else F.sum(n)) if kind == "SUM" else F.avg(n))
        name = f"_agg{len(self.held)}"
        self.held.append((name, out))
        return F.col(name)


def query(text: str, triples: DataFrame) -> DataFrame:
    """Rows of a SELECT, the triples (s, p, o) of a CONSTRUCT or DESCRIBE, or the one row (result) of an ASK."""
    return Query(text, triples).run()


def update(text: str, triples: DataFrame) -> DataFrame:
    """The triples (s, p, o) after DELETE and INSERT."""
    gone, new = Query(text, triples).update()
    return triples.select("s", "p", "o").join(gone, ["s", "p", "o"], "left_anti").unionByName(new).distinct()


class _Other(ValueError):
    """A text that _Positive does not take."""


class _Positive(Query):
    """A CONSTRUCT of triple patterns, filters, BINDs and VALUES: what it gives grows with the triples, and of new ones only what they match follows anew. The triples
    are a set, so its patterns' matches are one; what it gives is not made distinct. part: the number of the pattern that reads the new triples alone."""

    APART = {"OPTIONAL", "MINUS", "UNION", "NOT", "EXISTS", "SELECT"}

    def __init__(self, text: str, triples: DataFrame, new: DataFrame | None = None, part: int = -1):
        super().__init__(text, triples)
        self.known, self.newer, self.part, self.read, self.made = self.triples, new, part, [], []
        if any(kind == "word" and token.upper() in self.APART for kind, token in self.tokens):
            raise _Other(text)

    def once(self, found: DataFrame) -> DataFrame:
        return found

    def edges(self, path) -> DataFrame:
        raise _Other("a path")

    def template(self) -> list:
        self.made = super().template()
        return self.made

    def pattern(self, s: tuple, p, o: tuple) -> DataFrame:
        self.triples = self.newer if len(self.read) == self.part else self.known
        self.read.append(p)
        return super().pattern(s, p, o)


def saturate(constructs: list[str], triples: DataFrame, updates: list[str] = [], max_rounds: int = 100) -> tuple[DataFrame, int]:  # noqa: B006
    """(triples, rounds): CONSTRUCTs, then updates, round after round until nothing changes. CONSTRUCTs of patterns alone are asked, from the second round on,
    about the last round's triples only."""
    known = written(spread(triples.select("s", "p", "o"), "s", "p", "o").distinct())
    if not updates:
        try:
            first = [_Positive(text, known) for text in constructs]
            return _semi_naive(constructs, first, [q.run() for q in first], known, max_rounds)
        except _Other:
            pass
    for round_ in range(1, max_rounds + 1):
        now = known
        for text in constructs:
            now = now.unionByName(query(text, now))
        for text in updates:
            now = update(text, now)
        now = written(spread(now, "s", "p", "o").distinct())
        if now.count() == known.count() and now.join(known, ["s", "p", "o"], "left_anti").isEmpty():
            return known, round_
        known = now
    raise RuntimeError(f"no fixed point within {max_rounds} rounds")


def _semi_naive(constructs: list[str], first: list[_Positive], found: list[DataFrame], known: DataFrame, max_rounds: int) -> tuple[DataFrame, int]:
    """found: what the texts give of all that is known. Candidates meet only triples whose predicates the templates give."""
    made = [p for q in first for _, p, _ in q.made]
    given = None if any(kind == "var" for kind, _ in made) else sorted({name for _, name in made})
    kept = Kept("triples")
    kept.parts, kept.rows = [known], known.count()
    for round_ in range(1, max_rounds + 1):
        rest = kept.table if given is None else kept.table.where(F.col("p").isin(given))
        delta = None
        if found:
            new = spread(reduce(DataFrame.unionByName, found), "s", "p", "o", rows=kept.rows).distinct()
            delta = kept.add(new.join(rest, ["s", "p", "o"], "left_anti"))
        if delta is None:
            return kept.table, round_
        found = []
        for text, q in zip(constructs, first):
            for part, p in enumerate(q.read):
                if given is None or p[0] == "var" or p[1] in given:  # others meet nothing new
                    found.append(_Positive(text, kept.table, delta, part).run())
    raise RuntimeError(f"no fixed point within {max_rounds} rounds")


def _deletes(text: str) -> bool:
    return any(m.lastgroup == "word" and m.group().upper() == "DELETE" for m in _TOKEN.finditer(text))


class _Known:
    """The triples that user texts see: facts so far, edges, availability."""

    def __init__(self, env):
        self.env, self.held = env, {}

    def edges(self, kind: str) -> DataFrame:
        """(s, p, o) of a kind of edges, distinct: the same in every round."""
        from labelweave.operators import closure

        if kind not in self.held:
            if kind == "contains":
                found = self.env.contains.select(F.col("parent").alias("s"), F.col("child").alias("o")).distinct()
            elif kind == "joinableWith":
                found = closure.symmetric(self.env.joinable).select(F.col("a").alias("s"), F.col("b").alias("o"))
            else:
                found = closure.available(self.env.availability, self.env.contains).select(F.col("container").alias("s"), F.col("scope").alias("o"))
            self.held[kind] = written(found, "edges").select("s", F.lit(kind).alias("p"), "o")
        return self.held[kind]


class View:
    """What a text sees, by parts: triples of edges and of facts are put together only where a pattern may look at both."""

    EDGES = ("contains", "joinableWith", "availableInScope")

    def __init__(self, known: _Known, facts: DataFrame):
        from labelweave.operators import query as Q

        self.known, self.facts, self.columns = known, facts, dict(Q.PARTS)

    def nodes(self) -> DataFrame:
        """The facts, each with its node."""
        from labelweave.operators import query as Q

        return self.facts.select("container", "label", "scope", "framework", Q.node_of_fact().alias("_node"))

    def edges(self, predicate: str) -> DataFrame | None:
        return self.known.edges(predicate) if predicate in self.EDGES else None

    def triples(self) -> DataFrame:
        from labelweave.operators import query as Q

        none = self.known.env.spark.createDataFrame([], "s string, o string")
        out = Q.triples(self.facts, *(none.select(F.col("s").alias(a), F.col("o").alias(b)) for a, b in (("parent", "child"), ("a", "b"), ("container", "scope"))))
        for kind in self.EDGES:
            out = out.unionByName(self.known.edges(kind))
        return out


def in_rounds(env, constructs=(), updates=(), rule_texts=()) -> list[Callable[[DataFrame, DataFrame], DataFrame]]:
    """User texts as rules of the engine's rounds (its `extra`): each round they see the facts so far, the edges and availability as triples, and the new
    subjects that they make with assertedOn, assertsLabel, assertedInScope and assertedByFramework are facts of the next round. A round only adds:
    updates that DELETE are left to `retracts`."""
    from labelweave.operators import query as Q
    from labelweave.plans import ruletext

    updates = [t for t in updates if not _deletes(t)]
    rules = [r for t in rule_texts for r in ruletext.parse_rules(t)]
    triples = _Known(env)

    def all_texts(facts: DataFrame, delta: DataFrame) -> DataFrame:
        known = View(triples, facts)
        new = env.spark.createDataFrame([], "s string, p string, o string")
        for text in constructs:
            new = new.unionByName(Query(text, known).run())
        for text in updates:
            new = new.unionByName(Query(text, known).update()[1].select("s", "p", "o"))
        for rule in rules:
            new = new.unionByName(ruletext.apply_rule(rule, known.triples().withColumn("kind", F.lit("iri"))).select("s", "p", "o"))
        return Q.facts_in(new)

    return [all_texts] if constructs or updates or rules else []


def retracts(env, updates=()) -> list[Callable[[DataFrame], tuple[DataFrame, DataFrame]]]:
    """Updates that DELETE, for the engine's `retracts`: (facts that go, facts that come). A fact goes if one of the four triples that make it does; other
    triples (edges, availability) are data, and are refused as the text is read."""
    from labelweave.operators import query as Q

    triples = _Known(env)

    def rule(text: str) -> Callable:
        def ask(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
            known = View(triples, facts)
            gone, new = Query(text, known).update()
            gone = written(gone.where(F.col("p").isin([*known.columns])), "gone")
            # a fact has the triple if the column of its predicate has the object; facts with another label or framework need not be looked through
            nodes = known.nodes()
            for part in ("assertsLabel", "assertedByFramework"):
                named = gone.select(F.when(F.col("p") == part, F.col("o")).alias("o")).distinct().limit(1001).collect()
                if len(named) <= 1000 and None not in [x[0] for x in named]:
                    nodes = nodes.where(F.col(known.columns[part]).isin([x[0] for x in named]))
            own = F.coalesce(*(F.when(F.col("p") == p, F.col(c)) for p, c in known.columns.items()))
            asked = gone.select(F.col("s").alias("_node"), "p", "o")
            named = nodes.join(asked, "_node").where(own == F.col("o")).select("container", "label", "scope", "framework").distinct()
            return named, Q.facts_in(new)

        return ask

    for text in updates:
        if _deletes(text):
            parsed = Query(text, triples.env.spark.createDataFrame([], "s string, p string, o string"))
            for p in parsed.deleted_predicates():
                if p in ("contains", "joinableWith", "availableInScope"):
                    raise ValueError(f"{text[:60]!r} deletes {p}: only facts can be taken back")
    return [rule(t) for t in updates if _deletes(t)]
