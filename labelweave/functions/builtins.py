"""Built-ins of rule texts, as columns. Terms are strings; `kind` columns say what a term is (iri, literal or bnode)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelweave.functions.text import encode_uri


def _numbers(a: Column, b: Column) -> tuple[Column, Column]:
    return a.try_cast("double"), b.try_cast("double")


def equal(a: Column, b: Column) -> Column:
    """By value where both are numbers, else by text."""
    x, y = _numbers(a, b)
    return F.coalesce(x == y, a == b)


def ordered(op: str, a: Column, b: Column) -> Column:
    """By value where both are numbers, else by text."""
    x, y = _numbers(a, b)
    f = {"greaterThan": lambda p, q: p > q, "lessThan": lambda p, q: p < q, "le": lambda p, q: p <= q, "ge": lambda p, q: p >= q}[op]
    return F.coalesce(f(x, y), f(a, b))


def number(x: Column) -> Column:
    """A double as text: whole values without a fraction."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def arithmetic(op: str, a: Column, b: Column) -> Column:
    x, y = _numbers(a, b)
    return number({"sum": x + y, "difference": x - y, "product": x * y, "quotient": F.try_divide(x, y)}[op])


FILTERS = {
    "equal": equal,
    "notEqual": lambda a, b: ~equal(a, b),
    **{op: (lambda a, b, op=op: ordered(op, a, b)) for op in ("greaterThan", "lessThan", "le", "ge")},
    "regex": lambda a, b: F.regexp_like(a, b),
    "listContains": lambda a, b: F.array_contains(F.split(a, " "), b),
}
#: The last argument is the variable that gets the value.
VALUES = {
    "strConcat": lambda *x: F.concat(*x),
    "uriConcat": lambda *x: F.concat(*x),
    **{op: (lambda a, b, op=op: arithmetic(op, a, b)) for op in ("sum", "difference", "product", "quotient")},
    "now": lambda: F.current_timestamp().cast("string"),
    "makeSkolem": lambda *x: F.concat(F.lit("urn:skolem:"), F.concat_ws("_", *(encode_uri(p) for p in x))),
}
#: Tests of a term's kind.
KINDS = {
    "isLiteral": lambda k: k == "literal",
    "isURI": lambda k: k == "iri",
    "isBNode": lambda k: k == "bnode",
    "notBNode": lambda k: k != "bnode",
}
