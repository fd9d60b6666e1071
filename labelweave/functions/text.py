"""Scalar functions on columns: URIs, names of nodes, literals, signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_uri(x: Column) -> Column:
    """Percent-encoding of all but letters, digits and -._~ (Spark's url_encode is that of forms)."""
    x = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(x, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def str_after(x: Column, mark: str) -> Column:
    """What follows the first mark; empty if there is none."""
    at = F.instr(x, mark)
    return F.when(at > 0, F.substr(x, at + len(mark))).otherwise(F.when(x.isNotNull(), F.lit("")))


def fragment(x: Column) -> Column:
    """The last part of an IRI: after its last #, else its last /; without the _: of a blank node."""
    part = F.when(F.instr(x, "#") > 0, F.substring_index(x, "#", -1)).when(F.instr(x, "/") > 0, F.substring_index(x, "/", -1)).otherwise(x)
    return F.regexp_replace(part, "^_:", "")


def node_iri(*parts: Column, suffix: str = "_assertion") -> Column:
    """A deterministic name from encoded parts."""
    return F.concat(F.lit("urn:skolem:"), F.concat_ws("_", *(encode_uri(p) for p in parts)), F.lit(suffix))


def containment_iri(container: Column, label: Column, scope: Column, framework: Column) -> Column:
    return F.concat(F.lit("urn:containment:"), F.md5(F.concat_ws(":", container, label, scope, framework)))


def content_signature(pairs: Column) -> Column:
    """16 hex digits of the SHA-256 of a list of strings, whatever its order."""
    return F.substring(F.sha2(F.array_join(F.array_sort(pairs), ";"), 256), 1, 16)


def literal_kind(x: Column) -> Column:
    """integer, float, iri or string: as what a lexical value is read."""
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(x.rlike(r"^[+-]?\d+$"), F.lit("integer"))
        .when(x.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), F.lit("float"))
        .when(x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]*$"), F.lit("iri"))
        .otherwise(F.lit("string"))
    )
