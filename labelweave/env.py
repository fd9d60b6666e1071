"""The environment: typed tables of containers, scopes, edges and ground facts, and the rules of the frameworks."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "containers": "container string, kind string, name string",
    "contains": "parent string, child string",
    "availability": "container string, scope string",
    "joinable": "a string, b string",
    "tags": "container string, label string",
    "fields": "field string, record string, table string, name string, value string, datatype string",
    "field_decls": "table string, name string, label string",
    "labels": "label string, introduced_by string",
    "label_facets": "label string, facet string",
    "frameworks": "framework string, extends string, sub_framework_of string, type string",
    "ground": "container string, label string, scope string, framework string, params map<string,string>",
}
ASSERTION = "container string, label string, scope string, framework string, params map<string,string>, is_ground boolean, derived_via string, derived_from string"
KEY = ["container", "label", "scope", "framework"]
DIRECTIONS = ("Inward", "Outward", "Peer", "Joinable")
RELATIONS = ("Self", "Parent", "Child", "Ancestor", "Descendant", "Sibling")
OPERATORS = ("<", "<=", ">", ">=", "==", "!=", "inRange")


@dataclass(frozen=True)
class Has:
    """The container itself has the label."""

    label: str


@dataclass(frozen=True)
class Contains:
    """The container or something inside it has the label."""

    label: str


@dataclass(frozen=True)
class Related:
    """A container in the relation has the label."""

    label: str
    relation: str = "Self"

    def __post_init__(self):
        if self.relation not in RELATIONS:
            raise ValueError(f"relation {self.relation!r}: one of {RELATIONS}")


@dataclass(frozen=True)
class JoinableTo:
    """A joinable container that is available contains the label."""

    label: str


@dataclass(frozen=True)
class Operand:
    """The value of a label's parameter on the container, else a literal, else a default."""

    label: str | None = None
    param: str | None = None
    literal: object = None
    default: object = None


@dataclass(frozen=True)
class Compare:
    left: Operand
    op: str
    right: Operand
    upper: Operand | None = None  # of inRange

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise ValueError(f"operator {self.op!r}: one of {OPERATORS}")


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


def labels_in(condition) -> set[str]:
    """Labels that a condition looks at."""
    if isinstance(condition, (All, Any)):
        return set().union(*map(labels_in, condition.parts))
    if isinstance(condition, Compare):
        return {o.label for o in (condition.left, condition.right, condition.upper) if o and o.label}
    return {condition.label}


@dataclass(frozen=True)
class Propagation:
    framework: str
    direction: str
    label: str | None = None
    facet: str | None = None
    name: str = ""

    def __post_init__(self):
        if self.direction not in DIRECTIONS:
            raise ValueError(f"direction {self.direction!r}: one of {DIRECTIONS}")


@dataclass(frozen=True)
class Subclass:
    framework: str
    sources: tuple[str, ...]  # any of them
    target: str
    name: str = ""


@dataclass(frozen=True)
class Implication:
    """Any (or all) of the sources, and any of the conditions if there are some, give each target."""

    framework: str
    sources: tuple[str, ...]
    targets: tuple[str, ...]
    conditions: tuple = ()
    every: bool = False
    name: str = ""


@dataclass(frozen=True)
class Equivalence:
    """All of the parts together are the whole, and the whole is each part."""

    framework: str
    parts: tuple[str, ...]
    whole: str
    conditions: tuple = ()
    name: str = ""


@dataclass(frozen=True)
class Conditional:
    framework: str
    condition: object
    target: str
    name: str = ""


@dataclass(frozen=True)
class Override:
    """The framework, and those that extend it, do not inherit the rules of this name."""

    framework: str
    name: str


@dataclass(frozen=True)
class Rules:
    propagations: tuple[Propagation, ...] = ()
    subclasses: tuple[Subclass, ...] = ()
    implications: tuple[Implication, ...] = ()
    equivalences: tuple[Equivalence, ...] = ()
    conditionals: tuple[Conditional, ...] = ()
    overrides: tuple[Override, ...] = ()

    def __add__(self, other: Rules) -> Rules:
        return Rules(*(getattr(self, k) + getattr(other, k) for k in self.__dataclass_fields__))


@dataclass
class Env:
    """DataFrames of SCHEMAS, and rules."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    rules: Rules = Rules()

    def __post_init__(self):
        for name, schema in SCHEMAS.items():
            if name not in self.tables:
                self.tables[name] = self.spark.createDataFrame([], schema)
            want = [x.split()[0] for x in schema.replace("map<string,string>", "map").split(", ")]
            if missing := set(want) - set(self.tables[name].columns):
                raise ValueError(f"table {name} lacks {sorted(missing)}")
            self.tables[name] = self.tables[name].select(*want)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def with_tables(self, **tables: DataFrame) -> Env:
        return Env(self.spark, self.tables | tables, self.rules)

    def with_rules(self, rules: Rules) -> Env:
        return replace(self, rules=rules)


def from_rows(spark: SparkSession, rules: Rules = Rules(), **rows: Iterable[tuple]) -> Env:
    """An environment from Python tuples, for fixtures and small inputs."""
    return Env(spark, {k: spark.createDataFrame(list(v), SCHEMAS[k]) for k, v in rows.items()}, rules)


def lint(env: Env) -> list[str]:
    """Rules that name labels or frameworks that the environment does not know."""
    labels = {r[0] for r in env.labels.select("label").distinct().collect()}  # of the frameworks: a vocabulary, not data
    frameworks = {r[0] for r in env.frameworks.select("framework").distinct().collect()}
    out = []
    for kind in Rules.__dataclass_fields__:
        for r in getattr(env.rules, kind):
            used = {getattr(r, "label", None), getattr(r, "target", None), getattr(r, "whole", None), *getattr(r, "sources", ()), *getattr(r, "targets", ()), *getattr(r, "parts", ())} - {None}
            out += [f"{kind} {r.name or r}: unknown label {x}" for x in sorted(used - labels)]
            if r.framework not in frameworks:
                out.append(f"{kind} {r.name or r}: unknown framework {r.framework}")
    return out


def facet_expanded(env: Env) -> DataFrame:
    """(framework, label, direction): propagation rules by label, facets replaced by their direct members."""
    rows = [(r.framework, r.label, r.facet, r.direction) for r in env.rules.propagations]
    rules = env.spark.createDataFrame(rows, "framework string, label string, facet string, direction string")
    by_label = rules.where("label IS NOT NULL").select("framework", "label", "direction")
    by_facet = env.label_facets.join(F.broadcast(rules.where("facet IS NOT NULL").drop("label")), "facet").select("framework", "label", "direction")
    return by_label.unionByName(by_facet).distinct()
