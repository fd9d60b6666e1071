"""Typed tables from a triples table, by the local names of its vocabulary: what follows the last # or / of an IRI counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave import env as E
from labelweave.functions.text import fragment
from labelweave.operators import lists


def _named(triples: DataFrame) -> DataFrame:
    return triples.withColumn("p", fragment(F.col("p")))


def environment(triples: DataFrame, rules: E.Rules = E.Rules(), short: bool = True) -> E.Env:
    """The environment of a graph's data part; rules are given apart (rules_from_graph reads them). short: containers, labels and
    scopes by local name instead of IRI."""
    spark, t = triples.sparkSession, _named(triples)
    name = (lambda c: fragment(F.col(c))) if short else F.col

    def pairs(p: str, a: str, b: str, swap: bool = False) -> DataFrame:
        s, o = ("o", "s") if swap else ("s", "o")
        return t.where(F.col("p") == p).select(name(s).alias(a), name(o).alias(b)).distinct()

    union = lambda x: reduce(DataFrame.unionByName, x).distinct()
    contains = union([*(pairs(p, "parent", "child") for p in ("contains", "hasTables", "hasRecords", "hasField")), pairs("recordOf", "parent", "child", True), pairs("fieldOf", "parent", "child", True)])
    kinds = t.where(F.col("p") == "type").select(name("s").alias("container"), fragment(F.col("o")).alias("k"))
    kinds = kinds.where(F.col("k").isin("DataContainer", "Database", "Table", "Record", "Field")).groupBy("container").agg(F.max(F.when(F.col("k") != "DataContainer", F.lower("k"))).alias("kind"))
    everyone = union([contains.select(F.col("parent").alias("container")), contains.select(F.col("child").alias("container")), kinds.select("container")])
    records = union([pairs("hasRecords", "table", "record"), pairs("recordOf", "table", "record", True)])
    cells = union([pairs("hasField", "record", "field"), pairs("fieldOf", "record", "field", True)])
    field_name = t.where("p = 'fieldName'").select(name("s").alias("field"), F.col("o").alias("name"))
    field_value = t.where("p = 'fieldValue'").select(name("s").alias("field"), F.col("o").alias("value"), F.coalesce("datatype", "kind").alias("datatype"))
    fields = cells.join(records, "record").join(field_name, "field").join(field_value, "field", "left")
    decl = t.where("p = 'declaresField'").select(name("s").alias("table"), F.col("o").alias("d"))
    decl_name = t.where("p = 'forFieldName'").select(F.col("s").alias("d"), F.col("o").alias("name"))
    decl_label = t.where("p = 'hasLabel'").select(F.col("s").alias("d"), name("o").alias("label"))
    frameworks = t.where("p = 'type'").where(fragment(F.col("o")) == "Framework").select(name("s").alias("framework"))
    return E.Env(spark, {
        "containers": everyone.join(kinds, "container", "left").select("container", "kind", F.col("container").alias("name")),
        "contains": contains, "availability": pairs("availableInScope", "container", "scope"), "joinable": pairs("joinableWith", "a", "b"), "tags": pairs("hasTag", "container", "label"), "fields": fields,
        "field_decls": decl.join(decl_name, "d").join(decl_label, "d").select("table", "name", "label").distinct(),
        "labels": pairs("introducedByFramework", "label", "introduced_by"),
        "label_facets": union([pairs("belongsToFacet", "label", "facet"), pairs("hasLabel", "label", "facet", True).join(t.where("p = 'type'").where(fragment(F.col("o")) == "Facet").select(name("s").alias("facet")), "facet").select("label", "facet")]),
        "frameworks": frameworks.join(pairs("extends", "framework", "extends"), "framework", "left").join(pairs("subFrameworkOf", "framework", "sub_framework_of"), "framework", "left").select("framework", "extends", "sub_framework_of", F.lit(None).cast("string").alias("type")),
    }, rules)


def list_items(triples: DataFrame) -> DataFrame:
    """(list, position, item) of RDF collections, by their heads."""
    return lists.items(_named(triples))


def rules_from_graph(triples: DataFrame, short: bool = True) -> E.Rules:
    """Rules of a graph's frameworks. They are vocabularies: their triples, without those of data, come to the driver (at most a million)."""
    words = (
        "type", "first", "rest", "hasPropagationRule", "propagatesFacet", "propagatesLabel", "propagationBehavior", "declaresSubclassOf", "isSubclassOf", "declaresImplication", "declaresEquivalent", "declaresConditional",
        "fromLabel", "fromAnyLabel", "fromAllLabels", "toLabel", "toAnyLabel", "toAllLabels", "hasCondition", "logicalOperator", "requiresContains", "requiresLabel", "requiresJoinableContains", "onRelation",
        "overrides", "leftSource", "rightSource", "comparisonOperator", "sourceLabel", "sourceParameter", "literalValue", "defaultValue",
    )
    t = _named(triples).where(F.col("p").isin(*words))
    if t.limit(1_000_001).count() > 1_000_000:
        raise ValueError("over a million triples of rules")
    graph: dict[str, dict[str, list[str]]] = {}
    for s, p, o in t.select("s", "p", "o").collect():
        graph.setdefault(s, {}).setdefault(p, []).append(o)
    return _Rules(graph, short).read()


class _Rules:
    def __init__(self, graph: dict[str, dict[str, list[str]]], short: bool):
        self.graph, self.name = graph, self.short if short else str

    @staticmethod
    def short(x: str) -> str:
        return x.rsplit("#", 1)[-1] if "#" in x else x.rsplit("/", 1)[-1]

    def get(self, node: str, *names: str) -> list[str]:
        found = self.graph.get(node, {})
        return sorted(o for n in names for o in found.get(n, []))

    def one(self, node: str, name: str) -> str | None:
        return next(iter(self.get(node, name)), None)

    def items(self, node: str) -> list[str]:
        out = []
        while node in self.graph and "first" in self.graph[node]:
            out += self.graph[node]["first"]
            node = self.graph[node].get("rest", [""])[0]
        return out

    def labels(self, node: str, *names: str) -> tuple[str, ...]:
        out = []
        for o in self.get(node, *names):
            out += self.items(o) or [o]
        return tuple(map(self.name, out))

    def conditions(self, node: str) -> tuple:
        return tuple(map(self.condition, self.get(node, "hasCondition")))

    def condition(self, node: str):
        kinds = set(map(self.short, self.get(node, "type")))
        if "CompositeCondition" in kinds:
            return (E.Any if self.short(self.one(node, "logicalOperator") or "AND") == "OR" else E.All)(self.conditions(node))
        if "ContainsLabelCondition" in kinds:
            return E.Contains(self.name(self.one(node, "requiresContains")))
        if "JoinableLabelCondition" in kinds:
            return E.JoinableTo(self.name(self.one(node, "requiresJoinableContains")))
        if "HasLabelCondition" in kinds:
            return E.Has(self.name(self.one(node, "requiresLabel")))
        if "RelationLabelCondition" in kinds:
            relation = self.short(self.one(node, "onRelation") or "Self")
            return E.Related(self.name(self.one(node, "requiresLabel")), {"Peer": "Sibling"}.get(relation, relation))
        if "ComparisonCondition" in kinds:
            ops = {"lessThan": "<", "lessThanOrEqual": "<=", "greaterThan": ">", "greaterThanOrEqual": ">=", "equals": "==", "notEquals": "!="}
            op = self.short(self.one(node, "comparisonOperator"))
            return E.Compare(self.operand(self.one(node, "leftSource")), ops.get(op, op), self.operand(self.one(node, "rightSource")))
        raise ValueError(f"unknown condition {sorted(kinds)}")

    def operand(self, node: str | None) -> E.Operand:
        label = self.one(node, "sourceLabel")
        return E.Operand(label and self.name(label), self.one(node, "sourceParameter"), self.one(node, "literalValue"), self.one(node, "defaultValue"))

    def read(self) -> E.Rules:
        out = E.Rules()
        for framework in sorted(self.graph):
            f = self.name(framework)
            for r in self.get(framework, "hasPropagationRule"):
                for d in map(self.short, self.get(r, "propagationBehavior")):
                    out += E.Rules(propagations=(*(E.Propagation(f, d, label=x) for x in self.labels(r, "propagatesLabel")), *(E.Propagation(f, d, facet=x) for x in self.labels(r, "propagatesFacet"))))
            for r in self.get(framework, "declaresSubclassOf"):
                out += E.Rules(subclasses=tuple(E.Subclass(f, self.labels(r, "fromLabel", "fromAnyLabel"), x, r) for x in self.labels(r, "isSubclassOf")))
            out += E.Rules(overrides=tuple(E.Override(f, r) for r in self.get(framework, "overrides")))
            for r in self.get(framework, "declaresImplication"):
                every = self.labels(r, "fromAllLabels")
                out += E.Rules(implications=(E.Implication(f, every or self.labels(r, "fromLabel", "fromAnyLabel"), self.labels(r, "toLabel", "toAnyLabel", "toAllLabels"), self.conditions(r), bool(every), r),))
            for r in self.get(framework, "declaresEquivalent"):
                out += E.Rules(equivalences=tuple(E.Equivalence(f, self.labels(r, "fromLabel", "fromAllLabels"), x, self.conditions(r), r) for x in self.labels(r, "toLabel")))
            for r in self.get(framework, "declaresConditional"):
                out += E.Rules(conditionals=tuple(E.Conditional(f, c, x, r) for c in self.conditions(r) for x in self.labels(r, "toLabel")))
        return out
