"""The queries of the library's operators over order-management tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave import env as E
from labelweave.functions import builtins, text
from labelweave.operators import closure, conditions, kanon, query
from labelweave.operators import rules as R
from labelweave.plans import engine, ruletext, sparql
from labelweave.sources import warehouse as W
from labelweave.storage import drop

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class World:
    """An environment and what most queries start from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.env = W.environment(spark, sf_dir)
        self.contains = self.env.contains
        self._avail = self._ancestors = None

    @property
    def avail(self) -> DataFrame:
        if self._avail is None:
            self._avail = closure.available(self.env.availability, self.contains)
        return self._avail

    @property
    def ancestors(self) -> DataFrame:
        if self._ancestors is None:
            self._ancestors = closure.ancestors(self.contains)
        return self._ancestors

    @property
    def a0(self) -> DataFrame:
        """Ground facts."""
        return R.tags(self.env.tags, self.env.labels, self.avail)

    @property
    def has(self) -> DataFrame:
        return R.labelled(self.a0)

    @property
    def joinable(self) -> DataFrame:
        return closure.symmetric(self.env.joinable)

    def table(self, rows: list[tuple], schema: str) -> DataFrame:
        return R.rule_table(self.spark, rows, schema)

    @property
    def propagations(self) -> DataFrame:
        return E.facet_expanded(self.env)

    def holds(self, condition) -> DataFrame:
        return conditions.Evaluator(self.facts, self.avail, self.contains, lambda: self.ancestors, self.joinable)(condition)

    @property
    def facts(self) -> DataFrame:
        """Ground facts and, on nations, a fact with a parameter: the number of customers."""
        n = W.read(self.spark, self.dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
        own = n.select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("container"), F.create_map(F.lit("size"), F.col("n").cast("string")).alias("params"))
        own = own.join(self.avail, "container").select("container", F.lit("Sized").alias("label"), "scope", F.lit("base").alias("framework"), "params")
        return self.a0.withColumn("params", F.lit(None).cast("map<string,string>")).unionByName(own)

    @property
    def quasi(self) -> DataFrame:
        facts = R.field_declarations(self.env.field_decls, self.env.fields, self.env.labels, self.avail)
        return facts.where("label = 'Quasi'").select("container", "scope")


def world(spark: SparkSession, sf_dir: str) -> World:
    """One per session and folder: its closures are written tables."""
    held = spark.__dict__.setdefault("_labelweave_worlds", {})
    if sf_dir not in held:
        held[sf_dir] = World(spark, sf_dir)
    return held[sf_dir]


def forget(spark: SparkSession) -> None:
    """What the session's worlds have worked out: the next query starts from the tables."""
    for w in spark.__dict__.pop("_labelweave_worlds", {}).values():
        drop(w._avail, w._ancestors)


def values(rows) -> str:
    one = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


_FACET = {f: [l for l, g in W.FACETS if g == f] for _, f in W.FACETS}
_PROPAGATIONS = sorted({(r.framework, l, r.direction) for r in W.PROPAGATIONS for l in ([r.label] if r.label else _FACET[r.facet])})
PRE = f"""WITH RECURSIVE contains(parent, child) AS (
  SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM nation UNION SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
  UNION SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier UNION SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders),
expl(container, scope) AS (SELECT 'R' || r_regionkey, 'G' || r_regionkey FROM region UNION SELECT 'N' || n_nationkey, 'ALL' FROM nation WHERE n_regionkey = 2),
avail(container, scope) AS (SELECT * FROM expl UNION SELECT c.child, a.scope FROM avail a JOIN contains c ON c.parent = a.container),
anc(ancestor, descendant) AS (SELECT * FROM contains UNION SELECT a.ancestor, c.child FROM anc a JOIN contains c ON c.parent = a.descendant),
j1(a, b) AS (SELECT 'S' || m, 'S' || s_suppkey FROM supplier JOIN (SELECT s_nationkey AS k, min(s_suppkey) AS m FROM supplier GROUP BY 1) ON k = s_nationkey WHERE s_suppkey <> m),
joinable(a, b) AS (SELECT a, b FROM j1 UNION SELECT b, a FROM j1),
tags(container, label) AS (SELECT 'C' || c_custkey, 'Seg_' || c_mktsegment FROM customer UNION SELECT 'C' || c_custkey, 'Debt' FROM customer WHERE c_acctbal < 0
  UNION SELECT 'O' || o_orderkey, 'Status_' || o_orderstatus FROM orders UNION SELECT 'S' || s_suppkey, 'Risky' FROM supplier WHERE s_acctbal < 0
  UNION SELECT 'N' || n_nationkey, 'Trade' FROM nation WHERE n_regionkey <> 1),
labels(label, introduced_by) AS (VALUES {values(W.LABELS)}),
facets(label, facet) AS (VALUES {values(W.FACETS)}),
prules(framework, label, direction) AS (VALUES {values(_PROPAGATIONS)}),
a0(container, label, scope, framework) AS (SELECT DISTINCT t.container, t.label, v.scope, l.introduced_by FROM tags t JOIN labels l USING (label) JOIN avail v USING (container)),
has(container, label, scope) AS (SELECT DISTINCT container, label, scope FROM a0),
sized(container, scope, n) AS (SELECT v.container, v.scope, count(*) FROM customer JOIN avail v ON v.container = 'N' || c_nationkey GROUP BY 1, 2),
cells(record, tbl, name, value) AS (SELECT 'C' || c_custkey, 'N' || c_nationkey, 'segment', c_mktsegment FROM customer
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'band', floor(c_acctbal / 2000)::BIGINT::VARCHAR FROM customer)"""


def register(name: str, sql: str | None, fn: Callable[[World], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn(world(spark, sf_dir))
    if sql:
        SQL[name] = sql


def over(name: str, tail: str, fn: Callable[[World], DataFrame], more: str = "") -> None:
    """more: further common table expressions (with a leading comma)."""
    register(name, PRE + more + "\n" + tail, fn)


KEY = "container, label, scope, framework"
# --- edges, closures, ground facts

over("contains_edges", "SELECT parent, child FROM contains", lambda w: closure.contains_edges(w.contains))
over("availability_closure", "SELECT container, scope FROM avail", lambda w: w.avail)
over("ancestors_closure", "SELECT ancestor, descendant FROM anc", lambda w: w.ancestors)
over("visibility_assertions", "SELECT container, 'Available' AS label, scope, 'ExternalFramework' AS framework FROM avail", lambda w: R.visibility(w.avail))
over("joinable_symmetric", "SELECT a, b FROM joinable", lambda w: w.joinable)
over("tags_materialize", f"SELECT {KEY} FROM a0", lambda w: w.a0)
over(
    "field_declarations", "SELECT DISTINCT record || '.' || name AS container, 'Quasi' AS label, scope, 'base' AS framework FROM cells JOIN avail ON container = tbl",
    lambda w: R.field_declarations(w.env.field_decls, w.env.fields, w.env.labels, w.avail),
)
over(
    "field_tags", "SELECT DISTINCT tbl AS container, 'Trade' AS label, scope, f AS framework, record || '.' || name AS on_field FROM cells JOIN avail ON container = tbl, (VALUES ('base'), ('strict')) x(f) ",
    lambda w: R.field_tags(w.env.fields.select(F.col("field").alias("container"), F.lit("Trade").alias("label")), w.env.fields, w.env.labels, w.avail),
)
# --- rule tables, each at work on the facts

_CHAIN = f""", f(framework, extends, s, t) AS (VALUES {values(W.FRAMEWORKS)}),
c(framework, ancestor, depth) AS (SELECT framework, framework, 0 FROM f UNION SELECT c.framework, f.extends, depth + 1 FROM c JOIN f ON f.framework = c.ancestor WHERE f.extends IS NOT NULL)"""
over(
    "framework_chain", "SELECT DISTINCT a.container, a.label, a.scope, c.framework FROM a0 a JOIN c ON c.ancestor = a.framework",
    lambda w: w.a0.withColumnRenamed("framework", "ancestor").join(F.broadcast(closure.framework_chain(w.env.frameworks)), "ancestor").select(*E.KEY).distinct(), _CHAIN,
)
_RULES = [("base", "Trade", "Inward"), ("base", "Seg_BUILDING", "Inward"), ("strict", "Debt", "Outward"), ("stat", "Risky", "Inward"), ("strict", "Trade", "Inward")]
over(
    "inherit_propagation_rules",
    f"""SELECT DISTINCT e.child AS container, r.label, h.scope, c.framework FROM c JOIN (VALUES {values(_RULES)}) r(framework, label, direction) ON r.framework = c.ancestor
    JOIN has h ON h.label = r.label JOIN contains e ON e.parent = h.container JOIN avail v ON v.container = e.child AND v.scope = h.scope WHERE r.direction = 'Inward'""",
    lambda w: _inherited_inward(w), _CHAIN,
)


def _inherited_inward(w: World) -> DataFrame:
    """Labels, whatever their framework, go down under every framework that has a rule for it, its own or inherited."""
    rules = R.inherit(w.table(_RULES, "framework string, label string, direction string"), closure.framework_chain(w.env.frameworks))
    facts = w.has.join(F.broadcast(rules.select("framework", "label").distinct()), "label")
    return R.propagate_inward(facts, rules, w.contains, w.avail).select(*E.KEY).distinct()


_DECLS = [("base", "d1", "Trade", "Open"), ("base", "d2", "Debt", "Owing"), ("strict", "d3", "Trade", "Owing"), ("stat", "d4", "Risky", "Watch")]
_OVER = [("strict", "d1"), ("deep", "d2")]
over(
    "inherit_subclass_overrides",
    f"""SELECT DISTINCT h.container, r.target AS label, h.scope, c.framework, r.decl FROM c JOIN (VALUES {values(_DECLS)}) r(framework, decl, source, target) ON r.framework = c.ancestor
    JOIN has h ON h.label = r.source WHERE NOT EXISTS (
      SELECT 1 FROM c d JOIN (VALUES {values(_OVER)}) o(framework, decl) ON o.framework = d.ancestor JOIN c e ON e.framework = o.framework AND e.ancestor = r.framework AND e.depth > 0
      WHERE d.framework = c.framework AND o.decl = r.decl)""",
    lambda w: R.subclass(w.has, R.inherit(w.table(_DECLS, "framework string, rule string, source string, target string"), closure.framework_chain(w.env.frameworks), w.table(_OVER, "framework string, rule string"), "rule"))
    .withColumnRenamed("rule", "decl").distinct(), _CHAIN,
)
_KEYED = [("base", "Trade", "Kept", "r1"), ("strict", "Risky", "Kept", "r2"), ("base", "Debt", "Shown", "r3"), ("deep", "Seg_BUILDING", "Shown", "r4")]


def _depth(w: World) -> DataFrame:
    from labelweave.plans.compile import chains

    rows = [(f, up, i) for f, ups in chains([(r[0], r[1]) for r in W.FRAMEWORKS]).items() for i, up in enumerate(ups)]
    return w.table(rows, "framework string, ancestor string, depth int")


over(
    "effective_rules",
    f"""SELECT DISTINCT h.container, x.target AS label, h.scope, x.framework, x.rule FROM (
      SELECT c.framework, r.source, r.target, r.rule, depth, min(depth) OVER (PARTITION BY c.framework, target) AS m FROM c JOIN (VALUES {values(_KEYED)}) r(framework, source, target, rule) ON r.framework = c.ancestor) x
    JOIN has h ON h.label = x.source WHERE depth = m""",
    lambda w: R.subclass(w.has, R.effective(w.table(_KEYED, "framework string, source string, target string, rule string"), _depth(w), ["target"])).distinct(), _CHAIN,
)
over(
    "facet_rule_expansion", f"SELECT {KEY}, direction FROM a0 JOIN prules USING (framework, label)",
    lambda w: w.a0.join(F.broadcast(w.propagations), ["framework", "label"]).select(*E.KEY, "direction"),
)
#: Rules by lists: any of the sources gives each of the targets.
_LISTS = [E.Implication("base", ("Debt", "Risky"), ("Watched",), name="i1"), E.Implication("strict", ("Trade",), ("Open", "Routed"), name="i2"), E.Implication("base", ("Debt", "Trade", "Status_F"), ("Watched", "Closed"), name="i3")]
_LIST_SQL = "VALUES " + ", ".join(f"('{i.framework}', '{i.name}', {list(i.sources)}, {list(i.targets)})" for i in _LISTS)


def _listed(w: World, rules: tuple, any_of: bool = False) -> DataFrame:
    """What the compiled forms of rules give of the ground facts in one step."""
    from labelweave.plans.compile import compile_rules

    compiled = compile_rules(w.env.with_rules(rules), inherit=(), close_labels=False)
    steps = w.table([(f, rule, s, t) for s, t, f, rule in compiled.label_steps], "framework string, rule string, source string, target string")
    out = R.implication(w.has, steps)
    if compiled.every:
        out = out.unionByName(R.implication_all(w.has, w.spark.createDataFrame([x[:4] for x in compiled.every], "framework string, rule string, sources array<string>, target string")))
    return out


over(
    "implication_expand_any",
    f"SELECT DISTINCT h.container, h.label AS source, h.scope, x.framework, x.rule || '-from-' || url_encode(x.source) AS rule FROM (SELECT framework, rule, unnest(sources) AS source FROM ({_LIST_SQL}) x(framework, rule, sources, targets)) x JOIN has h ON h.label = x.source",
    lambda w: _from_each(w),
)


def _from_each(w: World) -> DataFrame:
    """The facts that each source of a rule starts from, under the name that the expanded rule has."""
    rows = w.table([(i.framework, i.name, list(i.sources)) for i in _LISTS], "framework string, rule string, sources array<string>").select("framework", "rule", F.explode("sources").alias("source"))
    return w.has.withColumnRenamed("label", "source").join(rows, "source").select("container", "source", "scope", "framework", F.concat("rule", F.lit("-from-"), text.encode_uri(F.col("source"))).alias("rule"))


over(
    "implication_expand_to",
    f"SELECT DISTINCT h.container, x.target AS label, h.scope, x.framework, x.rule FROM (SELECT framework, rule, sources, unnest(targets) AS target FROM ({_LIST_SQL}) x(framework, rule, sources, targets)) x JOIN has h ON list_contains(x.sources, h.label)",
    lambda w: _listed(w, E.Rules(implications=tuple(_LISTS))).distinct(),
)
_EQUIV = (E.Equivalence("base", ("Debt", "Seg_BUILDING"), "DebtBuilder", (), "e1"), E.Equivalence("strict", ("Trade",), "Open", (), "e2"), E.Equivalence("stat", ("Watched", "Closed"), "Risky", (), "e3"))
over(
    "equivalence_expand",
    """SELECT container, 'DebtBuilder' AS label, scope, 'base' AS framework FROM has WHERE label IN ('Debt', 'Seg_BUILDING') GROUP BY container, scope HAVING count(DISTINCT label) = 2
    UNION ALL SELECT container, 'Open', scope, 'strict' FROM has WHERE label = 'Trade' UNION ALL SELECT container, unnest(['Watched', 'Closed']), scope, 'stat' FROM has WHERE label = 'Risky'""",
    lambda w: _listed(w, E.Rules(equivalences=_EQUIV)).select(*E.KEY).distinct(),
)

# --- propagation

over("propagate_inward", f"SELECT DISTINCT e.child AS container, a.label, a.scope, a.framework FROM a0 a JOIN prules r ON r.framework = a.framework AND r.label = a.label AND direction = 'Inward' JOIN contains e ON e.parent = a.container JOIN avail v ON v.container = e.child AND v.scope = a.scope", lambda w: R.propagate_inward(w.a0, w.propagations, w.contains, w.avail).select(*E.KEY).distinct())
over("propagate_outward", f"SELECT DISTINCT e.parent AS container, a.label, a.scope, a.framework FROM a0 a JOIN prules r ON r.framework = a.framework AND r.label = a.label AND direction = 'Outward' JOIN contains e ON e.child = a.container JOIN avail v ON v.container = e.parent AND v.scope = a.scope", lambda w: R.propagate_outward(w.a0, w.propagations, w.contains, w.avail).select(*E.KEY).distinct())
over("propagate_peer", f"SELECT {KEY} FROM (SELECT DISTINCT f.child AS container, a.label, a.scope, a.framework FROM a0 a JOIN prules r ON r.framework = a.framework AND r.label = a.label AND direction = 'Peer' JOIN contains e ON e.child = a.container JOIN contains f ON f.parent = e.parent AND f.child <> e.child) x WHERE NOT EXISTS (SELECT 1 FROM a0 b WHERE b.container = x.container AND b.label = x.label AND b.scope = x.scope AND b.framework = x.framework) AND (container, scope) IN (SELECT (container, scope) FROM avail)", lambda w: R.propagate_peer(w.a0, w.propagations, w.contains, w.avail).select(*E.KEY).distinct().join(w.a0, E.KEY, "left_anti"))
over("propagate_joinable", f"SELECT DISTINCT j.b AS container, a.label, a.scope, a.framework FROM a0 a JOIN prules r ON r.framework = a.framework AND r.label = a.label AND direction = 'Joinable' JOIN joinable j ON j.a = a.container JOIN avail v ON v.container = j.b AND v.scope = a.scope", lambda w: R.propagate_joinable(w.a0, w.propagations, w.joinable, w.avail).select(*E.KEY).distinct())
over(
    "propagate_params", "SELECT DISTINCT e.child AS container, 'Sized' AS label, s.scope, s.n::VARCHAR AS size FROM sized s JOIN contains e ON e.parent = s.container",
    lambda w: R.propagate_inward(w.facts.where("label = 'Sized'"), w.table([("base", "Sized", "Inward")], "framework string, label string, direction string"), w.contains, w.avail).select("container", "label", "scope", F.col("params")["size"].alias("size")).distinct(),
)
_STEP = """SELECT e.child, a.label, a.scope, a.framework FROM x a JOIN prules r ON r.framework = a.framework AND r.label = a.label AND direction = 'Inward' JOIN contains e ON e.parent = a.container JOIN avail v ON v.container = e.child AND v.scope = a.scope"""
_JOIN = """SELECT j.b, a.label, a.scope, a.framework FROM x a JOIN prules r ON r.framework = a.framework AND r.label = a.label AND direction = 'Joinable' JOIN joinable j ON j.a = a.container JOIN avail v ON v.container = j.b AND v.scope = a.scope"""
_OUT = """SELECT e.parent, a.label, a.scope, a.framework FROM x a JOIN prules r ON r.framework = a.framework AND r.label = a.label AND direction = 'Outward' JOIN contains e ON e.child = a.container JOIN avail v ON v.container = e.parent AND v.scope = a.scope"""
_PEER = """SELECT e.child, a.label, a.scope, a.framework FROM x a JOIN prules r ON r.framework = a.framework AND r.label = a.label AND direction = 'Peer' JOIN contains p ON p.child = a.container JOIN contains e ON e.parent = p.parent JOIN avail v ON v.container = e.child AND v.scope = a.scope"""


def _only(w: World, parents: bool = False, **rules) -> DataFrame:
    env = w.env.with_rules(E.Rules(**rules))
    if not parents:
        env = env.with_tables(frameworks=env.frameworks.withColumn("sub_framework_of", F.lit(None).cast("string")))
    found = engine.infer(env, with_k=False, inherit=()).assertions
    return found.where("label NOT IN ('Available', 'Quasi')").select(*E.KEY)


_DIR = lambda d: tuple(r for r in W.PROPAGATIONS if r.direction == d)
over("fixpoint_inward", f"SELECT {KEY} FROM x", lambda w: _only(w, propagations=_DIR("Inward")), f", x({KEY}) AS (SELECT * FROM a0 UNION {_STEP})")
over("fixpoint_joinable", f"SELECT {KEY} FROM x", lambda w: _only(w, propagations=_DIR("Joinable")), f", x({KEY}) AS (SELECT * FROM a0 UNION {_JOIN})")
_SUB = [(r.framework, s, r.target, r.name) for r in W.SUBCLASSES for s in r.sources]
_SUBS = f", srules(framework, source, target, rule) AS (VALUES {values(_SUB)})"
_STAT = [(f, s) for f, _, s, _ in W.FRAMEWORKS if s]
_UPS = f", ups(framework, up) AS (VALUES {values(_STAT)})"
over(
    "fixpoint_mixed_linear", f"SELECT {KEY} FROM x", lambda w: _only(w, True, propagations=W.PROPAGATIONS, subclasses=W.SUBCLASSES),
    f"{_SUBS}{_UPS}, x({KEY}) AS (SELECT * FROM a0 UNION (SELECT container, s.target, scope, s.framework FROM x JOIN srules s ON s.source = x.label UNION ALL {_STEP} UNION ALL {_JOIN} UNION ALL {_OUT} UNION ALL {_PEER} UNION ALL SELECT container, label, scope, u.up FROM x JOIN ups u ON u.framework = x.framework))",
)

over(
    "infer_with_conditions",
    f"""SELECT DISTINCT {KEY} FROM (SELECT * FROM x UNION SELECT container, 'DebtBuilder', scope, 'strict' FROM x WHERE label IN ('Debt', 'Seg_BUILDING') GROUP BY container, scope HAVING count(DISTINCT label) = 2
    UNION SELECT x.container, 'TradeDebt', x.scope, 'base' FROM x JOIN contains e ON e.parent = x.container JOIN x y ON y.container = e.child AND y.scope = x.scope WHERE x.label = 'Trade' AND y.label = 'Debt')""",
    lambda w: _only(
        w, propagations=_DIR("Inward"),
        implications=(E.Implication("strict", ("Debt", "Seg_BUILDING"), ("DebtBuilder",), (), True, "all"), E.Implication("base", ("Trade",), ("TradeDebt",), (E.Related("Debt", "Child"),), False, "cond")),
    ),
    f", x({KEY}) AS (SELECT * FROM a0 UNION {_STEP})",
)

# --- subclass and implication

over("subclass_step", "SELECT DISTINCT container, target AS label, scope, framework FROM has JOIN srules ON source = label", lambda w: R.subclass(w.has, w.table(_SUB, "framework string, source string, target string, rule string")).select(*E.KEY).distinct(), _SUBS)
over("subclass_chain", f"SELECT {KEY} FROM x", lambda w: _only(w, subclasses=W.SUBCLASSES), f"{_SUBS}, x({KEY}) AS (SELECT * FROM a0 UNION SELECT container, s.target, scope, s.framework FROM x JOIN srules s ON s.source = x.label)".replace("SELECT * FROM a0 UNION SELECT", "SELECT * FROM a0 UNION SELECT"))
_IMPL = [("base", "i1", "Status_F", "Closed"), ("strict", "i2", "Status_O", "Open"), ("base", "i3", "Trade", "Open")]
over("implication_unconditional", f"SELECT DISTINCT container, i.target AS label, scope, i.framework FROM has JOIN (VALUES {values(_IMPL)}) i(framework, rule, source, target) ON i.source = label", lambda w: R.implication(w.has, w.table(_IMPL, "framework string, rule string, source string, target string")).select(*E.KEY).distinct())
over(
    "implication_conditional", "SELECT container, 'TradeDebt' AS label, scope, 'base' AS framework FROM has h WHERE label = 'Trade' AND EXISTS (SELECT 1 FROM has g JOIN contains e ON e.child = g.container WHERE e.parent = h.container AND g.scope = h.scope AND g.label = 'Debt')",
    lambda w: R.implication(w.has, w.table([("base", "c1", "Trade", "TradeDebt", 0)], "framework string, rule string, source string, target string, condition int"), w.holds(E.Related("Debt", "Child")).withColumn("condition", F.lit(0))).select(*E.KEY),
)
over(
    "implication_pure", "SELECT container, 'Holder' AS label, scope, 'strict' AS framework FROM avail v WHERE EXISTS (SELECT 1 FROM has h WHERE h.label = 'Risky' AND h.scope = v.scope AND (h.container = v.container OR (v.container, h.container) IN (SELECT (ancestor, descendant) FROM anc)))",
    lambda w: w.holds(E.Contains("Risky")).select("container", F.lit("Holder").alias("label"), "scope", F.lit("strict").alias("framework")),
)
_ALL = [("strict", "f1", ["Debt", "Seg_BUILDING", "Debt"], "DebtBuilder"), ("base", "f2", ["Trade", "Missing"], "Never")]
over(
    "implication_from_all", "SELECT container, 'DebtBuilder' AS label, scope, 'strict' AS framework FROM has WHERE label IN ('Debt', 'Seg_BUILDING') GROUP BY container, scope HAVING count(DISTINCT label) = 2",
    lambda w: R.implication_all(w.has, w.table(_ALL, "framework string, rule string, sources array<string>, target string")).select(*E.KEY),
)
over("parent_framework", "SELECT DISTINCT container, label, scope, u.up AS framework FROM a0 JOIN ups u USING (framework)", lambda w: R.parent_framework(w.a0, w.env.frameworks).distinct(), _UPS)

# --- conditions

_REL = {
    "self": ("Self", "Trade", "h.container = v.container"),
    "parent": ("Parent", "Trade", "EXISTS (SELECT 1 FROM contains e WHERE e.parent = h.container AND e.child = v.container)"),
    "child": ("Child", "Debt", "EXISTS (SELECT 1 FROM contains e WHERE e.child = h.container AND e.parent = v.container)"),
}
over("cond_has_label", "SELECT container, scope FROM has WHERE label = 'Debt'", lambda w: w.holds(E.Has("Debt")))
over("cond_contains", "SELECT DISTINCT v.container, v.scope FROM avail v JOIN (SELECT container, scope FROM has WHERE label = 'Status_P' UNION SELECT ancestor, scope FROM has JOIN anc ON descendant = container WHERE label = 'Status_P') h ON h.container = v.container AND h.scope = v.scope", lambda w: w.holds(E.Contains("Status_P")))
over("cond_self", "SELECT container, scope FROM has WHERE label = 'Trade'", lambda w: w.holds(E.Related("Trade", "Self")))
over("cond_parent", "SELECT DISTINCT child AS container, scope FROM has JOIN contains ON parent = container WHERE label = 'Trade'", lambda w: w.holds(E.Related("Trade", "Parent")))
over("cond_child", "SELECT DISTINCT parent AS container, scope FROM has JOIN contains ON child = container WHERE label = 'Debt'", lambda w: w.holds(E.Related("Debt", "Child")))
over("cond_descendant", "SELECT DISTINCT ancestor AS container, scope FROM has JOIN anc ON descendant = container WHERE label = 'Debt'", lambda w: w.holds(E.Related("Debt", "Descendant")))
over("cond_ancestor", "SELECT DISTINCT descendant AS container, scope FROM has JOIN anc ON ancestor = container WHERE label = 'Trade'", lambda w: w.holds(E.Related("Trade", "Ancestor")))
over("cond_sibling", "SELECT DISTINCT y.child AS container, scope FROM has JOIN contains x ON x.child = container JOIN contains y ON y.parent = x.parent AND y.child <> x.child WHERE label = 'Risky'", lambda w: w.holds(E.Related("Risky", "Sibling")))
over("cond_joinable", "SELECT DISTINCT j.a AS container, h.scope FROM has h JOIN joinable j ON j.b = h.container JOIN avail v ON v.container = j.b AND v.scope = h.scope WHERE label = 'Risky'", lambda w: w.holds(E.JoinableTo("Risky")))
_SIZE = E.Operand("Sized", "size")
for _name, _op, _sql in (("lt", "<", "<"), ("le", "<=", "<="), ("gt", ">", ">"), ("ge", ">=", ">="), ("eq", "==", "="), ("ne", "!=", "<>")):
    over(f"cond_comparison_{_name}", f"SELECT container, scope FROM sized WHERE n {_sql} 59", lambda w, op=_op: w.holds(E.Compare(_SIZE, op, E.Operand(literal=59))))
over("cond_in_range", "SELECT container, scope FROM sized WHERE n BETWEEN 55 AND 65", lambda w: w.holds(E.Compare(_SIZE, "inRange", E.Operand(literal=55), E.Operand(literal=65))))
over("cond_default_threshold", "SELECT v.container, v.scope FROM avail v LEFT JOIN sized s ON s.container = v.container AND s.scope = v.scope WHERE coalesce(s.n, 3) < 59", lambda w: w.holds(E.Compare(E.Operand("Sized", "size", default=3), "<", E.Operand(literal=59))))
_DEBT_CHILD = "SELECT DISTINCT parent AS container, scope FROM has JOIN contains ON child = container WHERE label = 'Debt'"
over("cond_and", f"SELECT container, scope FROM has WHERE label = 'Trade' INTERSECT {_DEBT_CHILD}", lambda w: w.holds(E.All((E.Has("Trade"), E.Related("Debt", "Child")))))
over("cond_or", f"SELECT container, scope FROM has WHERE label = 'Trade' UNION {_DEBT_CHILD}", lambda w: w.holds(E.Any((E.Has("Trade"), E.Related("Debt", "Child")))))
over(
    "cond_nested", "SELECT container, scope FROM (SELECT DISTINCT child AS container, scope FROM has JOIN contains ON parent = container WHERE label = 'Trade') INTERSECT (SELECT container, scope FROM has WHERE label = 'Debt' UNION SELECT container, scope FROM has WHERE label = 'Risky')",
    lambda w: w.holds(E.All((E.Related("Trade", "Parent"), E.Any((E.Has("Debt"), E.Has("Risky")))))),
)
over("marks", "SELECT DISTINCT 'k1' AS condition, container, scope FROM has h WHERE label = 'Debt' AND NOT EXISTS (SELECT 1 FROM has g WHERE g.container = h.container AND g.scope = h.scope AND g.label = 'Seg_BUILDING')", lambda w: conditions.demanded(w.has, w.table([("k1", "Debt", "Seg_BUILDING")], "condition string, source string, target string")))
over(
    "marks_from_all", "SELECT 'k2' AS condition, container, scope FROM has WHERE label IN ('Debt', 'Seg_MACHINERY', 'Trade') GROUP BY container, scope HAVING count(DISTINCT label) FILTER (label <> 'Trade') = 2 AND count(*) FILTER (label = 'Trade') = 0",
    lambda w: conditions.demanded_all(w.has, w.table([("base", "m", ["Debt", "Seg_MACHINERY"], "Trade", "k2")], "framework string, rule string, sources array<string>, target string, condition string")),
)
over("containment_assertions", f"SELECT {KEY} FROM (SELECT * FROM a0 UNION SELECT ancestor, label, scope, framework FROM a0 JOIN anc ON descendant = container) JOIN avail USING (container, scope) WHERE label IN ('Debt', 'Risky')", lambda w: R.containment(w.a0, w.ancestors, w.avail, w.table([("Debt",), ("Risky",)], "label string")).select(*E.KEY))
over("label_scope_index", "SELECT container, label, scope FROM has", lambda w: w.has)

# --- k-anonymity

_SIG = ", sig(tbl, scope, record, signature) AS (SELECT tbl, scope, record, string_agg(name || '=' || value, ';' ORDER BY name) FROM cells JOIN avail ON container = tbl GROUP BY 1, 2, 3)"
_K = ", k(tbl, scope, k) AS (SELECT tbl, scope, min(n) FROM (SELECT tbl, scope, signature, count(DISTINCT record) AS n FROM sig GROUP BY 1, 2, 3) GROUP BY 1, 2)"
over("qi_signatures", 'SELECT tbl AS "table", scope, record, signature FROM sig', lambda w: kanon.signatures(w.env.fields, w.quasi), _SIG)
over("k_anonymity", 'SELECT tbl AS "table", scope, k FROM k', lambda w: kanon.k_anonymity(kanon.signatures(w.env.fields, w.quasi, as_text=False)), _SIG + _K)


def k_risk(w: World) -> DataFrame:
    """k of both sets of quasi-identifiers, and whether frameworks with thresholds of 3 and 12 are content."""
    out = None
    for name, columns in (("segment", ("segment",)), ("both", W.QUASI)):
        fields = w.env.fields.where(F.col("name").isin(*columns))
        k = kanon.k_anonymity(kanon.signatures(fields, w.quasi, as_text=False)).withColumn("quasi", F.lit(name))
        out = k if out is None else out.unionByName(k)
    verdict = lambda least: F.when(F.col("k") >= least, "YES").otherwise("NO")
    return out.select("quasi", "table", "scope", "k", verdict(3).alias("lenient"), verdict(12).alias("strict"), F.when(F.col("k") < 3, "high").when(F.col("k") < 12, "medium").otherwise("low").alias("risk"))


_SIG2 = ", sig(quasi, tbl, scope, record, signature) AS (SELECT 'both', tbl, scope, record, string_agg(name || '=' || value, ';' ORDER BY name) FROM cells JOIN avail ON container = tbl GROUP BY 2, 3, 4 UNION ALL SELECT 'segment', tbl, scope, record, 'segment=' || value FROM cells JOIN avail ON container = tbl WHERE name = 'segment')"
over(
    "k_risk_divergence",
    "SELECT quasi, tbl AS \"table\", scope, k, CASE WHEN k >= 3 THEN 'YES' ELSE 'NO' END AS lenient, CASE WHEN k >= 12 THEN 'YES' ELSE 'NO' END AS strict, CASE WHEN k < 3 THEN 'high' WHEN k < 12 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT quasi, tbl, scope, min(n) AS k FROM (SELECT quasi, tbl, scope, signature, count(DISTINCT record) AS n FROM sig GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)",
    k_risk, _SIG2,
)

# --- lookups and reports


def _sparql_triples(w: World) -> DataFrame:
    return w.contains.select(F.col("parent").alias("s"), F.lit("contains").alias("p"), F.col("child").alias("o")).unionByName(w.env.tags.select(F.col("container").alias("s"), F.lit("label").alias("p"), F.col("label").alias("o")))


over("query_by_filter", f"SELECT {KEY} FROM a0 WHERE label = 'Debt' AND scope = 'ALL' AND framework = 'strict'", lambda w: query.query_assertions(w.a0, label="Debt", scope="ALL", framework="strict"))
over("labels_for_container", "SELECT container, scope, framework, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM a0 GROUP BY 1, 2, 3", lambda w: query.labels_for_container(w.a0).withColumn("labels", F.array_join("labels", ",")))
over("compare_frameworks", "SELECT container, scope, label, bool_or(framework = 'base') AS base, bool_or(framework = 'strict') AS strict FROM a0 WHERE framework IN ('base', 'strict') GROUP BY 1, 2, 3", lambda w: query.compare_frameworks(w.a0, ["base", "strict"]))
over("differing_labels", "SELECT container, scope, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM (SELECT container, scope, label FROM a0 WHERE framework IN ('base', 'strict') GROUP BY 1, 2, 3 HAVING count(DISTINCT framework) < 2) GROUP BY 1, 2", lambda w: query.differing_labels(w.a0, ["base", "strict"]).withColumn("labels", F.array_join("labels", ",")))
over("assertions_with_label", "SELECT DISTINCT container FROM a0 WHERE label = 'Trade' AND scope = 'ALL' AND framework IN ('deep', 'strict', 'base')", lambda w: query.with_label(w.a0, "Trade", "ALL", "deep", closure.framework_chain(w.env.frameworks)))
over("containers_in_scope", "SELECT DISTINCT container FROM avail WHERE scope = 'ALL'", lambda w: query.in_scope(w.avail, "ALL"))
over("container_children", "SELECT parent, child FROM contains", lambda w: query.children(w.contains))
over("control_status", f"SELECT DISTINCT {KEY} FROM a0 JOIN facets USING (label) WHERE facet = 'Control'", lambda w: query.in_facet(w.a0, w.env.label_facets, "Control").select(*E.KEY).distinct())
over(
    "union_report", "SELECT 'debt' AS part, container, scope FROM has WHERE label = 'Debt' UNION ALL SELECT 'risk', container, scope FROM has WHERE label = 'Risky' UNION ALL SELECT 'trade', container, scope FROM has WHERE label = 'Trade'",
    lambda w: w.has.where("label = 'Debt'").select(F.lit("debt").alias("part"), "container", "scope").unionByName(w.has.where("label = 'Risky'").select(F.lit("risk").alias("part"), "container", "scope")).unionByName(w.has.where("label = 'Trade'").select(F.lit("trade").alias("part"), "container", "scope")),
)
over("parameter_index", "SELECT container, scope, 'Sized' AS label, 'size' AS param, n::VARCHAR AS value FROM sized", lambda w: query.parameter_index(w.facts))
over(
    "sparql_report", "SELECT s AS parent, count(*)::VARCHAR AS n FROM (SELECT parent AS s, child FROM contains JOIN tags ON tags.container = child AND label = 'Debt') GROUP BY 1 HAVING count(*) > 1",
    lambda w: sparql.query("SELECT ?parent (COUNT(DISTINCT ?c) AS ?n) WHERE { ?parent <contains> ?c . ?c <label> 'Debt' } GROUP BY ?parent HAVING (COUNT(?c) > 1)", _sparql_triples(w)),
)
over(
    "sparql_optional", "SELECT e.child AS c, t.label AS l FROM contains e LEFT JOIN tags t ON t.container = e.child AND t.label = 'Risky'",
    lambda w: sparql.query("SELECT ?c ?l WHERE { ?p <contains> ?c . OPTIONAL { ?c <label> ?l . FILTER(?l = 'Risky') } }", _sparql_triples(w)),
)
over(
    "sparql_not_exists", "SELECT DISTINCT parent AS p FROM contains e WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE t.container = e.parent)",
    lambda w: sparql.query("SELECT DISTINCT ?p WHERE { ?p <contains> ?c . FILTER NOT EXISTS { ?p <label> ?l } }", _sparql_triples(w)),
)
over("counts_by_label", "SELECT label, framework, count(*) AS n, count(DISTINCT container) AS containers FROM a0 GROUP BY 1, 2", lambda w: w.a0.groupBy("label", "framework").agg(F.count("*").alias("n"), F.count_distinct("container").alias("containers")))
over("topk_diff", f"SELECT {KEY} FROM a0 WHERE label = 'Risky' OR label = 'Debt' ORDER BY ALL LIMIT 20", lambda w: query.top_new(w.a0.select(*E.KEY), w.a0.where("label NOT IN ('Risky', 'Debt')").select(*E.KEY)))
over("order_desc", "SELECT container, scope, n FROM sized ORDER BY n DESC, container, scope", lambda w: w.facts.where("label = 'Sized'").select("container", "scope", F.col("params")["size"].cast("long").alias("n")).orderBy(F.desc("n"), "container", "scope"))
over(
    "forest_paths", "SELECT container, depth, path FROM fo",
    lambda w: closure.forest(w.contains, w.env.containers),
    """, named(container, name) AS (SELECT 'R' || r_regionkey, r_name FROM region UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation UNION ALL SELECT 'C' || c_custkey, c_name FROM customer UNION ALL SELECT 'S' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'O' || o_orderkey, 'order ' || o_orderkey FROM orders),
    fo(container, depth, path) AS (SELECT container, 0, name FROM named WHERE container NOT IN (SELECT child FROM contains) UNION SELECT n.container, depth + 1, path || '/' || n.name FROM fo JOIN contains e ON e.parent = fo.container JOIN named n ON n.container = e.child WHERE depth < 10)""",
)
over(
    "triples_export",
    """SELECT concat_ws('|', container, label, scope, framework) AS s, 'assertedOn' AS p, container AS o FROM a0 UNION SELECT concat_ws('|', container, label, scope, framework), 'assertsLabel', label FROM a0
    UNION SELECT concat_ws('|', container, label, scope, framework), 'assertedInScope', scope FROM a0 UNION SELECT concat_ws('|', container, label, scope, framework), 'assertedByFramework', framework FROM a0
    UNION SELECT parent, 'contains', child FROM contains UNION SELECT a, 'joinableWith', b FROM joinable UNION SELECT container, 'availableInScope', scope FROM avail""",
    lambda w: query.triples(w.a0, w.contains, w.joinable, w.avail),
)

# --- typed rules: labels of the rule's own framework and those that it extends

def _chain_has(w: World) -> DataFrame:
    """(container, label, scope, framework): under the framework or one that it extends."""
    chain = closure.framework_chain(w.env.frameworks)
    return w.a0.withColumnRenamed("framework", "ancestor").join(F.broadcast(chain), "ancestor").select(*E.KEY).distinct()


_CHAINS = f", f(framework, extends, s, t) AS (VALUES {values(W.FRAMEWORKS)}), c(framework, ancestor) AS (SELECT framework, framework FROM f UNION SELECT c.framework, f.extends FROM c JOIN f ON f.framework = c.ancestor WHERE f.extends IS NOT NULL)"
over(
    "typed_subclass", "SELECT DISTINCT a.container, s.target AS label, a.scope, s.framework FROM srules s JOIN c ON c.framework = s.framework JOIN a0 a ON a.framework = c.ancestor AND a.label = s.source",
    lambda w: _chain_has(w).join(w.table(_SUB, "framework string, source string, target string, rule string"), "framework").where("label = source").select("container", F.col("target").alias("label"), "scope", "framework").distinct(), _SUBS + _CHAINS,
)
over(
    "typed_equivalence", "SELECT a.container, 'DebtBuilder' AS label, a.scope, c.framework FROM c JOIN a0 a ON a.framework = c.ancestor WHERE c.framework = 'strict' AND a.label IN ('Debt', 'Seg_BUILDING') GROUP BY 1, 3, 4 HAVING count(DISTINCT a.label) = 2",
    lambda w: R.implication_all(_chain_has(w).where("framework = 'strict'").drop("framework"), w.table(_ALL[:1], "framework string, rule string, sources array<string>, target string")).select(*E.KEY), _CHAINS,
)
over(
    "typed_implication", "SELECT DISTINCT a.container, 'TradeDebt' AS label, a.scope, 'strict' AS framework FROM c JOIN a0 a ON a.framework = c.ancestor WHERE c.framework = 'strict' AND a.label = 'Trade' AND EXISTS (SELECT 1 FROM a0 g JOIN contains e ON e.child = g.container JOIN c d ON d.ancestor = g.framework WHERE d.framework = 'strict' AND e.parent = a.container AND g.scope = a.scope AND g.label = 'Debt')",
    lambda w: _typed_implication(w), _CHAINS,
)


def _typed_implication(w: World) -> DataFrame:
    has = _chain_has(w).where("framework = 'strict'").select("container", "label", "scope")
    holds = conditions.Evaluator(has, w.avail, w.contains, lambda: w.ancestors, w.joinable)(E.Related("Debt", "Child")).withColumn("condition", F.lit(0))
    return R.implication(has, w.table([("strict", "c1", "Trade", "TradeDebt", 0)], "framework string, rule string, source string, target string, condition int"), holds).select(*E.KEY).distinct()


over("typed_containment", "SELECT DISTINCT a.ancestor AS container, label, scope FROM a0 JOIN anc a ON a.descendant = container JOIN avail v ON v.container = a.ancestor AND v.scope = a0.scope WHERE label = 'Risky'".replace(" label, scope FROM", " label, a0.scope FROM"), lambda w: w.a0.where("label = 'Risky'").join(w.ancestors.withColumnRenamed("descendant", "container"), "container").select(F.col("ancestor").alias("container"), "label", "scope").distinct().join(w.avail, ["container", "scope"], "left_semi"))

# --- built-ins and functions

_PAGES = "SELECT page_id, url, coalesce(url, '') AS u FROM pages"


def pages(w: World) -> DataFrame:
    return W.read(w.spark, w.dir, "pages").select("page_id", "url")


register("fn_encode_uri", "SELECT page_id, url_encode(url) AS x FROM pages", lambda w: pages(w).select("page_id", text.encode_uri(F.col("url")).alias("x")))
register("fn_md5", "SELECT page_id, 'urn:containment:' || md5(url || ':' || page_id) AS x FROM pages", lambda w: pages(w).select("page_id", F.concat(F.lit("urn:containment:"), F.md5(F.concat("url", F.lit(":"), F.col("page_id").cast("string")))).alias("x")))
register("fn_strafter", "SELECT page_id, CASE WHEN instr(url, '#') > 0 THEN substr(url, instr(url, '#') + 1) ELSE '' END AS x FROM pages", lambda w: pages(w).select("page_id", text.str_after(F.col("url"), "#").alias("x")))
register("fn_fragment", "SELECT page_id, CASE WHEN instr(url, '#') > 0 THEN regexp_extract(url, '[^#]*$') ELSE regexp_extract(url, '[^/]*$') END AS x FROM pages", lambda w: pages(w).select("page_id", text.fragment(F.col("url")).alias("x")))
register("fn_signature", "SELECT doc_id, substr(sha256(array_to_string(list_sort([lang, source]), ';')), 1, 16) AS x FROM documents", lambda w: W.read(w.spark, w.dir, "documents").select("doc_id", text.content_signature(F.array("lang", "source")).alias("x")))
register("fn_literal_kind", "SELECT page_id, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:[^\\s]*$') THEN 'iri' ELSE 'string' END AS kind, 'integer' AS id_kind FROM pages", lambda w: pages(w).select("page_id", text.literal_kind(F.col("url")).alias("kind"), text.literal_kind(F.col("page_id").cast("string")).alias("id_kind")))


def part(w: World) -> DataFrame:
    return W.read(w.spark, w.dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("a"), F.col("p_partkey").cast("string").alias("b"), "p_name", "p_brand", "p_type")


_P = "(SELECT p_partkey, p_size AS a, p_partkey AS b, p_name, p_brand, p_type FROM part)"
B = builtins
register("builtin_compare", f"SELECT p_partkey, a > 25 AS gt, a < 25 AS lt, a <= 25 AS le, a >= 25 AS ge, a = 25 AS eq, a <> 25 AS ne FROM {_P}", lambda w: part(w).select("p_partkey", *(B.FILTERS[op](F.col("a"), F.lit("25")).alias(n) for op, n in (("greaterThan", "gt"), ("lessThan", "lt"), ("le", "le"), ("ge", "ge"), ("equal", "eq"), ("notEqual", "ne")))))
register("builtin_regex", f"SELECT p_partkey, regexp_matches(p_type, '^[A-Z]+ .*E') AS x FROM {_P}", lambda w: part(w).select("p_partkey", B.FILTERS["regex"](F.col("p_type"), F.lit("^[A-Z]+ .*E")).alias("x")))
register("builtin_concat", f"SELECT p_partkey, p_brand || '/' || p_type AS x FROM {_P}", lambda w: part(w).select("p_partkey", B.VALUES["strConcat"](F.col("p_brand"), F.lit("/"), F.col("p_type")).alias("x")))
register("builtin_uri", f"SELECT p_partkey, 'urn:part:' || b AS x FROM {_P}", lambda w: part(w).select("p_partkey", B.VALUES["uriConcat"](F.lit("urn:part:"), F.col("b")).alias("x")))
register("builtin_math", f"SELECT p_partkey, (a + b)::VARCHAR AS s, (a - b)::VARCHAR AS d, (a * b)::VARCHAR AS p, (a * b / a)::BIGINT::VARCHAR AS q FROM {_P}", lambda w: part(w).select("p_partkey", *(B.VALUES[op](F.col("a"), F.col("b")).alias(n) for op, n in (("sum", "s"), ("difference", "d"), ("product", "p"))), B.VALUES["quotient"](B.VALUES["product"](F.col("a"), F.col("b")), F.col("a")).alias("q")))
register("builtin_skolem", f"SELECT p_partkey, 'urn:skolem:' || url_encode(p_brand) || '_' || url_encode(p_type) AS x FROM {_P}", lambda w: part(w).select("p_partkey", B.VALUES["makeSkolem"](F.col("p_brand"), F.col("p_type")).alias("x")))
over(
    "node_names", "SELECT container, label, scope, framework, 'urn:skolem:' || url_encode(container) || '_' || url_encode(label) || '_' || url_encode(framework) || '_' || url_encode(scope) || '_assertion' AS node, 'urn:containment:' || md5(concat_ws(':', container, label, scope, framework)) AS inside FROM a0",
    lambda w: w.a0.withColumn("node", text.node_iri(*map(F.col, ("container", "label", "framework", "scope")))).withColumn("inside", text.containment_iri(*map(F.col, E.KEY))),
)
_RULE_TEXT = """
# availability goes down; symmetric joins; grandchildren
[down: (?p availableInScope ?g) (?p contains ?c) noValue(?c availableInScope ?g) -> (?c availableInScope ?g)]
[sym: (?x joinableWith ?y) -> (?y joinableWith ?x)]
"""


def _rule_triples(w: World) -> DataFrame:
    edge = lambda df, a, p, b: df.select(F.col(a).alias("s"), F.lit(p).alias("p"), F.col(b).alias("o"), F.lit("iri").alias("kind"))
    return edge(w.contains, "parent", "contains", "child").unionByName(edge(w.env.availability, "container", "availableInScope", "scope")).unionByName(edge(w.env.joinable, "a", "joinableWith", "b"))


over("rule_text_fixpoint", "SELECT container AS s, 'availableInScope' AS p, scope AS o FROM avail UNION ALL SELECT a, 'joinableWith', b FROM joinable UNION ALL SELECT parent, 'contains', child FROM contains", lambda w: ruletext.run_rules(ruletext.parse_rules(_RULE_TEXT), _rule_triples(w))[0].select("s", "p", "o"))


from labelweave import queries_more  # noqa: E402, F401  (registers the rest)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
