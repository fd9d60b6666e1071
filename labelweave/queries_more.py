"""Queries for SPARQL texts, rule texts, provenance, inputs and renderings, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelweave import env as E
from labelweave.functions import builtins as B
from labelweave.operators import closure, conditions, kanon, lists, query
from labelweave.plans import engine, ruletext, sparql
from labelweave.queries import _CHAIN, _UPS, KEY, _sparql_triples, over, part, pages, register, values
from labelweave.sources import inputs, turtle
from labelweave.sources import warehouse as W

#: The triples of _sparql_triples as SQL.
TRIPLES = "(SELECT parent AS s, 'contains' AS p, child AS o FROM contains UNION ALL SELECT container, 'label', label FROM tags) t"


def ask(name: str, sql: str, text: str, more: str = "") -> None:
    """A SPARQL text over the containment edges and the tags."""
    over(name, sql, lambda w: sparql.query(text, _sparql_triples(w)), more)


ask(
    "sparql_construct", "SELECT DISTINCT child AS s, 'owedIn' AS p, parent AS o FROM contains JOIN tags ON container = child WHERE label = 'Debt'",
    "CONSTRUCT { ?c <owedIn> ?p } WHERE { ?p <contains> ?c . ?c <label> 'Debt' }",
)
ask(
    "sparql_ask", "SELECT EXISTS (SELECT 1 FROM contains JOIN tags ON container = child WHERE label = 'Debt' AND starts_with(parent, 'N')) AS result",
    "ASK { ?p <contains> ?c . ?c <label> 'Debt' FILTER(STRSTARTS(?p, 'N')) }",
)
ask(
    "sparql_describe", f"SELECT DISTINCT s, p, o FROM {TRIPLES} WHERE s = 'R0' OR s IN (SELECT child FROM contains JOIN tags ON container = child WHERE label = 'Debt')",
    "DESCRIBE <R0> ?c WHERE { ?p <contains> ?c . ?c <label> 'Debt' }",
)
ask(
    "sparql_bind", "SELECT child AS c, parent || '/' || lower(child) AS x, length(child)::VARCHAR AS n FROM contains",
    "SELECT ?c ?x ?n WHERE { ?p <contains> ?c . BIND(CONCAT(STR(?p), '/', LCASE(?c)) AS ?x) BIND(STRLEN(?c) AS ?n) }",
)
ask(
    "sparql_boolean", "SELECT child AS c, label AS l FROM contains JOIN tags ON container = child WHERE label = 'Risky' OR (label <> 'Debt' AND NOT starts_with(parent, 'N'))",
    "SELECT ?c ?l WHERE { ?p <contains> ?c . ?c <label> ?l . FILTER(?l = 'Risky' || (?l != 'Debt' && !STRSTARTS(?p, 'N'))) }",
)
ask(
    "sparql_variable_predicate", f"SELECT DISTINCT t.s, t.p, t.o FROM {TRIPLES} JOIN tags d ON d.container = t.s AND d.label = 'Trade'",
    "SELECT DISTINCT ?s ?p ?o WHERE { ?s <label> 'Trade' . ?s ?p ?o }",
)
ask(
    "sparql_exists", "SELECT DISTINCT parent AS p FROM contains e WHERE EXISTS (SELECT 1 FROM tags t WHERE t.container = e.child AND label = 'Debt')",
    "SELECT DISTINCT ?p WHERE { ?p <contains> ?c . FILTER EXISTS { ?c <label> 'Debt' } }",
)
ask(
    "sparql_minus", "SELECT child AS c FROM contains WHERE child NOT IN (SELECT container FROM tags)",
    "SELECT ?c WHERE { ?p <contains> ?c . MINUS { ?c <label> ?l } }",
)
ask(
    "sparql_subselect", "SELECT e.parent AS p, e.child AS c, n::VARCHAR AS n FROM contains e LEFT JOIN (SELECT container, count(*) AS n FROM contains JOIN tags ON tags.container = contains.parent GROUP BY 1) x ON x.container = e.child",
    "SELECT ?p ?c ?n WHERE { ?p <contains> ?c . OPTIONAL { SELECT ?c (COUNT(?x) AS ?n) WHERE { ?c <contains> ?x . ?c <label> ?l } GROUP BY ?c } }",
)
ask(
    "sparql_union", "SELECT child AS x, 'below' AS how FROM contains UNION ALL SELECT container, label FROM tags WHERE label IN ('Debt', 'Trade')",
    "SELECT ?x ?how WHERE { { ?p <contains> ?x . BIND('below' AS ?how) } UNION { ?x <label> ?how . FILTER(?how IN ('Debt', 'Trade')) } }",
)
ask(
    "sparql_values", "SELECT l, k, count(*)::VARCHAR AS n FROM tags, (VALUES ('one'), ('two')) v(k), (VALUES ('Debt'), ('Risky')) u(l) WHERE label = l GROUP BY 1, 2",
    "SELECT ?l ?k (COUNT(?c) AS ?n) WHERE { VALUES ?l { 'Debt' 'Risky' } VALUES ?k { 'one' 'two' } ?c <label> ?l } GROUP BY ?l ?k",
)
ask("sparql_path", "SELECT ancestor AS a, descendant AS d FROM anc", "SELECT ?a ?d WHERE { ?a <contains>+ ?d }")
ask(
    "sparql_if_coalesce", "SELECT child AS c, CASE WHEN label = 'Risky' THEN 'bad' ELSE coalesce(label, 'none') END AS l FROM contains LEFT JOIN tags ON container = child",
    "SELECT ?c ?l WHERE { ?p <contains> ?c . OPTIONAL { ?c <label> ?x } BIND(IF(BOUND(?x) && ?x = 'Risky', 'bad', COALESCE(?x, 'none')) AS ?l) }",
)
over(
    "sparql_update", f"SELECT s, p, o FROM {TRIPLES} WHERE NOT (p = 'label' AND o = 'Debt') UNION SELECT container, 'owes', 'yes' FROM tags WHERE label = 'Debt'",
    lambda w: sparql.update("DELETE { ?c <label> 'Debt' } INSERT { ?c <owes> 'yes' } WHERE { ?c <label> 'Debt' }", _sparql_triples(w)),
)
over(
    "sparql_saturate", f"SELECT s, p, o FROM {TRIPLES} UNION SELECT ancestor, 'holds', descendant FROM anc",
    lambda w: sparql.saturate(
        ["CONSTRUCT { ?a <holds> ?b } WHERE { ?a <contains> ?b }", "CONSTRUCT { ?a <holds> ?c } WHERE { ?a <holds> ?b . ?b <contains> ?c }"], _sparql_triples(w),
    )[0],
)
over(
    "rule_text_connected", "SELECT DISTINCT e.parent AS s, 'debtors' AS p, t.label AS o FROM contains e JOIN tags t ON t.container = e.child JOIN tags u ON u.container = e.parent WHERE u.label = 'Trade' AND t.label <> 'Debt'",
    # the first two patterns share no variable; the third connects them
    lambda w: ruletext.apply_rule(ruletext.parse_rules("[r: (?x label ?l) (?p label \"Trade\") (?p contains ?x) notEqual(?l, \"Debt\") -> (?p debtors ?l)]")[0], _sparql_triples(w).withColumn("kind", F.lit("iri"))).select("s", "p", "o"),
)
over(
    "assertion_exists", "SELECT l AS label, EXISTS (SELECT 1 FROM a0 WHERE a0.label = l AND scope = 'ALL') AS found FROM (VALUES ('Debt'), ('Trade'), ('Risky'), ('Nothing')) v(l)",
    lambda w: w.table([("Debt",), ("Trade",), ("Risky",), ("Nothing",)], "label string").join(query.query_assertions(w.a0, scope="ALL").select("label", F.lit(True).alias("x")).distinct(), "label", "left").select("label", F.coalesce("x", F.lit(False)).alias("found")),
)


def _linear_env(w) -> E.Env:
    return E.Env(w.spark, w.env.tables, E.Rules(propagations=(E.Propagation("strict", "Outward", "Debt", None),)))


over(
    "provenance",
    """SELECT container, scope, via, source FROM ground UNION ALL SELECT * FROM first
    UNION ALL SELECT s.* FROM second s ANTI JOIN (SELECT container, scope FROM ground UNION SELECT container, scope FROM first) k USING (container, scope)""",
    lambda w: engine.infer(_linear_env(w), with_k=False).assertions.where("label = 'Debt' AND framework = 'strict'").select("container", "scope", F.when(F.col("is_ground"), "Ground").otherwise(F.col("derived_via")).alias("via"), F.col("derived_from").alias("source")),
    # debts, then their parents, then those parents' parents: each a table of its own
    """, seen AS MATERIALIZED (SELECT DISTINCT container, scope FROM avail), up AS MATERIALIZED (SELECT DISTINCT parent, child FROM contains WHERE parent[1] IN ('R', 'N')),
    ground AS MATERIALIZED (SELECT DISTINCT container, scope, 'Ground' AS via, NULL::VARCHAR AS source FROM a0 WHERE label = 'Debt' AND framework = 'strict'),
    first AS MATERIALIZED (SELECT up.parent AS container, g.scope, 'Outward' AS via, min(g.container) AS source FROM ground g JOIN up ON up.child = g.container JOIN seen v ON v.container = up.parent AND v.scope = g.scope GROUP BY 1, 2),
    second AS MATERIALIZED (SELECT up.parent AS container, f.scope, 'Outward' AS via, min(f.container) AS source FROM first f JOIN up ON up.child = f.container JOIN seen v ON v.container = up.parent AND v.scope = f.scope GROUP BY 1, 2)""",
)
_STEPS = """, seen AS MATERIALIZED (SELECT DISTINCT container, scope FROM avail), up AS MATERIALIZED (SELECT DISTINCT parent, child FROM contains WHERE parent[1] IN ('R', 'N')),
    ground AS MATERIALIZED (SELECT DISTINCT container, scope FROM a0 WHERE label = 'Debt' AND framework = 'strict'),
    first AS MATERIALIZED (SELECT up.parent AS container, g.scope, min(g.container) AS source FROM ground g JOIN up ON up.child = g.container JOIN seen v ON v.container = up.parent AND v.scope = g.scope GROUP BY 1, 2),
    second AS MATERIALIZED (SELECT up.parent AS container, f.scope, min(f.container) AS source FROM first f JOIN up ON up.child = f.container JOIN seen v ON v.container = up.parent AND v.scope = f.scope GROUP BY 1, 2),
    used AS MATERIALIZED (SELECT DISTINCT f.* FROM first f JOIN second s ON s.source = f.container AND s.scope = f.scope)"""
over(
    "proof_steps",
    """SELECT container, scope, 'Outward' AS rule, 2::INTEGER AS round, source AS of_container, 1::INTEGER AS of_round FROM second
    UNION ALL SELECT container, scope, 'Outward', 1, source, 0 FROM used UNION ALL SELECT DISTINCT source, scope, 'Tag', 0, NULL::VARCHAR, -1 FROM used""",
    lambda w: _proof_of_debts(w), _STEPS,
)
over(
    "proof_of_conditions",
    """SELECT container, 'TradeDebt' AS label, scope, 'base' AS framework, 'cond' AS rule, 0::INTEGER AS part, child AS of_container, 'Debt' AS of_label, 'stat_sub' AS of_framework FROM held
    UNION ALL SELECT container, 'TradeDebt', scope, 'base', 'cond', 1, container, 'Trade', 'base' FROM held
    UNION ALL SELECT DISTINCT child, 'Debt', scope, 'stat_sub', 'Tag', -1, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM held
    UNION ALL SELECT container, 'Trade', scope, 'base', 'Tag', -1, NULL, NULL, NULL FROM held""",
    lambda w: _proof_of_conditions(w),
    """, owed AS MATERIALIZED (SELECT container, scope FROM a0 WHERE label = 'Debt' AND framework = 'stat_sub'),
    held AS MATERIALIZED (SELECT h.container, h.scope, min(e.child) AS child FROM a0 h JOIN contains e ON e.parent = h.container JOIN owed d ON d.container = e.child AND d.scope = h.scope
      WHERE h.label = 'Trade' AND h.framework = 'base' GROUP BY 1, 2)""",
)


def _proof_of_debts(w) -> DataFrame:
    """How the regions' debts follow from those of customers."""
    result = engine.infer(_linear_env(w), with_k=False)
    asked = result.assertions.where("label = 'Debt' AND framework = 'strict'").join(w.env.containers.where("kind = 'database'").select("container"), "container", "left_semi")
    return result.proofs(asked).select("container", "scope", "rule", "round", "of_container", F.coalesce("of_round", F.lit(-1)).alias("of_round"))


def _proof_of_conditions(w) -> DataFrame:
    """What each nation's indebted trade rests on: its trade, and a customer in debt."""
    rules = E.Rules(propagations=(E.Propagation("base", "Inward", "Trade"),), implications=(E.Implication("base", ("Trade",), ("TradeDebt",), (E.Related("Debt", "Child"),), False, "cond"),))
    single = w.env.frameworks.withColumn("sub_framework_of", F.lit(None).cast("string"))
    result = engine.infer(w.env.with_rules(rules).with_tables(frameworks=single), with_k=False, inherit=())
    return result.proofs(result.assertions.where("label = 'TradeDebt'")).select(*E.KEY, "rule", F.coalesce("part", F.lit(-1)).alias("part"), "of_container", "of_label", "of_framework")


# --- frameworks that see and inherit, and the lowest level

_SEEN = [("base", "Seg_BUILDING", "Segmented"), ("strict", "Segmented", "Sensitive"), ("base", "Sensitive", "Reviewed"), ("deep", "Sensitive", "Filed"), ("stat", "Debt", "Watch"), ("strict", "Debt", "Financial"), ("base", "Debt", "Owing")]
over(
    "visibility_chain", f"SELECT {KEY} FROM x", lambda w: _by_chain(w),
    f"""{_CHAIN}, own(framework, ancestor) AS MATERIALIZED (SELECT DISTINCT framework, ancestor FROM c), r(framework, source, target) AS (VALUES {values(_SEEN)}),
    x({KEY}) AS (SELECT * FROM a0 UNION SELECT x.container, r.target, x.scope, r.framework FROM x JOIN r ON r.source = x.label JOIN own ON own.framework = r.framework AND own.ancestor = x.framework)""",
)
over(
    "inherited_overrides",
    f"""SELECT DISTINCT h.container, r.target AS label, h.scope, r.framework FROM has h JOIN (VALUES
      ('base', 'Trade', 'Open'), ('deep', 'Risky', 'Watch'), ('base', 'Risky', 'Watch'), ('strict', 'Risky', 'Watch'), ('base', 'Debt', 'Owing'), ('strict', 'Debt', 'Owing')) r(framework, source, target) ON r.source = h.label
    UNION ALL SELECT {KEY} FROM a0""",
    lambda w: _overridden(w),
)
over(
    "returned_lines", "SELECT container, 'Returned' AS label, scope, 'strict' AS framework FROM (SELECT container, scope FROM line UNION SELECT container, scope FROM x)",
    lambda w: engine.infer(W.environment(w.spark, w.dir, lines=True).with_rules(E.Rules(propagations=(E.Propagation("strict", "Outward", "Returned"),))), with_k=False).assertions.where("label = 'Returned'").select(*E.KEY),
    """, line(container, scope, held_in) AS MATERIALIZED (SELECT DISTINCT 'L' || l_orderkey || '-' || l_linenumber, v.scope, v.container FROM lineitem JOIN avail v ON v.container = 'O' || l_orderkey WHERE l_returnflag = 'R'),
    x(container, scope) AS (SELECT held_in, scope FROM line UNION SELECT e.parent, x.scope FROM x JOIN contains e ON e.child = x.container JOIN avail v ON v.container = e.parent AND v.scope = x.scope)""",
)


def _by_chain(w) -> DataFrame:
    """Rules that see the labels of their own framework and of those that it extends."""
    env = w.env.with_rules(E.Rules(subclasses=tuple(E.Subclass(f, (s,), t) for f, s, t in _SEEN)))
    env = env.with_tables(frameworks=env.frameworks.withColumn("sub_framework_of", F.lit(None).cast("string")))
    return engine.infer(env, with_k=False, inherit=(), visibility="chain").assertions.where("label NOT IN ('Available', 'Quasi')").select(*E.KEY)


def _overridden(w) -> DataFrame:
    """deep extends strict, strict extends base: strict does without d1 (and so does deep), deep without d2."""
    decls = (E.Subclass("base", ("Trade",), "Open", "d1"), E.Subclass("base", ("Debt",), "Owing", "d2"), E.Subclass("base", ("Risky",), "Watch", "d3"))
    env = w.env.with_rules(E.Rules(subclasses=decls, overrides=(E.Override("strict", "d1"), E.Override("deep", "d2"))))
    env = env.with_tables(frameworks=env.frameworks.withColumn("sub_framework_of", F.lit(None).cast("string")))
    return engine.infer(env, with_k=False).assertions.where("label NOT IN ('Available', 'Quasi')").select(*E.KEY)


over(
    "facts_by_rule", "SELECT derived_via, facts FROM (SELECT 'Tag' AS derived_via, count(*) AS facts FROM (SELECT DISTINCT container, label, scope, framework FROM a0) UNION ALL SELECT 'Availability', count(*) FROM avail UNION ALL SELECT 'FieldDeclaration', count(*) FROM (SELECT DISTINCT record || '.' || name, scope FROM cells JOIN avail ON container = tbl))",
    lambda w: engine.infer(E.Env(w.spark, w.env.tables, E.Rules()), with_k=False).metrics_table().where("derived_via IN ('Tag', 'Availability', 'FieldDeclaration')").groupBy("derived_via").agg(F.sum("facts").alias("facts")),
)

over(
    "construct_in_rounds",
    # debts make their holder's nation Watched; Watched goes down to its customers by an ordinary rule
    "SELECT container, scope FROM (SELECT e.parent AS container, a.scope FROM a0 a JOIN contains e ON e.child = a.container WHERE label = 'Debt' AND framework = 'strict' UNION SELECT d.child, a.scope FROM a0 a JOIN contains e ON e.child = a.container JOIN contains d ON d.parent = e.parent WHERE label = 'Debt' AND framework = 'strict'"
    " UNION SELECT o.child, a.scope FROM a0 a JOIN contains e ON e.child = a.container JOIN contains d ON d.parent = e.parent JOIN contains o ON o.parent = d.child WHERE label = 'Debt' AND framework = 'strict') x WHERE EXISTS (SELECT 1 FROM avail v WHERE v.container = x.container AND v.scope = x.scope) OR starts_with(container, 'N')",
    lambda w: _watched(w),
)


def _watched(w) -> DataFrame:
    env = E.Env(w.spark, w.env.tables, E.Rules(propagations=(E.Propagation("base", "Inward", "Watched", None),)))
    text = """CONSTRUCT { ?n <assertedOn> ?p . ?n <assertsLabel> 'Watched' . ?n <assertedInScope> ?g . ?n <assertedByFramework> 'base' }
              WHERE { ?a <assertsLabel> 'Debt' . ?a <assertedByFramework> 'strict' . ?a <assertedOn> ?c . ?a <assertedInScope> ?g . ?p <contains> ?c . BIND(CONCAT('w', ?p, ?g) AS ?n) }"""
    found = engine.infer(env, with_k=False, extra=tuple(sparql.in_rounds(env, [text]))).assertions
    return found.where("label = 'Watched'").select("container", "scope")


#: A user takes debts of the building segment back; nations and regions keep a debt only for others inside them.
TAKEN_BACK = """DELETE { ?n <assertsLabel> 'Debt' } WHERE { ?n <assertsLabel> 'Debt' . ?n <assertedOn> ?c . ?m <assertedOn> ?c . ?m <assertsLabel> 'Seg_BUILDING' }"""
over(
    "delete_in_rounds", "SELECT DISTINCT container, scope, framework FROM x WHERE label = 'Debt'",
    lambda w: _taken_back(w).select("container", "scope", "framework"),
    f"""{_UPS}, kept({KEY}) AS (SELECT * FROM a0 WHERE NOT (label = 'Debt' AND container IN (SELECT container FROM a0 WHERE label = 'Seg_BUILDING'))),
    all_kept({KEY}) AS (SELECT * FROM kept UNION SELECT container, label, scope, up FROM kept JOIN ups USING (framework)),
    x({KEY}) AS (SELECT * FROM all_kept UNION SELECT e.parent, x.label, x.scope, x.framework FROM x JOIN contains e ON e.child = x.container JOIN avail v ON v.container = e.parent AND v.scope = x.scope
      WHERE x.label = 'Debt' AND x.framework = 'strict')""",
)


def _taken_back(w) -> DataFrame:
    env = _linear_env(w)
    return engine.infer(env, with_k=False, retracts=tuple(sparql.retracts(env, [TAKEN_BACK]))).assertions.where("label = 'Debt'")


_LOOKS = (E.Related("Debt", "Child"), E.Related("Trade", "Parent"))
_ASKING = E.Rules(implications=(E.Implication("base", ("Trade",), ("TradeDebt",), _LOOKS[:1], False, "down"), E.Implication("strict", ("Debt",), ("DebtTrade",), _LOOKS[1:], False, "up")))
over(
    "condition_demand",
    """SELECT * FROM (SELECT 'everywhere' AS what, 0 AS condition, parent AS container, scope FROM has JOIN contains ON child = container WHERE label = 'Debt'
    UNION SELECT 'everywhere', 1, child, scope FROM has JOIN contains ON parent = container WHERE label = 'Trade'
    UNION SELECT 'asked', CASE label WHEN 'Trade' THEN 0 ELSE 1 END, container, scope FROM has WHERE label IN ('Trade', 'Debt')
    UNION SELECT 'holds', 0, t.container, t.scope FROM has t JOIN contains e ON e.parent = t.container JOIN has d ON d.container = e.child AND d.scope = t.scope AND d.label = 'Debt' WHERE t.label = 'Trade'
    UNION SELECT 'holds', 1, d.container, d.scope FROM has d JOIN contains e ON e.child = d.container JOIN has t ON t.container = e.parent AND t.scope = d.scope AND t.label = 'Trade' WHERE d.label = 'Debt')""",
    lambda w: _demand(w),
)


def _demand(w) -> DataFrame:
    """Where conditions were asked at and found to hold by the engine, beside where they hold at all."""
    found = engine.infer(E.Env(w.spark, w.env.tables, _ASKING), with_k=False, inherit=(), keep_conditions=True)
    everywhere = conditions.Batch(list(_LOOKS)).evaluate(found.assertions, found.available, w.contains, None, w.joinable)
    one = lambda what, df: df.select(F.lit(what).alias("what"), "condition", "container", "scope")
    return one("everywhere", everywhere).unionByName(one("asked", found.marks)).unionByName(one("holds", found.holds))


# --- collections: the orders of each customer, and the customers of each nation, in order of their keys


def _chained(w) -> DataFrame:
    """rest- and first-triples; a cell is named by its list and the item."""
    held = W.read(w.spark, w.dir, "customer").select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("list"), F.col("c_custkey").alias("k"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("item"))
    held = held.unionByName(W.read(w.spark, w.dir, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("list"), F.col("o_orderkey").alias("k"), F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("item")))
    after = F.lead("item").over(Window.partitionBy("list").orderBy("k"))
    cell = lambda x: F.concat("list", F.lit("/"), x)
    rows = held.select("list", "item", "k", after.alias("next"), F.row_number().over(Window.partitionBy("list").orderBy("k")).alias("n"))
    triple = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    rest = triple(cell(F.col("item")), "rest", F.coalesce(cell(F.col("next")), F.lit("nil")))
    head = F.when(F.col("n") == 1, triple(F.col("list"), "members", cell(F.col("item"))))
    return rows.select(F.inline(F.filter(F.array(rest, triple(cell(F.col("item")), "first", F.col("item")), head), lambda x: x.isNotNull())))


_HELD = "(SELECT 'N' || c_nationkey AS list, c_custkey AS k, 'C' || c_custkey AS item FROM customer UNION ALL SELECT 'C' || o_custkey, o_orderkey, 'O' || o_orderkey FROM orders)"
register(
    "rdf_lists", f"SELECT first_value(list || '/' || item) OVER w AS list, row_number() OVER w - 1 AS position, item FROM {_HELD} WINDOW w AS (PARTITION BY list ORDER BY k)",
    lambda w: lists.items(_chained(w)),
)
over(
    "rule_text_lists", "SELECT DISTINCT parent AS s, 'hasDebtor' AS p, container AS o FROM contains JOIN tags ON container = child WHERE label = 'Debt'",
    lambda w: ruletext.apply_rule(
        ruletext.parse_rules("[r: (?c label \"Debt\") (?n contains ?c) (?n members ?l) listContains(?l, ?c) -> (?n hasDebtor ?c)]")[0],
        _sparql_triples(w).unionByName(_chained(w)).withColumn("kind", F.lit("iri")),
    ).select("s", "p", "o"),
)


# --- inputs

_PART = "(SELECT 'part/' || p_partkey AS record, unnest(['p_name', 'p_brand', 'p_size']) AS name, unnest([p_name, p_brand, p_size::VARCHAR]) AS value FROM part)"


def _wide(w) -> DataFrame:
    return W.read(w.spark, w.dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")


register("fields_of_table", f"SELECT record || '/' || name AS field, record, 'part' AS \"table\", name, value FROM {_PART} WHERE value IS NOT NULL", lambda w: inputs.from_table(_wide(w), "part", "p_partkey")["fields"].drop("datatype"))
register(
    "name_evidence", "SELECT container, label FROM (SELECT 'S' || s_suppkey AS container, lower(s_name) AS n FROM supplier UNION ALL SELECT c || '', lower(c) FROM (VALUES ('PatientName'), ('zip_code'), ('Age'), ('HomeAddress')) v(c)) CROSS JOIN (VALUES ('patient', 'Individual', false), ('patient', 'Healthcare', false), ('zip', 'ZipCode', false), ('address', 'StreetAddress', false), ('age', 'Age', true), ('email', 'EmailAddress', false), ('phone', 'TelephoneNumber', false)) h(part, label, whole) WHERE CASE WHEN whole THEN n = part ELSE contains(n, part) END",
    lambda w: inputs.name_evidence(W.read(w.spark, w.dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("container"), F.col("s_name").alias("name")).unionByName(w.table([(x, x) for x in ("PatientName", "zip_code", "Age", "HomeAddress")], "container string, name string"))),
)
register(
    "scaled_records", "SELECT 'nation' AS \"table\", 200 AS records, (SELECT count(DISTINCT n_regionkey) FROM nation) AS regions, (SELECT count(DISTINCT n_name) FROM nation) AS most_names, 0 AS strangers",
    lambda w: _scaled(w),
)


def _scaled(w) -> DataFrame:
    """Scaled to 200 records: how many there are, and that no value is new."""
    fields = inputs.from_table(W.read(w.spark, w.dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "nation", "n_nationkey")["fields"]
    more = inputs.scale_records(fields, 200)
    held = more.join(fields.select("name", "value").distinct(), ["name", "value"], "left_anti")
    out = more.groupBy("table").agg(F.count_distinct("record").cast("int").alias("records"), F.count_distinct(F.when(F.col("name") == "n_regionkey", F.col("value"))).alias("regions"), F.count_distinct(F.when(F.col("name") == "n_name", F.col("value"))).alias("most_names"))
    return out.crossJoin(held.agg(F.count("*").cast("int").alias("strangers")))  # one row each


register(
    "turtle_terms",
    """SELECT s, p, o, kind, datatype, lang FROM (SELECT 'http://x/p' || p_partkey AS s, unnest([
      {'p': 'http://x/size', 'o': p_size::VARCHAR, 'kind': 'literal', 'datatype': 'http://www.w3.org/2001/XMLSchema#integer', 'lang': NULL},
      {'p': 'http://x/name', 'o': p_name, 'kind': 'literal', 'datatype': 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString', 'lang': 'en'},
      {'p': 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'o': 'http://x/Part', 'kind': 'iri', 'datatype': NULL, 'lang': NULL}], recursive := true) FROM part)""",
    lambda w: _part_turtle(w),
)


def _part_turtle(w) -> DataFrame:
    """A Turtle text for each part, read back as terms."""
    text = F.format_string('@prefix x: <http://x/> . x:p%s x:size %s ; x:name "%s"@en ; a x:Part .', F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.col("p_name"))
    return turtle.read_texts(W.read(w.spark, w.dir, "part").select(text.alias("text")))


# --- built-ins whose answers vary

register("builtin_list_contains", "SELECT p_partkey, list_contains(string_split(p_type, ' '), 'BRASS') AS brass, list_contains(string_split(p_type, ' '), 'BRAS') AS none FROM part", lambda w: part(w).select("p_partkey", B.FILTERS["listContains"](F.col("p_type"), F.lit("BRASS")).alias("brass"), B.FILTERS["listContains"](F.col("p_type"), F.lit("BRAS")).alias("none")))
_KIND = "CASE page_id % 3 WHEN 0 THEN 'iri' WHEN 1 THEN 'literal' ELSE 'bnode' END"
register(
    "builtin_type", f"SELECT page_id, k = 'iri' AS uri, k = 'literal' AS literal, k = 'bnode' AS bnode, k <> 'bnode' AS named FROM (SELECT page_id, {_KIND} AS k FROM pages)",
    lambda w: pages(w).withColumn("k", F.expr(_KIND)).select("page_id", *(B.KINDS[k](F.col("k")).alias(n) for k, n in (("isURI", "uri"), ("isLiteral", "literal"), ("isBNode", "bnode"), ("notBNode", "named")))),
)
ask(
    "cross_of_values", "SELECT container AS c, label AS l, f FROM tags, (VALUES ('base'), ('strict')) b(f) WHERE label IN ('Debt', 'Trade')",
    "SELECT ?c ?l ?f WHERE { VALUES ?l { 'Debt' 'Trade' } VALUES ?f { 'base' 'strict' } ?c <label> ?l }",
)
register(
    "k_counts_pairs", "SELECT p_brand AS \"table\", 'g' AS scope, min(n) AS k FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1",
    # each part twice: brand and type as two values, and as one value that reads like both; these are different records
    lambda w: _pairs(w),
)


def _pairs(w) -> DataFrame:
    one = lambda k, name, value: F.struct(F.concat(F.lit(f"{k}/"), "p_partkey").alias("record"), F.lit(name).alias("name"), value.alias("value"))
    cells = F.array(one("a", "brand", F.col("p_brand")), one("a", "type", F.col("p_type")), one("b", "brand", F.concat("p_brand", F.lit(";type="), "p_type")))
    fields = W.read(w.spark, w.dir, "part").select(F.col("p_brand").alias("table"), F.explode(cells).alias("x")).select(F.concat("x.record", F.lit("."), "x.name").alias("field"), "table", "x.*")
    return kanon.k_anonymity(kanon.signatures(fields, fields.select(F.col("field").alias("container"), F.lit("g").alias("scope")), as_text=False))


over(
    "siblings", "SELECT DISTINCT container, sibling FROM (SELECT x.child AS container, y.child AS sibling FROM contains x JOIN contains y ON x.parent = y.parent WHERE x.parent IN (SELECT child FROM contains WHERE parent = 'R1') OR starts_with(x.parent, 'R') UNION ALL SELECT a, b FROM (SELECT DISTINCT parent AS a FROM contains WHERE parent NOT IN (SELECT child FROM contains)) CROSS JOIN (SELECT DISTINCT parent AS b FROM contains WHERE parent NOT IN (SELECT child FROM contains))) WHERE container <> sibling AND (starts_with(container, 'R') OR starts_with(container, 'N'))",
    lambda w: closure.siblings(w.contains, w.env.containers.where("kind IN ('database', 'table')")),  # of all regions and nations
)
