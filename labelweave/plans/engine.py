"""The fixed point of all rules over an environment: strata, and in each a semi-naive loop.

S0 closures; S1 ground facts; S2 all rules; S3 k-anonymity from the quasi-identifiers found; S4 all rules again; S5 what users take back (plans/retract.py).
Rules that take one fact to one fact (subclass, unconditional implication, propagation) join only the last round's new facts, until nothing follows. Only then,
and only if labels came that they look at, rules with conditions or several sources are asked, about what changed (plans/conditional.py). All candidates of
a round meet one anti-join.

Facts are a set by (container, label, scope, framework). Of several derivations in a round the first by (rule, source) gives parameters and
provenance; later rounds change nothing. Each round is written to the shared folder, in one job that counts as it writes; what no result reads goes again.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave import env as E
from labelweave.operators import closure, kanon
from labelweave.operators import rules as R
from labelweave.operators.conditions import Edges
from labelweave.plans import proofs, retract
from labelweave.plans.compile import Compiled, compile_rules
from labelweave.plans.conditional import Conditional
from labelweave.storage import drop, observed, written

#: Rows up to which an edge table goes to all executors; of pairs of names, some megabytes.
BROADCAST_ROWS = 50_000
NAMES = [x.split()[0] for x in E.ASSERTION.replace("map<string,string>", "map").split(", ")]


@dataclass
class Result:
    env: E.Env
    assertions: DataFrame
    available: DataFrame
    ancestors_of: Callable[[], DataFrame]
    joinable: DataFrame
    k: DataFrame
    rounds: int
    metrics: list[tuple] = field(default_factory=list)  # stratum, round, number of the round in the run, seconds
    #: facts, and the number of the round that each came in
    by_round: DataFrame | None = None
    #: with keep_conditions: (condition, container, scope) that conditions were asked at, and that were found to hold
    marks: DataFrame | None = None
    holds: DataFrame | None = None
    engine: Engine | None = None

    @cached_property
    def ancestors(self) -> DataFrame:
        """Worked out when asked for: most rule sets never read it."""
        return self.ancestors_of()

    def containment(self, labels: list[str] | None = None) -> DataFrame:
        needed = None if labels is None else self.env.spark.createDataFrame([(x,) for x in labels], "label string")
        return R.containment(self.assertions, self.ancestors, self.available, needed)

    def proofs(self, asked: DataFrame) -> DataFrame:
        """The steps that lead to asked facts (container, label, scope, framework) from given ones (plans/proofs.py)."""
        return proofs.Prover(self.engine, self.by_round)(asked)

    def metrics_table(self) -> DataFrame:
        """(stratum, round, derived_via, facts, seconds) of the facts that are left. The rules of a round share a job: each has the part of its seconds that
        its facts are of the round's; a round that gave none has a row without a rule. The seconds sum to the run's."""
        rounds = self.env.spark.createDataFrame(self.metrics, "stratum string, round int, number int, took double")
        counted = self.by_round.groupBy(F.col("round").alias("number"), "derived_via").agg(F.count("*").alias("facts"))
        total = counted.groupBy("number").agg(F.sum("facts").alias("total"))
        out = F.broadcast(rounds).join(counted, "number", "left").join(total, "number", "left")
        return out.select("stratum", "round", "derived_via", F.coalesce("facts", F.lit(0)).alias("facts"), (F.col("took") * F.coalesce(F.col("facts") / F.col("total"), F.lit(1.0))).alias("seconds"))

    def register_views(self) -> None:
        """assertions, containers, ... as temporary views for spark.sql."""
        for name, df in {**self.env.tables, "assertions": self.assertions, "available": self.available, "ancestors": self.ancestors, "k_anonymity": self.k}.items():
            df.createOrReplaceTempView(name)


class Engine:
    def __init__(self, env: E.Env, *, check_target: bool = True, inherit: tuple[str, ...] = ("propagations", "subclasses"), override: bool = True, close_labels: bool = True,
                 with_k: bool = True, on_drift: str = "raise", max_rounds: int = 1000, extra: tuple = (), visibility: str = "any",
                 retracts: tuple = (), keep_conditions: bool = False, quasi: tuple[str, str] = (kanon.QUASI_IDENTIFIER, kanon.FRAMEWORK), analysis: str = kanon.ANALYSIS,
                 watch: Callable[[str, int, DataFrame, int], None] | None = None):
        """check_target: propagation ends only where the target is available. extra: callables (facts, new facts) -> DataFrame of
        (container, label, scope, framework), run each round: user rules. visibility: 'any' framework's label triggers a rule, or only
        those of the rule's own 'chain' of extended frameworks. retracts: callables facts -> (facts to take back, facts to add), each (container, label, scope,
        framework), asked once nothing more follows, again and again until they take back and add nothing (see plans/retract.py). on_drift: what a change of quasi-identifiers after k was computed does ('raise' or
        'warn'). quasi: label and framework of quasi-identifiers; analysis: the label of the k-anonymity facts. watch: called after each round with its stratum,
        number in the stratum, new facts and how many they are."""
        if visibility not in ("any", "chain"):
            raise ValueError("visibility: 'any' or 'chain'")
        self.env, self.check_target, self.with_k, self.on_drift, self.max_rounds, self.extra, self.visibility = env, check_target, with_k, on_drift, max_rounds, extra, visibility
        self.quasi, self.analysis, self.retracts, self.keep_conditions, self.barred, self.watch = quasi, analysis, retracts, keep_conditions, None, watch
        self.rules: Compiled = compile_rules(env, inherit, override, close_labels and visibility == "any")
        self.above = self._above()
        #: labels that a rule, or k-anonymity, can give; user texts can give any
        self.given = {t for _, t, _, _ in self.rules.label_steps} | {x for _, x, _ in self.rules.propagations} | {x[3] for x in [*self.rules.conditional, *self.rules.every]} | {x[2] for x in self.rules.bare} | {analysis}
        self.metrics: list[tuple] = []
        self.rounds = 0

    def _above(self) -> dict[str, set[str]]:
        """Each framework with those that its facts hold in, too."""
        rows = self.env.frameworks.where("sub_framework_of IS NOT NULL").select("framework", "sub_framework_of").distinct().limit(R.MAX_RULES + 1).collect()
        if len(rows) > R.MAX_RULES:
            raise ValueError(f"over {R.MAX_RULES} frameworks that are part of others")
        out: dict[str, set[str]] = {}
        for f, up in rows:
            out.setdefault(f, set()).add(up)
        return out

    # --- strata

    def run(self) -> Result:
        env = self.env
        below = closure.down(env.contains, env.availability)
        self.contains = below.edges.select("parent", "child")
        available = closure.available(env.availability, below)
        joinable, beside = observed(closure.symmetric(env.joinable), "edges")
        self.edges = self._edges(joinable, below.rows, beside["n"])
        self.contains, self.avail, self.joinable = self._sent(self.contains, below.rows), self._sent(available), self._sent(joinable, beside["n"])
        # what moves outward alone lands on containers with children
        self.landing = self._sent(available._inner, available._rows) if {d for _, _, d in self.rules.propagations} == {"Outward"} else self.avail
        self.chain = closure.framework_chain(env.frameworks) if self.visibility == "chain" else None
        edges = Edges(self.avail, self.contains, self.joinable, lambda: self.closure)
        self.state = Conditional(env.spark, self.rules, edges, self._seen, self.chain is not None)
        base = self._visible(available)
        facts = self._fixpoint("S2", base, self._ground(base is None), base, base=base, rows=available._rows)
        k = kanon.k_anonymity(kanon.signatures(env.fields, self._quasi(facts), as_text=False))
        if self.with_k:
            k = written(k)
        if self.with_k and not k.isEmpty():
            before = written(self._quasi(facts), "quasi")
            facts = self._fixpoint("S4", facts, self._shape(kanon.as_assertions(k, self.analysis, self.quasi[1]), "KAnonymity"))
        if self.retracts:
            facts = retract.run(self, facts)
        if self.with_k and not k.isEmpty():
            if not self._quasi(facts).join(before, ["container", "scope"], "left_anti").isEmpty():
                message = "quasi-identifiers changed after k-anonymity was computed"
                if self.on_drift == "raise":
                    raise RuntimeError(message)
                import warnings

                warnings.warn(message, stacklevel=2)
        marks, holds = (self.state.marks.table, self.state.holds.table) if self.keep_conditions else (None, None)
        if not self.keep_conditions:
            self.state.drop()
        return Result(env, facts.select(*NAMES), available, lambda: self.ancestors, joinable, k, self.rounds, self.metrics, facts, marks, holds, self)

    @cached_property
    def ancestors(self) -> DataFrame:
        return closure.ancestors(self.contains)

    @cached_property
    def closure(self) -> DataFrame:
        return self._sent(self.ancestors)

    @staticmethod
    def _sent(df: DataFrame, rows: int | None = None) -> DataFrame:
        """A written table, broadcast in joins if it has at most BROADCAST_ROWS rows; else Spark joins it by shuffle. It is counted unless that is known."""
        rows = getattr(df, "_rows", None) if rows is None else rows
        return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df

    def _edges(self, joinable: DataFrame, below: int, beside: int) -> DataFrame:
        """(direction, source, container) of the directions that rules use, but for peers. below, beside: rows of containment and of joinable edges."""
        one = lambda df, d, a, b: df.select(F.lit(d).alias("direction"), F.col(a).alias("source"), F.col(b).alias("container"))
        found = {"Inward": one(self.contains, "Inward", "parent", "child"), "Outward": one(self.contains, "Outward", "child", "parent"), "Joinable": one(joinable, "Joinable", "a", "b")}
        used = {d for _, _, d in self.rules.propagations}
        out, rows = one(joinable.limit(0), "none", "a", "b"), 0
        for d, df in found.items():
            if d in used:
                out, rows = out.unionByName(df), rows + (beside if d == "Joinable" else below)
        return self._sent(out, rows)

    def _quasi(self, facts: DataFrame) -> DataFrame:
        return facts.where((F.col("label") == self.quasi[0]) & (F.col("framework") == self.quasi[1])).select("container", "scope").distinct()

    def _shape(self, df: DataFrame, via, ground: bool = False) -> DataFrame:
        columns = df.columns
        return df.select(
            *E.KEY, F.col("params") if "params" in columns else F.lit(None).cast("map<string,string>").alias("params"), F.lit(ground).alias("is_ground"),
            (F.col(via) if via in columns else F.lit(via)).alias("derived_via"), F.col("source").alias("derived_from") if "source" in columns else F.lit(None).cast("string").alias("derived_from"),
        )

    def _visible(self, available: DataFrame) -> DataFrame | None:
        """The facts of availability as they stand in its table, neither made distinct nor written again: they are a set already. None if another ground fact may be
        one of them, or if a rule starts from one."""
        rules, own = self.rules, lambda df, f: df.where((F.col("label") == R.AVAILABLE) & (F.col(f) == R.EXTERNAL))
        used = rules.looked_at | {s for s, *_ in rules.label_steps} | {x for _, x, _ in rules.propagations} | {x[2] for x in rules.conditional} | self.given
        if R.AVAILABLE in used or R.EXTERNAL in self.above or not own(self.env.labels, "introduced_by").isEmpty() or not own(self.env.ground, "framework").isEmpty():
            return None
        return self._shape(R.visibility(available), "Availability").withColumn("round", F.lit(0))

    def _ground(self, visible: bool = True) -> DataFrame:
        env = self.env
        parts = [
            self._shape(env.ground, "Ground", True),
            *([self._shape(R.visibility(self.avail), "Availability")] if visible else []),
            self._shape(R.tags(env.tags, env.labels, self.avail), "Tag", True),
            self._shape(R.field_declarations(env.field_decls, env.fields, env.labels, self.avail), "FieldDeclaration", True),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # --- the loop

    def _fixpoint(self, stratum: str, facts: DataFrame | None, seed: DataFrame | None, changed: DataFrame | None = None, told: bool = False, base: DataFrame | None = None, rows: int = 0) -> DataFrame:
        """The facts and all that follows from the seed. changed: facts among them that conditions are to be asked about as if they were new. told: the seed may
        have labels that no rule gives. base: those of the facts that came with the seed; they are rows."""
        tables, pending = [] if facts is None else [facts], [] if changed is None else [changed]
        delta, touched, round_ = None, True, 0
        found = seed
        while True:
            began = time.perf_counter()
            if found is None:  # no fact that a rule could start from
                delta, seen = facts.limit(0), {"n": 0, "looked_at": 0}
            else:
                delta, seen = self._new(found, facts, told or bool(self.extra))
            told = False
            self.metrics.append((stratum, round_, len(self.metrics), time.perf_counter() - began))
            self.rounds += round_ > 0
            if self.watch:
                self.watch(stratum, round_, *((delta, seen["n"]) if base is None or round_ else (delta.unionByName(base), seen["n"] + rows)))
            if base is not None and not round_ and not seen["n"]:  # the rounds begin from these alone
                drop(delta)
                delta, seen = base, {**seen, "n": rows}
                facts, base = base, None
            elif seen["n"]:
                tables.append(delta)
            touched = touched or bool(seen["looked_at"])
            if seen["n"]:
                pending.append(delta)
                facts = reduce(DataFrame.unionByName, tables)
            elif facts is None:
                return delta
            else:
                drop(delta)
                delta = None
                if not touched:
                    return facts
            if round_ >= self.max_rounds:
                raise RuntimeError(f"no fixed point within {self.max_rounds} rounds")
            round_ += 1
            if len(tables) >= 8:
                tables = [written(facts, "facts")]
                facts = tables[0]
            if delta is not None:  # what follows from the last round's facts alone
                found = self._linear(delta, seen)
                for rule in self.extra:
                    new = delta if base is None or round_ > 1 else delta.unionByName(base)
                    more = self._shape(rule(facts.select(*NAMES), new.select(*NAMES)), "extra")
                    found = more if found is None else found.unionByName(more)
            else:  # nothing more does: conditions, if they may have changed
                touched = False
                if self.state.idle or not pending:
                    return facts
                found = self._shape(self.state.round(facts, reduce(DataFrame.unionByName, pending)), "rule")
                pending = []

    def _new(self, found: DataFrame, facts: DataFrame | None, told: bool = False) -> tuple[DataFrame, dict]:
        """Candidates made distinct (partial aggregation first), without known facts and those that were taken back; how many, how many that conditions look at, and how
        many that rules of a kind start from. Unless user texts told them, candidates have labels that rules give, so they meet only such facts."""
        first = F.min_by(F.struct(*NAMES[4:]), F.struct(F.coalesce("derived_via", F.lit("")), F.coalesce("derived_from", F.lit(""))))
        one = found.groupBy(*E.KEY).agg(first.alias("x")).select(*E.KEY, "x.*")
        if facts is not None and not told:
            facts = facts.where(F.col("label").isin(sorted(self.given)) | F.col("framework").isin(sorted(set().union(*self.above.values()))))
        for known in (facts, self.barred):
            if known is not None:
                one = one.join(known.select(*E.KEY), E.KEY, "left_anti")
        return observed(one.withColumn("round", F.lit(len(self.metrics))), "facts", **self._starting())

    def _starting(self) -> dict:
        """Counts of facts: those that conditions look at, and those that label rules, propagations and the rule of parent frameworks start from."""
        looked_at = F.col("label").isin(sorted(self.rules.looked_at))
        return {k: F.count_if(c) for k, c in {"looked_at": looked_at, **self._kinds()}.items()}

    def _kinds(self) -> dict:
        up = F.col("framework").isin(sorted(self.above)) & ~F.coalesce(F.col("derived_via") == "ParentFramework", F.lit(False))
        label = lambda names: F.col("label").isin(sorted(names))
        return {"stepping": label({s for s, *_ in self.rules.label_steps}), "moving": label({x for _, x, _ in self.rules.propagations}), "rising": up}

    def _starts(self):
        """Whether a rule of one source may start from a fact."""
        return reduce(lambda a, b: a | b, self._kinds().values())

    def _seen(self, facts: DataFrame, rules: DataFrame) -> DataFrame:
        """Facts joined with rules (framework, source, ...) that they trigger; once for each framework that asserts them."""
        if self.chain is None:
            return facts.select("container", F.col("label").alias("source"), "scope").join(rules, "source")
        up = rules.join(F.broadcast(self.chain), "framework")
        own = facts.select("container", F.col("label").alias("source"), "scope", F.col("framework").alias("ancestor")).distinct()
        return own.join(F.broadcast(up), ["source", "ancestor"]).drop("ancestor").distinct()

    def _linear(self, delta: DataFrame, counts: dict | None = None) -> DataFrame | None:
        """What rules of one source give of these facts; counts: of _starting(). None: nothing starts from them."""
        spark, rules = self.env.spark, self.rules
        if counts is None:
            counts = dict.fromkeys(("stepping", "moving", "rising"), BROADCAST_ROWS + 1)
        delta, out = delta.select(*NAMES), []
        if rules.label_steps and counts["stepping"]:
            steps = R.rule_table(spark, rules.label_steps, "source string, target string, framework string, rule string")
            moved = self._seen(delta, steps).select("container", F.col("target").alias("label"), "scope", "framework", "rule")
            out.append(self._shape(moved, "rule"))
        if rules.propagations and counts["moving"]:
            moves = R.rule_table(spark, rules.propagations, "framework string, label string, direction string")
            moved = delta.join(moves, ["framework", "label"]).withColumnRenamed("container", "source")
            if counts["moving"] <= BROADCAST_ROWS:  # a fact moves in five directions at most
                moved = F.broadcast(moved)
            gone = moved.join(self.edges, ["direction", "source"])
            columns = [*E.KEY, "params", "source", "direction"]
            gone = gone.select(*columns)
            if any(d == "Peer" for _, _, d in rules.propagations):
                # peers: labels are made distinct at the parent, whose children get them
                up = moved.where("direction = 'Peer'").join(self.contains.select(F.col("child").alias("source"), "parent"), "source")
                up = up.groupBy("parent", "label", "scope", "framework").agg(F.min("source").alias("source"), F.min_by("params", "source").alias("params"))
                down = up.join(self.contains.select("parent", F.col("child").alias("container")), "parent").withColumn("direction", F.lit("Peer"))
                gone = gone.unionByName(down.select(*columns))
            if not self.check_target:  # joinable targets are checked always
                free = gone.where("direction <> 'Joinable'")
                out.append(self._shape(free, "direction"))
                gone = gone.where("direction = 'Joinable'")
            out.append(self._shape(gone.join(self.landing, ["container", "scope"], "left_semi"), "direction"))
        if self.above and counts["rising"]:
            out.append(self._shape(R.parent_framework(delta, self.env.frameworks), "ParentFramework"))
        return reduce(DataFrame.unionByName, out) if out else None


def infer(env: E.Env, **options) -> Result:
    """The fixed point of env's rules."""
    return Engine(env, **options).run()
