"""Framework modules: TOML files of labels, facets and rules, in the library or anywhere else.

A file has name, type, extends, requires (frameworks that must be loaded before), labels, facets (facet: its labels), parts (frameworks
that are part of this one) and lists of propagation, subclass, implication, equivalence and conditional rules. A rule's framework is the file's unless it
names another. `overrides` lists names of rules that the framework, and what extends it, does not inherit. Conditions are lists: ["contains" | "has" | "joinable" | a relation, label], ["and" | "or", condition, ...] or
["compare", operand, operator, operand], an operand being [label, parameter(, default)] or a number.

A folder is a module too. Its framework.toml may list further files, relative to it, at the top or in a table [files]: `model` (Turtle), `rules` (rule texts),
`constructs` and `updates` (SPARQL texts), which take part in the engine's rounds, as lists or as tables [files.model] with a list `files`; and `depends_on` beside
`requires`. Other keys and files that are not there are errors. A folder without one is read for what its files end in:
.toml, .ttl, .rules, and .rq or .ru (a text with CONSTRUCT, or an update).
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from labelweave import env as E

HERE = Path(__file__).resolve().parent.parent / "frameworks"
SHIPPED = ("base", "hipaa", "gdpr", "ema", "italy")
#: Kinds of files that a manifest lists, and where their contents go.
FILES = {"model": "models", "rules": "rule_texts", "constructs": "constructs", "updates": "updates"}
KEYS = {"name", "version", "description", "type", "extends", "requires", "depends_on", "labels", "part", "facets", "propagation", "subclass", "implication", "equivalence", "conditional", "overrides", "files", *FILES}
TYPES = ("internal", "core", "privacy", "custom")


@dataclass
class Modules:
    """What the loaded framework files say, in order of loading."""

    frameworks: list[tuple] = field(default_factory=list)
    labels: list[tuple] = field(default_factory=list)
    label_facets: list[tuple] = field(default_factory=list)
    rules: E.Rules = E.Rules()
    models: list[str] = field(default_factory=list)
    rule_texts: list[str] = field(default_factory=list)
    constructs: list[str] = field(default_factory=list)
    updates: list[str] = field(default_factory=list)

    def load(self, path: str | Path) -> Modules:
        """A file, a directory with framework.toml or other .toml files, or the name of a shipped framework."""
        path = Path(path)
        if not path.exists() and (HERE / f"{path}.toml").exists():
            path = HERE / f"{path}.toml"
        if path.is_dir():
            if (path / "framework.toml").exists():
                return self.load(path / "framework.toml")
            for f in sorted(path.glob("**/*.toml")):
                self.load(f)
            for f in sorted(path.glob("**/*")):
                self._file(f)
            return self
        found = tomllib.loads(path.read_text())
        if unknown := set(found) - KEYS:
            raise ValueError(f"{path}: unknown keys {sorted(unknown)}")
        listed = found.get("files", {})
        if unknown := set(listed) - set(FILES):
            raise ValueError(f"{path}: unknown kinds of files {sorted(unknown)}: one of {sorted(FILES)}")
        if "name" in found:
            self._add(found)
        for kind, where in FILES.items():
            under = listed.get(kind, [])
            for f in [*found.get(kind, []), *(under.get("files", []) if isinstance(under, dict) else under)]:
                self._file(path.parent / f, where)
        return self

    def _file(self, path: Path, kind: str | None = None) -> None:
        end = path.suffix
        if kind is None and end in (".rq", ".ru"):
            kind = "constructs" if "CONSTRUCT" in path.read_text().upper() else "updates"
        kind = kind or {".ttl": "models", ".rules": "rule_texts"}.get(end)
        if kind == "models":
            if not path.exists():
                raise FileNotFoundError(path)
            self.models.append(str(path))
        elif kind:
            getattr(self, kind).append(path.read_text())

    def _add(self, x: dict) -> Modules:
        name, known = x["name"], {f[0] for f in self.frameworks}
        if x.get("type", "privacy") not in TYPES:
            raise ValueError(f"{name}: type is one of {TYPES}")
        if missing := {*x.get("requires", ()), *x.get("depends_on", ())} - known:
            raise ValueError(f"{name} needs {sorted(missing)} before it")
        self.frameworks.append((name, x.get("extends"), None, x.get("type", "privacy")))
        self.labels += [(label, name) for label in x.get("labels", ())]
        for p in x.get("part", ()):
            self.frameworks.append((p["name"], p.get("extends"), p["of"], x.get("type", "privacy")))
            self.labels += [(label, p["name"]) for label in p.get("labels", ())]
        introduced = {label for label, _ in self.labels}
        for facet, members in x.get("facets", {}).items():
            self.label_facets += [(label, facet) for label in members]
            self.labels += [(label, name) for label in members if label not in introduced]
        own = lambda r: r.get("framework", name)
        when = lambda r: (condition(r["when"]),) if "when" in r else ()
        self.rules += E.Rules(
            tuple(E.Propagation(own(r), r["direction"], r.get("label"), r.get("facet"), r.get("name", "")) for r in x.get("propagation", ())),
            tuple(E.Subclass(own(r), tuple(r["any"]), r["to"], r.get("name", "")) for r in x.get("subclass", ())),
            tuple(E.Implication(own(r), tuple(r.get("any") or r["all"]), tuple(r["to"]), when(r), "all" in r, r.get("name", "")) for r in x.get("implication", ())),
            tuple(E.Equivalence(own(r), tuple(r["parts"]), r["whole"], when(r), r.get("name", "")) for r in x.get("equivalence", ())),
            tuple(E.Conditional(own(r), condition(r["when"]), r["to"], r.get("name", "")) for r in x.get("conditional", ())),
            tuple(E.Override(name, r) for r in x.get("overrides", ())),
        )
        return self

    def ordered(self) -> list[tuple]:
        """Frameworks by type, in the order of TYPES, else as loaded."""
        return sorted(self.frameworks, key=lambda f: TYPES.index(f[3]))

    def environment(self, spark: SparkSession, **rows) -> E.Env:
        """With rows for the tables of data, and what the modules' Turtle files hold."""
        env = E.from_rows(spark, self.rules, frameworks=self.ordered(), labels=self.labels, label_facets=self.label_facets, **rows)
        if not self.models:
            return env
        from labelweave.sources import graph, inputs, turtle

        triples = turtle.read(spark, *self.models)
        return inputs.merge(env, graph.environment(triples, graph.rules_from_graph(triples)))

    def in_rounds(self, env: E.Env) -> list:
        """The modules' texts as rules of the engine's rounds over env: engine.infer(env, extra=tuple(modules.in_rounds(env)))."""
        from labelweave.plans import sparql

        return sparql.in_rounds(env, self.constructs, self.updates, self.rule_texts)

    def retracts(self, env: E.Env) -> list:
        """The modules' updates that DELETE: engine.infer(env, ..., retracts=tuple(modules.retracts(env)))."""
        from labelweave.plans import sparql

        return sparql.retracts(env, self.updates)


def condition(x: list):
    kind, *rest = x
    if kind in ("and", "or"):
        return (E.All if kind == "and" else E.Any)(tuple(map(condition, rest)))
    if kind == "compare":
        return E.Compare(operand(rest[0]), rest[1], operand(rest[2]), operand(rest[3]) if len(rest) > 3 else None)
    if kind in ("contains", "has", "joinable"):
        return {"contains": E.Contains, "has": E.Has, "joinable": E.JoinableTo}[kind](rest[0])
    return E.Related(rest[0], kind.capitalize())


def operand(x) -> E.Operand:
    if isinstance(x, list):
        return E.Operand(x[0], x[1], default=x[2] if len(x) > 2 else None)
    return E.Operand(literal=x)


def shipped(*names: str) -> Modules:
    out = Modules()
    for name in names or SHIPPED:
        out.load(name)
    return out
