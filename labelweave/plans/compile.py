"""Compilation of rules, on the driver: lists become rows, inheritance and label closure are worked out once.

Rule sets are vocabularies written by people; MAX_RULES bounds what is broadcast later.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from labelweave.env import Env, Equivalence, Implication, Rules
from labelweave.operators.conditions import Batch
from labelweave.operators.rules import MAX_RULES


@dataclass
class Compiled:
    propagations: list[tuple]  # framework, label, direction
    label_steps: list[tuple]  # source, target, framework, rule: subclass and unconditional implications
    conditional: list[tuple]  # framework, rule, source, target, condition index
    every: list[tuple]  # framework, rule, sources, target, condition index or -1
    bare: list[tuple]  # framework, rule, target, condition index
    conditions: Batch
    looked_at: set[str]  # labels that conditions and `every` rules look at


def expand_equivalence(e: Equivalence) -> list[Implication]:
    """Forward: all parts give the whole; reverse: the whole gives each part."""
    name = e.name or f"{'+'.join(e.parts)}={e.whole}"
    return [
        Implication(e.framework, tuple(dict.fromkeys(e.parts)), (e.whole,), e.conditions, len(set(e.parts)) > 1, f"{name}-forward"),
        Implication(e.framework, (e.whole,), tuple(dict.fromkeys(e.parts)), e.conditions, False, f"{name}-reverse"),
    ]


def chains(frameworks: list[tuple[str, str | None]]) -> dict[str, list[str]]:
    """Each framework with those that it extends, nearest first; cycles end."""
    extends: dict[str, list[str]] = {}
    for f, up in frameworks:
        extends.setdefault(f, [])
        if up:
            extends[f].append(up)
    out = {}
    for f in extends:
        found, at = [f], 0
        while at < len(found):
            found += [x for x in extends.get(found[at], []) if x not in found]
            at += 1
        out[f] = found
    return out


def topological(frameworks: list[tuple[str, str | None]]) -> list[str]:
    """Frameworks with those that they extend first; otherwise as given. A cycle is an error."""
    chain, out, open_ = chains(frameworks), [], set()

    def visit(f: str) -> None:
        if f in out:
            return
        if f in open_:
            raise ValueError(f"frameworks extend one another: {f}")
        open_.add(f)
        for up in dict.fromkeys(u for g, u in frameworks if g == f and u):
            visit(up)
        out.append(f)

    for f in dict.fromkeys(x for x, _ in frameworks):
        visit(f)
    return [f for f in out if f in chain]


def inherited(rules: Rules, chain: dict[str, list[str]], families: tuple[str, ...], override: bool = True, blocked: frozenset = frozenset()) -> Rules:
    """Rules of each family also under the frameworks that extend theirs; with override, a nearer rule of the same key replaces a farther one. blocked: see overridden().

    Keys: subclass and equivalence by target, implication by sources and targets, propagation by label and direction."""
    keys = {
        "propagations": lambda r: (r.label, r.facet, r.direction),
        "subclasses": lambda r: r.target,
        "equivalences": lambda r: r.whole,
        "implications": lambda r: (r.sources, r.targets),
        "conditionals": lambda r: (r.condition, r.target),
    }
    out = {}
    for family, key in keys.items():
        own = getattr(rules, family)
        if family in families:
            found = list(own)
            for f, ups in chain.items():
                seen = {key(r) for r in own if r.framework == f}
                for up in ups[1:]:
                    new = [r for r in own if r.framework == up and not (override and key(r) in seen) and (f, up, r.name) not in blocked]
                    found += [replace(r, framework=f) for r in new]
                    seen |= {key(r) for r in new}
            own = tuple(dict.fromkeys(found))
        out[family] = own
    return Rules(**out)


def overridden(rules: Rules, frameworks: list[tuple[str, str | None]]) -> frozenset:
    """(heir, framework, rule's name) where each way down from the rule's framework to the heir meets one that overrides the name."""
    by: dict[str, set[str]] = {}
    for o in rules.overrides:
        by.setdefault(o.name, set()).add(o.framework)
    out = set()
    for framework, name in {(r.framework, r.name) for k in Rules.__dataclass_fields__ if k != "overrides" for r in getattr(rules, k) if r.name in by}:
        reached, frontier = {framework}, [framework]
        while frontier:
            at = frontier.pop()
            below = {f for f, up in frameworks if up == at} - by[name] - reached
            reached |= below
            frontier += below
        out |= {(f, framework, name) for f, ups in chains(frameworks).items() if framework in ups and f not in reached}
    return frozenset(out)


def label_closure(steps: list[tuple]) -> list[tuple]:
    """Steps (source, target, framework, rule) closed: where any framework's label triggers a rule, chains act on labels alone, so
    one join with the closure does all of them. The rule named is the last of the first chain found."""
    by_source: dict[str, list[tuple]] = {}
    for s in steps:
        by_source.setdefault(s[0], []).append(s)
    out = {}
    for source in by_source:
        seen, frontier = {source}, [source]
        while frontier:
            at = frontier.pop(0)
            for _, target, framework, rule in by_source.get(at, ()):
                out.setdefault((source, target, framework), rule)
                if target not in seen:
                    seen.add(target)
                    frontier.append(target)
    return [(s, t, f, rule) for (s, t, f), rule in out.items()]


def compile_rules(env: Env, inherit: tuple[str, ...] = ("propagations", "subclasses"), override: bool = True, close_labels: bool = True) -> Compiled:
    frameworks = [tuple(r) for r in env.frameworks.select("framework", "extends").distinct().limit(MAX_RULES + 1).collect()]
    if len(frameworks) > MAX_RULES or sum(map(len, chains(frameworks).values())) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} frameworks, or pairs of one and what it extends: they are broadcast")
    facets: dict[str, list[str]] = {}
    if any(r.facet for r in env.rules.propagations):
        members = env.label_facets.distinct().limit(MAX_RULES + 1).collect()
        if len(members) > MAX_RULES:
            raise ValueError(f"over {MAX_RULES} labels of facets")
        for label, facet in members:
            facets.setdefault(facet, []).append(label)
    rules = inherited(env.rules, chains(frameworks), inherit, override, overridden(env.rules, frameworks))
    batch = Batch([c for r in [*rules.implications, *rules.equivalences] for c in r.conditions] + [r.condition for r in rules.conditionals])
    number = batch.of.__getitem__
    propagations = {(r.framework, label, r.direction) for r in rules.propagations for label in ([r.label] if r.label else facets.get(r.facet, []))}
    steps = [(s, r.target, r.framework, r.name or f"subclass:{r.target}") for r in rules.subclasses for s in r.sources]
    conditional, every = [], []
    for r in [*rules.implications, *(i for e in rules.equivalences for i in expand_equivalence(e))]:
        name = r.name or f"{'+'.join(r.sources)}>{'+'.join(r.targets)}"
        for target in r.targets:
            for c in r.conditions or (None,):
                if r.every:
                    every.append((r.framework, f"{name}>{target}#{-1 if c is None else number(c)}", sorted(set(r.sources)), target, -1 if c is None else number(c)))
                elif c is None:
                    steps += [(s, target, r.framework, name) for s in r.sources]
                else:
                    conditional += [(r.framework, name, s, target, number(c)) for s in r.sources]
    bare = [(r.framework, r.name or f"conditional:{r.target}", r.target, number(r.condition)) for r in rules.conditionals]
    steps = list(dict.fromkeys(steps))
    if close_labels:
        steps = label_closure(steps)
    looked_at = batch.labels() | {s for e in every for s in e[2]} | {c[2] for c in conditional}
    if len(steps) + len(propagations) + len(conditional) + len(every) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} compiled rules")
    return Compiled(sorted(propagations), steps, conditional, every, bare, batch, looked_at)
