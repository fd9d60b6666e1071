"""A plain evaluator of the rules, over Python sets: what the engine must equal."""

from itertools import product

from labelweave import env as E
from labelweave.plans.compile import expand_equivalence


def evaluate(rules: E.Rules, rows: dict, rounds: int = 100, barred: frozenset = frozenset()):
    """barred: facts that stay out, whatever would give them."""
    contains = set(rows.get("contains", []))
    avail = set(rows.get("availability", []))
    while True:
        new = {(c, g) for (p, c), (x, g) in product(contains, avail) if p == x} - avail
        if not new:
            break
        avail |= new
    anc = set(contains)
    while True:
        new = {(a, c) for (a, b), (p, c) in product(anc, contains) if b == p} - anc
        if not new:
            break
        anc |= new
    joins = {(a, b) for a, b in rows.get("joinable", [])} | {(b, a) for a, b in rows.get("joinable", [])}
    siblings = {(a, b) for (p, a), (q, b) in product(contains, contains) if p == q and a != b}
    facets = rows.get("label_facets", [])
    params = {(c, l, g): p for c, l, g, f, p in rows.get("ground", []) if p}
    facts = {(c, l, g, f) for c, l, g, f, _ in rows.get("ground", [])}
    facts |= {(c, "Available", g, "ExternalFramework") for c, g in avail}
    facts |= {(c, l, g, f) for c, l in rows.get("tags", []) for m, f in rows.get("labels", []) if m == l for x, g in avail if x == c}
    facts -= barred

    def holds(cond, c, g, has):
        if isinstance(cond, E.All):
            return all(holds(p, c, g, has) for p in cond.parts)
        if isinstance(cond, E.Any):
            return any(holds(p, c, g, has) for p in cond.parts)
        if isinstance(cond, E.Has):
            return (c, cond.label, g) in has
        if isinstance(cond, E.Contains):
            return (c, g) in avail and ((c, cond.label, g) in has or any(a == c and (d, cond.label, g) in has for a, d in anc))
        if isinstance(cond, E.JoinableTo):
            return any(a == c and holds(E.Contains(cond.label), b, g, has) for a, b in joins)
        if isinstance(cond, E.Related):
            others = {
                "Self": {c}, "Parent": {p for p, x in contains if x == c}, "Child": {x for p, x in contains if p == c}, "Ancestor": {a for a, d in anc if d == c},
                "Descendant": {d for a, d in anc if a == c}, "Sibling": {b for a, b in siblings if a == c},
            }[cond.relation]
            return any((o, cond.label, g) in has for o in others)
        if (c, g) not in avail:
            return False
        value = lambda o: params.get((c, o.label, g), {}).get(o.param, o.literal if o.literal is not None else o.default) if o.label else o.literal
        a, b = value(cond.left), value(cond.right)
        return a is not None and b is not None and {"<": float(a) < float(b), ">": float(a) > float(b), "==": float(a) == float(b)}[cond.op]

    parents = {f: up for f, _, up, _ in rows.get("frameworks", []) if up}
    implications = [*rules.implications, *(i for e in rules.equivalences for i in expand_equivalence(e))]
    from_parent: set = set()
    for _ in range(rounds):
        has, new = {(c, l, g) for c, l, g, _ in facts}, set()
        for r in rules.subclasses:
            new |= {(c, r.target, g, r.framework) for c, l, g in has if l in r.sources}
        for r in implications:
            for c, g in {(c, g) for c, _, g in has}:
                own = [(c, s, g) in has for s in r.sources]
                if (all(own) if r.every else any(own)) and (not r.conditions or any(holds(k, c, g, has) for k in r.conditions)):
                    new |= {(c, t, g, r.framework) for t in r.targets}
        for r in rules.conditionals:
            new |= {(c, r.target, g, r.framework) for c, g in avail if holds(r.condition, c, g, has)}
        for r in rules.propagations:
            edges = {"Inward": contains, "Outward": {(b, a) for a, b in contains}, "Peer": siblings, "Joinable": joins}[r.direction]
            for label in [r.label] if r.label else [l for l, f in facets if f == r.facet]:
                new |= {(d, label, g, r.framework) for c, l, g, f in facts if l == label and f == r.framework for x, d in edges if x == c and (d, g) in avail}
        up = {(c, l, g, parents[f]) for c, l, g, f in facts - from_parent if f in parents}
        from_parent |= up - facts - new
        new = (new | up) - facts - barred
        if not new:
            return facts
        facts |= new
    raise AssertionError("no fixed point")
