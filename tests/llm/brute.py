"""Plain versions of the operators, over Python rows (doc_id, text)."""

import hashlib
import re

import xxhash

LOWER = {i: i + 32 for i in range(65, 91)}
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LAST = 1 << 63


def components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def simhash(rows):
    prints = []
    for _, t in rows:
        words = SPACE_WORDS.findall((t or "").translate(LOWER))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    roots = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = {}
    for i, r in enumerate(roots):
        if rows[i][0] is not None:
            least[r] = min(least.get(r, LAST), rows[i][0])
    return [(rows[i][0], f"{prints[i]:016x}", least.get(roots[i])) for i in range(len(rows))]


def near(rows, similarity=0.8, width=5):
    sets = []
    for _, t in rows:
        words = (t or "").encode().lower().split()
        k = min(width, len(words)) or 1
        sets.append({b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)})
    alike = lambda a, b: (not a and not b) or len(a & b) >= similarity * len(a | b)
    return components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])


def _windows(rows, cut, size):
    first = {}
    for d, t in rows:
        x = cut(t)
        for i in range(len(x) - size + 1):
            k = tuple(x[i : i + size])
            first[k] = min(first.get(k, LAST), LAST if d is None else d)
    for d, t in rows:
        x = cut(t)
        gone = [False] * len(x)
        for i in range(len(x) - size + 1):
            if first[tuple(x[i : i + size])] < (LAST if d is None else d):
                gone[i : i + size] = [True] * size
        yield d, x, gone


def passages(rows, size=50):
    out = []
    for d, words, gone in _windows(rows, lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()), size):
        out.append((d, len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest()))
    return out


def repeats(rows, size=50):
    out = []
    for d, data, gone in _windows(rows, lambda t: (t or "").encode(), size):
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return out


def contaminated(rows, items, span=13):
    windows = {}
    for item, t in items:
        words = ALNUM_WORDS.findall((t or "").translate(LOWER))
        k = min(span, len(words))
        for i in range(len(words) - k + 1 if words and item is not None else 0):
            windows.setdefault(tuple(words[i : i + k]), set()).add(item)
    out = []
    for d, t in rows:
        words, hit, found = ALNUM_WORDS.findall((t or "").translate(LOWER)), set(), set()
        for k in {len(w) for w in windows}:
            for i in range(len(words) - k + 1):
                if own := windows.get(tuple(words[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((d, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return out


def quality(rows):
    out = []
    for d, t in rows:
        t = t or ""
        words = SPACE_WORDS.findall(t)
        at = {}
        for i in range(len(words) - 2):
            at.setdefault(tuple(words[i : i + 3]), []).append(i)
        repeat = len({j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)})
        lines = [x for x in t.split("\n") if SPACE_WORDS.search(x)]
        out.append((d, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, len(words) < 50 or 100 * repeat > 50 * len(words)))
    return out
