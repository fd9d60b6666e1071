"""Each operator against its plain version, with odd rows, and over empty tables."""

import hashlib
import json
import random
import zlib
from collections import Counter

import brute
import corpus
import pytest
import public_tokenizers
import regex
from pyspark.sql import functions as F

from labelweave.llm import bpe, common, decontaminate, licences, passages, quality, repeats, sharding, simhash, urls, warc

RANKS = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()


@pytest.fixture(scope="module", params=[0, 1])
def texts(request):
    return corpus.rows(request.param)


@pytest.fixture(scope="module")
def docs(spark, texts):
    common.prepare(spark)
    return corpus.frame(spark, texts)


@pytest.fixture(scope="module")
def nothing(spark):
    common.prepare(spark)
    return spark.createDataFrame([], corpus.SCHEMA)


def test_simhash(docs, texts):
    got = simhash.link_fingerprints(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert corpus.as_set(got) == corpus.as_set(brute.simhash(texts))


def test_dense_fingerprints(spark):
    """A crowd of fingerprints around two centres, linked through chains."""
    import numpy as np

    rng = random.Random(5)
    fps = {0}
    for centre in (rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(300):
            x = centre
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = dict(map(tuple, simhash.components(simhash.similar_fingerprints(frame)).collect()))
    roots = brute.components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    got = [found.get(x, x) for x in signed]
    assert len(set(zip(got, roots))) == len(set(got)) == len(set(roots))  # the same partition
    # the way for crowded buckets finds the same
    own = np.array([x for x in fps if x >> 48 == fps[-1] >> 48], dtype=np.uint64)
    before, simhash.PAIRS = simhash.PAIRS, 64
    try:
        few = simhash.bucket_forest(own, 3)
    finally:
        simhash.PAIRS = before
    assert few.tolist() == simhash.bucket_forest(own, 3).tolist()


def test_near_duplicates(docs, texts):
    roots = brute.near(texts)
    root_of = {x: r for x, r in zip(texts, roots)}
    same = {}
    for r in simhash.near_duplicates(docs).collect():
        for t in {t for d, t in texts if d == r["doc_id"] and hashlib.md5((t or "").encode()).digest() == bytes(r["digest"])}:
            same[r["doc_id"], t] = r["component"]
    assert set(same) == set(texts)
    assert len(set(same.values())) == len(set(roots)) == len({(same[x], root_of[x]) for x in texts})
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    left = sorted(((root_of[r["doc_id"], r["text"]], r["doc_id"]) for r in kept.collect()), key=repr)
    want = {}
    for (d, _), r in zip(texts, roots):
        want[r] = min(want.get(r, brute.LAST), brute.LAST if d is None else d)
    assert left == sorted(((r, None if d == brute.LAST else d) for r, d in want.items()), key=repr)


def _replaced(words, places, tag):
    return [f"{tag}{i}" if i in places else w for i, w in enumerate(words)]


def test_near_duplicates_beside_a_crowd(spark):
    """Chains whose end is like a member of the crowd, but not like the crowd's leader."""
    common.prepare(spark)
    rng = random.Random(11)
    texts = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(300)]
        texts.append(base)
        for k in range(25):  # the crowd
            texts.append(_replaced(base, {rng.randrange(300)}, f"c{k}x"))
        for k in range(6):  # M: near the centre; N: near M alone
            m = _replaced(base, {10 + 45 * k, 30 + 45 * k, 50 + 45 * k - 5}, f"m{k}x")
            n = _replaced(m, {(20 + 45 * k + 47 * j) % 300 for j in range(6)}, f"n{k}x")
            texts += [m, n]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    roots = brute.near(rows)
    got = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(got.values())) == len(set(roots)) == len({(got[d], r) for (d, _), r in zip(rows, roots)})


def test_sketches_by_force():
    """Sets of a similarity of 0.8 or more, short and long, pass; sets well below do not."""
    import numpy as np

    rng = np.random.default_rng(13)
    passed = Counter()
    for n in (6, 40, 300, 2000, 20000):
        for similar in (0.8, 0.9, 0.7):
            for _ in range(60):
                both = max(1, round(n * 2 * similar / (1 + similar)))
                x = rng.integers(0, 1 << 63, 2 * n - both).astype(np.uint64)
                a, b = x[:n], x[n - both :]
                exact = both / len(x)
                ok = simhash.may_be_similar(simhash.sketch(a), simhash.sketch(b)[None], 0.8)[0]
                passed[exact >= 0.8, bool(ok)] += 1
                assert exact > 0.75 or n < 100 or not ok
    assert passed[True, False] <= 0.01 * passed[True, True]


def test_ring_by_force():
    """After the first links, in which those of a leader are refused, each pair of a bucket within budget was compared or has one label."""
    import numpy as np

    rng = np.random.default_rng(12)
    for size in (3, 10, 60, 300):
        centre = rng.integers(0, 1 << 16, 32).astype(np.uint16)
        s = np.tile(centre, (size, 1))
        for row in s:
            row[rng.choice(np.arange(2, 32), rng.integers(0, 14), replace=False)] = rng.integers(0, 3)
        nodes, allowed = rng.permutation(size) - size // 2, np.arange(1, 33) * 12 // 32
        u, v, rest = simhash.ring_pairs(nodes, s)
        place = {int(x): i for i, x in enumerate(nodes)}
        keep = rng.random(len(u)) < 0.5
        labels = simhash.labels_of(size, *(np.array([place[int(x)] for x in w[keep]], dtype=np.int64) for w in (u, v)))
        own = np.array([place[int(x)] for x in rest], dtype=np.int64)
        compared = {(min(a, b), max(a, b)) for a, b in zip(u.tolist(), v.tolist())}
        more = {p for a, b in simhash.ring_rest(nodes[own], s[own], labels[own]) for p in zip(a.tolist(), b.tolist())}
        want = {
            (min(a, b), max(a, b)) for a in nodes.tolist() for b in nodes.tolist()
            if a < b and (np.cumsum(s[place[a]] != s[place[b]]) <= allowed).all() and labels[place[a]] != labels[place[b]]
        }
        assert want <= compared | more and all(labels[place[a]] != labels[place[b]] for a, b in more)


def test_passages(docs, texts):
    got = passages.dedup_passages(docs, with_text=False).collect()
    assert corpus.as_set(got) == corpus.as_set(brute.passages(texts))
    for r in passages.dedup_passages(docs).collect():
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]


def test_repeats(docs, texts, monkeypatch):
    want = corpus.as_set(brute.repeats(texts))
    assert corpus.as_set(repeats.dedup_bytes(docs, with_text=False).collect()) == want
    # every anchor a crowd, and short pieces: the ways for hot anchors and long texts
    assert corpus.as_set(repeats.dedup_bytes(docs, crowd=1, with_text=False).collect()) == want


@pytest.mark.parametrize("ends", [[-(1 << 63), 5], [-(1 << 63), (1 << 63) - 1], [(1 << 63) - 1, None], [None, (1 << 63) - 1, None, -1, 0], [None, None, -(1 << 63)], [(1 << 63) - 1] * 2 + [None] * 2])
def test_ids_at_the_ends(spark, ends):
    """Repeats go from the documents of greater ids, whatever the ids; missing ones come last."""
    common.prepare(spark)
    shared = corpus.sentence(random.Random(1), 80)
    rows = [(d, shared if k % 2 else f"only{k} {shared} tail{k}") for k, d in enumerate(ends)] + [(77, corpus.sentence(random.Random(2), 70))]
    df = corpus.frame(spark, rows)
    got = passages.dedup_passages(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert corpus.as_set(got) == corpus.as_set(brute.passages(rows))
    got = repeats.dedup_bytes(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert corpus.as_set(got) == corpus.as_set(brute.repeats(rows))


def test_keep_one_beside_clashing_names(spark):
    common.prepare(spark)
    text = corpus.sentence(random.Random(5), 60)
    rows = [(k, text if k < 3 else corpus.sentence(random.Random(k), 40), "a", "b", k) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone_digest string, _Gone_Id string, __gone_id long")
    out = simhash.keep_one(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 3, 4, 5]


def test_recall_by_similarity(spark):
    """Pairs on both sides of 0.8: at or above, at least 99 in 100 are linked; below, none is."""
    common.prepare(spark)
    rng, rows, want = random.Random(8), [], {}
    for pair in range(400):
        words = corpus.sentence(rng, rng.randrange(60, 400)).split()
        other = list(words)
        for at in rng.sample(range(len(words)), rng.randrange(1, 12)):
            other[at] = f"edit{pair}x{at}"
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, other)]
        want[pair] = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
    component = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(corpus.frame(spark, rows)).collect()}
    linked = {p: component[2 * p] == component[2 * p + 1] for p in want}
    above = [linked[p] for p, s in want.items() if s >= 0.8]
    assert len(above) > 150 and sum(above) >= 0.99 * len(above)
    assert not any(linked[p] for p, s in want.items() if s < 0.8)


def test_long_documents_in_pieces(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    texts = [corpus.sentence(rng, 3000), corpus.sentence(rng, 10)]
    texts.append(texts[0][4000:9000])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([t.encode() for t in texts])], names=["a", "b"])
    read = lambda: list(repeats.contexts([batch], 1, 50, 20))
    whole = {(int(i), int(s), int(e)) for _, kind, blob in read() if kind == 0 for i, _, s, e in zip(*repeats.flows.read_verdicts([blob]))}
    monkeypatch.setattr(repeats, "PIECE", 2000)
    pieces = [blob for _, kind, blob in read() if kind == 1]
    ids = np.concatenate([repeats.flows.Docs.read(*repeats.flows.unpack(b)[:3]).ids for b in pieces])
    assert whole and set(ids.tolist()) == {1, 2, 3}


def removed_by_steps(texts, crowd, n=3):
    """{id: bytes removed} from the steps of repeats.removed, run by hand over rows (id, uint8 array)."""
    import numpy as np
    import pyarrow as pa

    flows = repeats.flows
    rows = [pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x.tobytes() for x in own])], names=["a", "b"]) for ids, own in texts]
    first = [x for batch in rows for x in repeats.contexts([batch], n, 50, 20)]
    asked, found = [], [x for x in first if x[1] == 0]
    for dest in range(n):
        if blobs := [b for d, kind, b in first if d == dest and kind == 1]:
            asked += repeats.shared_contexts(blobs, n, 50, crowd)
    fetched = []
    for dest in range(n):
        replies = {3: [b for d, _, b in asked if d == dest]}
        for batch in rows:
            raw = batch.column(1).to_pylist()
            data = np.frombuffer(b"".join(raw), dtype=np.uint8)
            hashes = np.array([flows.doc_hash(x) for x in raw], dtype=np.uint64)
            fetched += repeats.fetch([(replies, batch.column(0).to_numpy(), hashes, data, np.cumsum([0, *map(len, raw)]), None)], n, 50)
    for dest in range(n):
        if blobs := [b for d, _, b in fetched if d == dest]:
            found += repeats.sort_suffixes(blobs, n, 50)
    gone = {}
    for ids, _, starts, stops in [flows.read_verdicts([b]) for _, _, b in found]:
        for i, p, q in zip(ids.tolist(), starts.tolist(), stops.tolist()):
            gone.setdefault(i, set()).update(range(p, q))
    return gone


def hot_phrase(n, rng):
    """n different texts of 80 bytes around one 20-byte phrase, which is the anchor of most of their windows."""
    import numpy as np

    few = rng.integers(97, 123, (1 << 16, 20)).astype(np.uint8)
    text = rng.integers(97, 123, (n, 80)).astype(np.uint8)
    text[:, 30:50] = few[repeats.common.mix(repeats.common.Prefix(few.ravel()).rolling(20)[::20]).argmin()]  # the smallest hash
    return np.unique(text, axis=0)


@pytest.mark.parametrize("crowd", [4096, 1 << 30])
def test_hot_anchor_with_many_contexts(crowd):
    """One phrase in 60,000 different surroundings: only planted copies go, whether its windows are dealt one by one or sorted in pieces."""
    import numpy as np

    rng = np.random.default_rng(7)
    text = hot_phrase(60_000, rng)
    ids = rng.permutation(len(text)) + 10
    copies = text[:3]
    shares = [(ids[i : i + 20_000], text[i : i + 20_000]) for i in range(0, len(text), 20_000)] + [([1_000_000, 1_000_001, 1], copies)]
    gone = removed_by_steps(shares, crowd)
    assert {i: len(x) for i, x in gone.items()} == {1_000_000: 80, 1_000_001: 80, int(ids[2]): 80}


def test_a_crowd_is_a_part_of_its_bucket():
    """40 texts share 50 bytes around one phrase. Beside many other texts that is no crowd, whatever its size, and its contexts go whole; alone it is one."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(9)
    text = hot_phrase(40, rng)
    text[:, 15:65] = text[0, 15:65]
    crowded = {}
    for others in (0, 400):
        raw = [x.tobytes() for x in text] + [rng.integers(97, 123, 400).astype(np.uint8).tobytes() for _ in range(others)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(raw)), pa.int64()), pa.array(raw)], names=["a", "b"])
        blobs = [b for _, kind, b in repeats.contexts([batch], 1, 50, 20) if kind == 1]
        asked = [repeats.flows.unpack(b) for _, _, b in repeats.shared_contexts(blobs, 1, 50, 8)]
        crowded[others] = [bool(x) for *_, c in asked for x in c]
    assert len(crowded[0]) >= 40 and sum(crowded[0]) >= 40 and len(crowded[400]) >= 40 and not any(crowded[400])


def test_no_removal_on_equal_hashes(monkeypatch):
    """With hashes of four bits nearly everything collides, and still nothing goes that has no equal bytes before it."""
    import numpy as np

    rng = np.random.default_rng(8)
    text = hot_phrase(500, rng)
    ranges = repeats.common.Prefix.ranges
    monkeypatch.setattr(repeats.common.Prefix, "ranges", lambda self, a, b: ranges(self, a, b) >> np.uint64(60))
    gone = removed_by_steps([(np.arange(250), text[:250]), (np.arange(250, 501), np.concatenate([text[250:], text[:1]]))], 4096)
    assert set(gone) <= {500}


def test_suffix_sort():
    import numpy as np

    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    suffixes, groups = np.arange(3900), np.repeat(np.arange(3), 1300)
    sorter, limit = repeats.SuffixSort(text), np.full(3900, 50)
    order = sorter.sort(suffixes, groups, limit)
    raw = text.tobytes()
    for g in range(3):
        own = [raw[i : i + 50] for i in suffixes[order][groups == g]]
        assert own == sorted(raw[i : i + 50] for i in range(1300 * g, 1300 * g + 1300))
    new = sorter.classes(suffixes[order], groups, limit)
    assert new.sum() == sum(len({raw[i : i + 50] for i in range(1300 * g, 1300 * g + 1300)}) for g in range(3))


def test_strip_keeps_columns(docs, texts):
    got = repeats.strip(docs)
    assert got.columns == docs.columns and got.schema["text"].dataType == docs.schema["text"].dataType
    kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
    want = Counter()
    for (d, data, gone) in brute._windows(texts, lambda t: (t or "").encode(), 50):
        want[d, bytes(b for b, g in zip(data, gone) if not g).decode(errors="ignore")] += 1
    assert kept == want


def test_contamination(spark, docs, texts):
    plain = dict(texts)
    source = [t for t in plain.values() if t and len(t) > 300]
    items = [(1, " ".join(source[0].split()[10:40]).upper()), (2, "One two"), (3, source[1][:90]), (4, None), (5, ""), (6, " ".join(source[0].split()[20:33])), (None, "alpha"), (7, "absent words here"), (2, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = corpus.as_set(brute.contaminated(texts, items))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    own = docs.select("doc_id", "text")
    assert corpus.as_set(decontaminate.flag(own, bench).select(*columns).collect()) == want
    assert corpus.as_set(decontaminate.flag(own, bench, block_bytes=100).select(*columns).collect()) == want
    odd = docs.withColumn("_contaminated", F.lit("z")).withColumn("__N_HIT", F.lit(5))
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and Counter(r["_contaminated"] for r in kept.collect()) == {"z": sum(not r[-1] for r in brute.contaminated(texts, items))}
    clash = decontaminate.flag(docs, bench, prefix="_d_")
    assert clash.columns[: len(docs.columns)] == docs.columns and clash.count() == docs.count()
    assert not decontaminate.flag(own, bench.limit(0)).where("contaminated").count()


def test_quality(docs, texts):
    counted = quality.with_counts(docs.select("doc_id", "text")).withColumn("base", quality.rules()["few_words"] | quality.rules()["repeated_words"])
    got = counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base").collect()
    assert corpus.as_set(got) == corpus.as_set(brute.quality(texts))
    names = list(quality.RULES)
    one, other = (quality.judge(docs, order=o) for o in (names, names[::-1]))
    assert one.columns == [*docs.columns, "_rejected_by"]
    kept = lambda x: corpus.as_set(x.where("_rejected_by IS NULL").select("doc_id", "text").collect())
    assert kept(one) == kept(other) and sorted(quality.order_rules(docs)) == sorted(names)
    plan = json.dumps(quality.keep(docs)._jdf.queryExecution().optimizedPlan().toString())
    assert "Python" not in plan and plan.count("array_remove") == 1  # the words are split once
    table = common.written(docs)  # whose rows come in one order
    assert len({tuple(quality.order_rules(table)) for _ in range(4)}) == 1
    clash = docs.withColumn("_rejected_by", F.lit("z")).withColumn("__Rejected_By", F.lit("y"))
    assert quality.judge(clash).columns == [*clash.columns, "___rejected_by"]
    assert quality.keep(clash).columns == clash.columns and corpus.as_set(quality.keep(clash).select("doc_id", "text").collect()) == kept(one)


def test_licences(spark):
    mit = dict(licences.read_templates()[::-1])["mit"]
    rows = [
        (1, "Code under the MIT License and the mit license."), (2, "cc  BY"), (3, mit.capitalize() + " etc"), (4, " ".join(mit.split()[:10])), (5, None), (6, ""), (7, "GNU General, Public-License; apache license"), (8, "cc by " * 2000), (8, "cc by " * 2000),
        (9, "mit x license gnu general public"), (None, "apache LICENSE"),
    ]
    got = {(r["doc_id"]): r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit(1))).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 3, 7, "mit")
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["n_words"], got[2]["labels"]) == (1, 0, 2, "cc-by")
    assert got[3]["labels"] == "mit" and got[3]["base_labels"] == "" and got[3]["score"] == 1.0 and got[3]["first_word"] is None
    assert got[4]["labels"] == "" and 0 < got[4]["score"] < 0.5
    assert got[5]["n_words"] == got[6]["n_words"] == 0 and got[5]["score"] == 0
    assert got[7]["base_labels"] == "apache,gpl" and got[8]["n_base"] == 2000 and got[9]["n_base"] == 0 and got[None]["n_base"] == 1
    assert len(licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == len(rows)


def test_cover_past_many_matches():
    """Two parts of a notice with many matches between them that cannot follow the first part."""
    mit = licences.tokens(dict(licences.read_templates()[::-1])["mit"])
    scanner = licences.Scanner(licences.PHRASES, licences.read_templates(), 5, 0.5)
    ids = lambda words: licences.np.array([scanner.ids.get(w, -1) for w in words])
    t = next(i for i, (label, _) in enumerate(licences.read_templates()) if label == "mit") + len(licences.PHRASES)
    parts = [mit[:22], mit[22:44]]
    for n in (0, 63, 64, 300):
        between = [*mit[:5], "zzz"] * n
        _, covers = scanner.scan(ids([*parts[0], "zzz", *between, *parts[1]]))
        assert covers[t] == 44 / len(mit)


def plain_scan(text, phrases, templates, least, min_cover):
    """A whole row of scan_licences, by comparing word lists."""
    words = brute.ALNUM_WORDS.findall((text or "").translate(brute.LOWER))
    split = lambda x: brute.ALNUM_WORDS.findall(x.translate(brute.LOWER))
    places = [(i, label) for phrase, label in phrases.items() for i in range(len(words)) if split(phrase) and words[i : i + len(split(phrase))] == split(phrase)]
    base, labels, score = {x for _, x in places}, set(), 0.0
    anywhere = [split(x) for x in [*phrases, *(t for _, t in templates)]]
    inside = lambda x: any(t[i : i + len(x)] == x for t in anywhere for i in range(len(t)))
    longest = []  # ending at each word, in any template or phrase
    for i in range(len(words)):
        n = min(longest[-1] + 1 if longest else 1, i + 1)
        while n and not inside(words[i + 1 - n : i + 1]):
            n -= 1
        longest.append(n)
    for label, t in templates:
        t, chain = split(t), []  # (text end, template end, length, best)
        for i, n in enumerate(longest):
            if n < least or (i + 1 < len(words) and longest[i + 1] > n):
                continue
            for q in [q for q in range(n - 1, len(t)) if t[q + 1 - n : q + 1] == words[i + 1 - n : i + 1]]:
                chain.append((i, q, n, max([n, *(b + min(n, q - qq) for p, qq, _, b in chain if p < i and qq < q)])))
        cover = min(1.0, max((b for *_, b in chain), default=0) / len(t))
        score = max(score, cover)
        labels |= {label} if cover >= min_cover else set()
    at = [i for i, _ in places]
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if at else score)


def test_licences_by_force(spark):
    """Whole rows against the plain version: random texts of fragments of templates that repeat passages, one-word phrases, many fragments."""
    rng = random.Random(4)
    templates = [("x", "a b c d e f g a b c d h i j k"), ("y", " ".join(f"w{i}" for i in range(30)) + " a b c d " + " ".join(f"w{i}" for i in range(10, 20))), ("x", "k j i h a b c d e")]
    phrases = {"a b": "ab", "mit": "one", "w3 w4 w5": "ab", "b c d e": "cde"}
    texts = [None, "", "MIT", "mit-mit", "zz"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 40)):
            t = rng.choice(templates)[1].split()
            i = rng.randrange(len(t))
            parts += t[i : i + rng.randrange(1, 12)] + ["zz"] * (rng.random() < 0.3) + ["mit"] * (rng.random() < 0.1)
        texts.append(" ".join(parts))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least, cover in ((3, 0.5), (1, 0.8), (5, 0.3)):
        got = {r["doc_id"]: tuple(r)[1:] for r in licences.scan_licences(frame, phrases, templates, least, cover).collect()}
        for i, text in enumerate(texts):
            assert got[i] == plain_scan(text, phrases, templates, least, cover), (i, text)


def test_automaton_matches_by_force():
    rng = random.Random(2)
    sequences = [[rng.randrange(3) for _ in range(12)] for _ in range(4)]
    automaton = licences.SuffixAutomaton(sequences)
    text = [rng.randrange(3) for _ in range(300)]
    subs = {tuple(s[i:j]) for s in sequences for i in range(12) for j in range(i + 1, 13)}
    for k, (state, length) in enumerate(automaton.matches(text)):
        best = max((n for n in range(13) if n <= k + 1 and (n == 0 or tuple(text[k + 1 - n : k + 1]) in subs)), default=0)
        assert length == best
        want = {t: [e for e in range(length - 1, 12) if sequences[t][e + 1 - length : e + 1] == text[k + 1 - length : k + 1]] for t in range(4)}
        assert length == 0 or automaton.ends[state] == {t: e for t, e in want.items() if e}


def test_urls(spark):
    rows = [
        ("http://WWW.Example.COM/en/x?q=1", "www.example.com", "/en/x", "www.example.com/en/", "allow"), ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"), ("https://aexample.com/en/", "aexample.com", "/en/", "com/", "allow"),
        ("http://x.net/es/1#a", "x.net", "/es/1", "net/es/", "block"), ("http://com", "com", "", None, "allow"), ("http://x.org/porn", "x.org", "/porn", None, "block"), ("http://x.org/popcorn/adult", "x.org", "/popcorn/adult", None, "allow"),
        ("http://x.org/adult/SEX", "x.org", "/adult/SEX", None, "block"), ("http://x.org/adult/adult", "x.org", "/adult/adult", None, "allow"), ("no scheme porn", "", "", None, "block"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("a://?x", "", "", None, "allow"),
        ("http://ÀB.org/É", "Àb.org", "/É", None, "allow"),
    ]
    frame = spark.createDataFrame([(i, r[0], "z") for i, r in enumerate(rows)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(frame).collect()}
    assert got == {i: r[1:] for i, r in enumerate(rows)}


def test_url_vocabulary(spark, tmp_path):
    (tmp_path / "terms").write_text("# graded\n2 strict\n1.5 Heavy one\n0.5 light\n0.25 lighter\n")
    long = "http://x.org/" + "a/" * 100_000
    rows = [
        (0, "http://x.org/strict", "block", 1, 0, 2.0), (0, "http://x.org/strict", "block", 1, 0, 2.0), (None, "http://x.org/heavy one", "allow", 0, 1, 1.5),
        (1, "http://x.org/HEAVY ONE/light", "block", 0, 2, 2.0), (2, "light light light light", "allow", 0, 1, 0.5), (3, "http://x.org/heavy one-lighter", "allow", 0, 2, 1.75),
        (4, long + "strict", "block", 1, 0, 2.0), (5, long + "instrict", "allow", 0, 0, 0.0), (None, None, "allow", 0, 0, 0.0), (None, None, "allow", 0, 0, 0.0),
    ]
    frame = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    names = ["page_id", "verdict", "n_strict", "n_soft", "score"]
    want = sorted((r[0], *r[2:]) for r in rows if r[0] is not None)
    got = [tuple(r) for r in urls.judge_urls(frame, vocabulary=tmp_path / "terms").select(*names).collect()]
    assert sorted(r for r in got if r[0] is not None) == want and len(got) == len(rows)
    assert all(r[1] == "allow" for r in got if r[0] is None)
    many = {f"term{i}": 1.0 for i in range(20_000)}
    frame = spark.createDataFrame([(1, "http://x.org/term7/term19999"), (2, "http://x.org/term7/term7"), (3, "http://x.org/term70000")], "page_id long, url string")
    assert {r["page_id"]: (r["verdict"], r["n_soft"]) for r in urls.judge_urls(frame, vocabulary=many).collect()} == {1: ("block", 2), 2: ("allow", 1), 3: ("allow", 0)}
    assert urls.judge_urls(frame, vocabulary={}).where("verdict = 'allow'").count() == 3


def test_bpe_like_the_library(docs, texts):
    import base64

    import numpy as np
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    want = []
    for d, t in texts:
        ids = np.array(own.encode_ordinary(t or ""), dtype="<u4")
        want.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert corpus.as_set(encoded.drop("ids").collect()) == corpus.as_set(want)
    back = bpe.decode_documents(encoded, RANKS).collect()
    assert sorted(repr((r[0], bytes(r[1]))) for r in back) == sorted(repr((d, (t or "").encode())) for d, t in texts)


def test_chunks_meet():
    pattern = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(4)
    odd = ["  ", "\n\n ", "'re", "'r", "l", "don't", " 123", "!!", "é", "\t", "x" * 90, " " * 80, "'ll'll", "日本"]
    for k in range(60):
        text = "".join(rng.choice(odd) for _ in range(300))
        for chunk, overlap in ((50, 40), (37, 20), (200, 64)):
            assert bpe.pre_tokens(pattern, text, chunk, overlap) == pattern.findall(text)
    long = "a" * 5000 + " " + "b" * 5000
    assert bpe.pre_tokens(pattern, long, 100, 30) == pattern.findall(long)


def test_warc(spark, tmp_path):
    common.prepare(spark)
    rng = random.Random(6)
    big = "".join(rng.choice("abc é\r\n") for _ in range(5000))
    nasty = ("x" * 40 + warc.NEXT + "WARC-Type: response\r\n\r\n") * 30
    rows = [(1, "http://a/ü b", big), (2, None, big), (9, "u", big), (3, "u", nasty), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", warc.NEXT), (10, "u", "y" * 1000), (11, "u", "y" * 1000), (12, "u", "z" * 999), (13, "u", "z" * 999), (1, "http://a/ü b", big), (None, "u", big), (None, "u", "\r\n\r\n" * 300)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    best = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 1000 and i is not None:
            best[h] = max(best.get(h, 0), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        keeper = best.get(h)
        revisit = keeper is not None and keeper != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    for chunk in (64, 1 << 16):
        path = f"file://{tmp_path}/{chunk}"
        warc.write_archive(frame, path, chunk=chunk)
        assert corpus.as_set(warc.read_archive(spark, path).collect()) == corpus.as_set(want)
        assert corpus.as_set(warc.read_archive(spark, path, in_order=False).collect()) == corpus.as_set(want)
    with pytest.raises(ValueError):
        warc.parse(warc.record({"WARC-Type": "response"}, b"abc")[:-1])


def test_sharding(docs, texts):
    got = sharding.shard(docs, shards=4, fine=8, part_rows=3).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts)
    slots, homes = {}, {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        homes.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in homes.values())  # equal texts stay together


def plain_differencing(sizes, shards):
    """Loads of the shards: partitions as lists of (sum), the two of the largest spread combined in opposite order, ties by age."""
    parts = [(sorted([s] + [0] * (shards - 1)), -i) for i, s in enumerate(sizes)]
    age = len(sizes)
    while len(parts) > 1:
        parts.sort(key=lambda x: (x[0][-1] - x[0][0], x[1]))
        (a, _), (b, _) = parts.pop(), parts.pop()
        parts.append((sorted(p + q for p, q in zip(a, b[::-1])), -age))
        age += 1
    return parts[0][0]


def test_sharding_by_force(spark):
    """Whole rows: every group is an item of its own, so the shards' bytes are those of plain differencing; hot ids and texts, null ids."""
    rng = random.Random(5)
    texts = ["x" * rng.randrange(1, 4000) + str(i) for i in range(60)]
    rows = [(i, rng.choice(texts)) for i in range(150)] + [(7, texts[0])] * 40 + [(None, texts[1])] * 30 + [(None, None), (5, "é" * 50000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sharding.shard(frame, shards=5, fine=5000, part_rows=4).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(d), size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r)
    for own in shards.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert len({(r["text_crc32"], r["size"], r["shard"]) for r in got}) == len({t for _, t in rows})
    loads = Counter()
    for _, t in rows:
        loads[t] += size(t)
    want = plain_differencing(sorted(loads.values(), reverse=True), 5)
    # a partial partition's smallest sum is taken off as differencing goes on; the spreads are what it balances
    have = sorted(sum(r["size"] for r in own) for own in shards.values())
    assert sum(have) == sum(want) and have[-1] - have[0] == want[-1] - want[0]


def test_differencing():
    assert sharding.differencing([], 3) == []
    # the textbook case: 8 7 6 5 4 in two parts, 16 and 14 by differencing
    parts = sharding.differencing([8, 7, 6, 5, 4], 2)
    sums = sorted(sum(s for s, p in zip([8, 7, 6, 5, 4], parts) if p == k) for k in (0, 1))
    assert sums == [14, 16]
    rng = random.Random(8)
    sizes = [rng.randrange(1, 1000) for _ in range(600)]
    parts = sharding.differencing(sizes, 24)
    sums = [sum(s for s, p in zip(sizes, parts) if p == k) for k in range(24)]
    assert max(sums) - min(sums) <= 10


@pytest.mark.parametrize("run", [
    lambda d: simhash.link_fingerprints(d), lambda d: simhash.keep_one(d), lambda d: passages.dedup_passages(d), lambda d: repeats.dedup_bytes(d), lambda d: repeats.strip(d), lambda d: quality.judge(d), lambda d: licences.scan_licences(d),
    lambda d: bpe.encode_documents(d, RANKS, public_tokenizers.PATTERN), lambda d: sharding.shard(d), lambda d: decontaminate.flag(d, d.select(F.col("doc_id").alias("item_id"), "text"), prefix="_x_"), lambda d: urls.judge_urls(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"))),
], ids=["op3", "keep_one", "op4", "op7", "strip", "op8", "op2", "op9", "op10", "op5", "op1"])
def test_empty_tables(nothing, run):
    assert run(nothing).count() == 0


def test_empty_archive(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert not warc.read_archive(spark, path).count()


def _contexts_asked(texts):
    """Window starts that are fetched, by document, of ids 0, 1, ... and these texts."""
    import numpy as np
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], names=["a", "b"])
    blobs = [b for _, kind, b in repeats.contexts([batch], 1, 50, 20) if kind == 1]
    out = {}
    for _, kind, blob in repeats.shared_contexts(blobs, 1, 50, 4096):
        *table, step, length, _, _ = repeats.flows.unpack(blob)
        starts = repeats.flows.unsteps(step)
        for i, a, b in zip(repeats.flows.Docs.read(*table).ids.tolist(), starts.tolist(), (starts + length.astype(np.int64)).tolist()):
            assert kind == 3 and a <= b
            out.setdefault(i, set()).update(range(a, b + 1))
    return out


def test_phrases_shared_by_chance_are_not_fetched():
    """A phrase of 30 bytes in many documents is no reason to fetch what stands around it; a passage of 50 bytes and more goes wherever it stands."""
    import numpy as np

    rng = np.random.default_rng(17)
    letters = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    asked = [_contexts_asked([letters(300) + phrase + letters(300) for _ in range(40)]) for phrase in (letters(30) for _ in range(20))]
    assert sum(map(len, asked)) <= 8  # of 800; hashes of 16 bits may clash
    for n in (50, 51, 64, 65, 66, 80, 200):
        phrase, at = letters(n), [int(x) for x in rng.integers(0, 300, 4)]
        at[0] = 0
        texts = [letters(a) + phrase + letters(b) for a, b in zip(at, [100, 0, 3, 40])]
        gone = removed_by_steps([([i], [np.frombuffer(x, dtype=np.uint8)]) for i, x in enumerate(texts)], 4096)
        assert 0 not in gone and all(set(range(a, a + n)) <= gone[i] and len(gone[i]) < n + 6 for i, a in enumerate(at) if i)


def test_names_of_documents_without_hashes(spark):
    """Where every row has a doc_id of its own, no hashes travel, and the results are those of rows named by both."""
    common.prepare(spark)
    rng = random.Random(23)
    shared = [corpus.sentence(rng, 40) for _ in range(5)]
    rows = [(i * 7 - 60, " ".join([corpus.sentence(rng, 20), shared[i % 5], corpus.sentence(rng, 20)])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeats.flows.named_by_id(df) and repeats.removed(df)[2]
    more = df.unionByName(spark.createDataFrame([(None, "x"), (None, "y")], "doc_id long, text string"))
    assert not repeats.flows.named_by_id(more) and not repeats.flows.named_by_id(df.unionByName(df.limit(1)))
    assert corpus.as_set(repeats.dedup_bytes(df).collect()) == corpus.as_set(repeats.dedup_bytes(more).where("doc_id IS NOT NULL").collect())


def test_links_of_a_crowd_are_a_forest():
    """Of members that are alike in pairs by the hundred, fewer links come than there are members; the components are those of all similar pairs, and sets that
    are not similar are not linked."""
    import numpy as np

    rng = np.random.default_rng(29)
    for m, changed in ((80, 16), (80, 30)):
        base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
        sets = []
        for _ in range(m):
            x = base.copy()
            x[rng.choice(300, changed, replace=False)] = rng.integers(0, 1 << 62, changed)
            sets.append(np.unique((x & np.uint64(0xFFFFFFFF)).astype(np.uint32)).tobytes())
        nodes, s = rng.permutation(m) - m // 2, np.zeros((m, 32), dtype=np.uint16)  # all within budget
        links = [p for u, v in simhash.ring_rest(nodes, s, np.arange(m), sets=sets) for p in zip(u.tolist(), v.tolist())]
        place = {int(x): i for i, x in enumerate(nodes)}
        similar = [(i, j) for i in range(m) for j in range(i) if simhash.jaccard(sets[i], sets[j]) >= 0.8]
        assert len(links) < m and len(similar) in (0, m * (m - 1) // 2) or len(links) < len(similar)
        one = lambda pairs: simhash.labels_of(m, *(np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))).tolist()
        assert one([(place[u], place[v]) for u, v in links]) == one(similar)
