"""op11 to op13 against plain versions, on odd inputs."""

import hashlib
import math
import random
import re
from itertools import permutations

import corpus
import numpy as np
import public_tokenizers
import pytest

from labelweave.llm import audit, chat, common, whitening

# --- op11


def plain_audit(rows, labels):
    """rows: (doc_id, text, source)."""
    first, good, toxic = {}, {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    flagged = []
    for d, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {
            f for f, bad in {
                "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t],
            }.items() if bad
        }
        flagged.append((s or "", failed, d is not None and d in good, d is not None and d in toxic))
    out = []
    for part in {x[0] for x in flagged}:
        own = [x for x in flagged if x[0] == part]
        removed = {}
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                now = [x for x in own if f in x[1] and not x[1] & set(order[:k])]
                removed["".join(order), k + 1] = now
        for (order, step), now in removed.items():
            f = order[step - 1]
            out.append((
                part, order, step, sum(not x[1] & set(order[:step]) for x in own), len(now), sum(f in x[1] and bool(x[1] & set(order[: step - 1])) for x in own), sum(x[1] == {f} for x in own),
                sum(x[2] for x in now), sum(x[3] for x in now), sum(len(v) for (o, s), v in removed.items() if o[s - 1] == f),
            ))
    return out


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, s, 1, True, 7, "w") for d, t, s in rows], "doc_id long, text string, source string, part int, toxic boolean, mask int, word string").repartition(3)
    marks = spark.createDataFrame([(*x, 3) for x in labels], "doc_id long, quality int, toxic int, h int")
    return corpus.as_set(audit.audit(docs, marks).select(*AUDIT).collect())


def test_audit(spark):
    rng = random.Random(4)
    sources = ["hot", "hot", "hot", "a", None, ""]
    rows = [(d, t, rng.choice(sources)) for d, t in corpus.rows(2)]
    many = " ".join(f"w{k}" for k in range(250))
    rows += [(10**6 + k, many if k % 3 else many.upper() + "|", "hot") for k in range(12)]  # copies in a hot part
    rows += [(-(1 << 63), many, "a"), ((1 << 63) - 1, many, "a"), (5_000, "w " * 300, "a"), (5_000, "w " * 300, "a"), (5_000, "w " * 300, "hot"), (None, "w " * 300, "hot")]
    ids = [d for d, _, _ in rows if d is not None]
    labels = [(d, rng.randrange(2), rng.randrange(2)) for d in ids[::2]] + [(ids[0], 1, None), (ids[2], None, 1), (None, 1, 1), (77, 1, 1)]
    assert audited(spark, rows, labels) == corpus.as_set(plain_audit(rows, labels))


def test_audit_empty(spark):
    assert audited(spark, [], [(1, 1, 1)]) == []
    assert audited(spark, [(None, None, None)], []) == corpus.as_set(plain_audit([(None, None, None)], []))


# --- op12


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], f"vec_id long, embedding array<{kind}>, n int, whitened double").repartition(3)


def plain_whiten(rows, k):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    apart = n * x - s
    centred = (apart / n).astype(float)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return n, [sum(int(a) ** 2 for a in r) for r in apart], centred @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def fitted(spark, rows, k=8, kind="float"):
    df = vectors(spark, rows, kind)
    model = whitening.fit(df, components=k)
    got = {r["vec_id"]: r for r in whitening.transform(df, model).collect()}
    return model, got, whitening.identity_error(df, model)


@pytest.mark.parametrize("n, dim, k", [(900, 12, 8), (40, 3, 8), (7, 16, 4)])
def test_whitening(spark, n, dim, k):
    common.prepare(spark)
    rng = np.random.default_rng(n)
    base = (rng.normal(size=(n, dim)) * np.linspace(1, 0.1, dim)).astype(np.float32)
    rows = [(i * 5 - 40, v.tolist()) for i, v in enumerate(base)]
    odd = [(10_001, None), (10_002, [None] + rows[0][1][1:]), (10_003, [math.nan] + rows[0][1][1:]), (10_004, [math.inf] + rows[0][1][1:]), (10_005, [1.0]), (10_006, [])]
    model, got, error = fitted(spark, rows + odd, k)
    count, deviation, white, explained = plain_whiten(rows, k)
    assert model.n == count and set(got) == {i for i, _ in rows} and error < 1e-9
    assert [got[i]["deviation"] for i, _ in rows] == deviation
    mine = np.array([got[i]["whitened"] for i, _ in rows])
    signs = np.sign((mine * white).sum(axis=0))
    assert mine.shape[1] == min(k, dim)
    assert np.allclose(mine * signs, white, atol=1e-8) and np.allclose(model.explained, explained, rtol=1e-9)


def test_whitening_of_flat_and_large(spark):
    common.prepare(spark)
    model, got, error = fitted(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0]), (None, [2.0, 3.0])])  # no variance at all
    assert error is None and set(got) == {1, 2, None} and got[1]["whitened"] == [None, None] and got[1]["deviation"] == 0 and list(model.explained) == [0, 0]
    model, got, error = fitted(spark, [(k, [float(k % 3), 1.0]) for k in range(9)])  # one component with variance
    assert error < 1e-9 and got[0]["whitened"][1] is None and abs(model.explained[0] - 1) < 1e-12
    rows = [(k, [(-1.0) ** k * 1e15 / (k + 1), 1e12 * k, 0.5 * k]) for k in range(20)]  # sums and squares above a long
    model, got, error = fitted(spark, rows, 2, "double")
    _, deviation, white, _ = plain_whiten(rows, 2)
    mine = np.array([got[k]["whitened"] for k in range(20)])
    assert [got[k]["deviation"] for k in range(20)] == [d if d < 1 << 63 else None for d in deviation]
    assert np.allclose(np.abs(mine), np.abs(white), atol=1e-6) and error < 1e-9
    assert whitening.fit(vectors(spark, [])) is None and whitening.fit(vectors(spark, [(1, None), (2, [])])) is None


def test_whitening_query(spark, sf_dir):
    from labelweave.llm import queries

    got = queries.queries()["op12_embedding_whitening"](spark, sf_dir).toPandas()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    n, deviation, white, explained = plain_whiten(rows, 8)
    assert len(got) == 8 * n and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    got = got.set_index(["vec_id", "component"]).sort_index()
    for c in range(1, 9):
        mine = got.xs(c, level="component").loc[[i for i, _ in rows]]
        assert mine["deviation"].tolist() == deviation and np.allclose(mine["explained"], explained[c - 1], rtol=1e-9)
        assert np.allclose(np.abs(mine["whitened"]), np.abs(white[:, c - 1]), atol=1e-7)


# --- op13

TEXTS = ["", "plain", "<turn>", "</turn>", "a <says> b", "\\", "\\\\<turn>", "<\\turn>", "<", "turn>", "</turn", "  spaces \n\n", "ends in <", "é日本🤦🏼‍♂️", "###", "\\### Assistant: </turn> ok", "<<turn>>", "\n", "x" * 500, "<|endoftext|>"]


def test_escapes():
    t = chat.Template()
    for a in TEXTS:
        for b in ["", *TEXTS]:
            held = t.escape(a + b)
            assert t.unescape(held) == a + b and not any(c in held + t.closes[:-1] for c in t.controls)
    with pytest.raises(ValueError):
        chat.Template("<turn>", "says", "</turn>")


def test_covered():
    offsets = np.array([0, 2, 5, 5, 9, 12])
    assert chat.covered(offsets, np.array([[2, 9]])).tolist() == [False, True, True, True, False]
    assert chat.covered(offsets, np.array([[1, 6], [9, 12]])).tolist() == [False, True, True, False, True]  # tokens that cross an end stay out
    assert chat.covered(offsets, np.zeros((0, 2), dtype=np.int64)).tolist() == [False] * 5


def plain_chat(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(f"{role}\n{text}\n" for *_, role, text in own)
        learnt = "".join(text for *_, role, text in own if role == "assistant")
        size = sum(19 + len(x) + x.count("\\") + len(re.findall("<turn>|<says>|</turn>", x)) for *_, role, text in own for x in (role, text))
        size -= 19 * len(own)
        out.append((conv, len(own), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), size))
    return out


def test_chat(spark, monkeypatch):
    common.prepare(spark)
    rng = random.Random(3)
    roles = ["user", "assistant", "assistant", "system", None, "", "<says>", "a\\b"]
    rows = [(rng.choice([1, 2, 2, 2, 3, None, -(1 << 63), (1 << 63) - 1]), rng.choice([None, 0, 1, 2, 5, 600, 1300, -3, -(1 << 63)]), rng.choice(roles), rng.choice([*TEXTS, None])) for _ in range(300)]
    rows += rows[:5] + [(9, k, roles[k % 2], f"turn {k} <turn> \\ " * 3) for k in range(1500)]
    rows.append((10, 0, "assistant", "word </turn> " * 150_000))  # longer than a piece
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, block int").repartition(4)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    formatted = chat.format_conversations(df, ranks, public_tokenizers.PATTERN)
    assert formatted.where("conv_id = 9").count() == 3 and formatted.where("conv_id = 10").count() == 1
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert corpus.as_set(chat.digests(formatted, ranks, public_tokenizers.PATTERN).select(*names).collect()) == corpus.as_set(plain_chat(rows))
    assert chat.digests(chat.format_conversations(df.limit(0), ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN).count() == 0


def test_pieces_encode_as_the_whole():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        codec = chat.ChatCodec(f.read(), public_tokenizers.PATTERN, chat.Template())
    turns = [("user" if k % 2 else "assistant", x) for k, x in enumerate(TEXTS)]
    whole, spans = chat.render(turns, codec.template)
    ids, offsets = codec.encode(whole)
    parts = [codec.encode(chat.render([t], codec.template)[0])[0] for t in turns]
    assert np.array_equal(ids, np.concatenate(parts)) and codec.decode(ids) == whole.encode()
    back, learnt = chat.read_back(codec, ids, chat.covered(offsets, spans))
    assert back == turns and "".join(learnt) == "".join(t for r, t in turns if r == "assistant")
