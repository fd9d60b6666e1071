"""A small corpus with copies, near copies, shared passages, odd texts, missing values, repeated rows and clashing columns."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau über çedille naïve ñandú straße".split()
SCHEMA = "doc_id long, text string, lang string, key long, dest int, payload string, node long, words string, n_words long, kept string, _text string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "a", "os", "en"]) + str(rng.randrange(40)) for _ in range(n))


def rows(seed=0):
    rng = random.Random(seed)
    passage = sentence(rng, 70)
    base = [sentence(rng, rng.randrange(60, 160)) for _ in range(14)]
    out = list(base)
    out += [base[0], base[0], base[1].upper(), base[2].replace(" ", "  \n\t")]  # copies, and copies but for case or space
    for k in range(6):  # near copies: one word differs
        words = base[3].split()
        words[5 + 9 * k] = f"edit{k}"
        out.append(" ".join(words))
    out += [f"{sentence(rng, 30)} {passage} {sentence(rng, 30)}" for _ in range(5)]  # a shared passage
    out += [passage, passage[7:200], "line one two three\n" * 30, "x" * 3000, "ab" * 2000, "", " \n\t", "one", "one two", None, "é" * 60, "日本語テキスト " * 20]
    out.append(sentence(rng, 3000) + " " + base[4] + " " + passage)
    texts = [(i * 3 + 1 + (i % 7 == 6) * (1 << 62) - (i % 11 == 9) * (1 << 40), t) for i, t in enumerate(out)]  # ids near the ends, too
    rng.shuffle(texts)
    texts += [texts[0], texts[0]]  # rows repeated whole
    texts += [(None, base[5]), (None, sentence(rng, 60)), (None, None), (texts[3][0], sentence(rng, 80))]  # no id; an id with two texts
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", 1, 2, "p", 3, "w", 4, "k", "t") for i, t in texts], SCHEMA).repartition(3)


def as_set(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))
