"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition over counts of a text. On a bounded sample the cascade measures how much each rule rejects and what it costs, and then asks the
rules in descending order of rejection per cost: a CASE expression inside one lambda over the words, which are split once; a later
branch, and what it counts, is worked out only for rows that all earlier ones let pass. The cost is counted, not timed, so that it is the same in every
run: characters, lines and words of the sample that a rule goes through, each at its weight (UNIT_COST). The order decides the cost and
which rule is named first; whether a document is kept does not depend on it.

Defined results: a null or empty text has no words and fails `few_words`; a very long text is judged whole; repeated rows are judged alike, each; an
empty table gives an empty result; other columns pass through `judge` and `keep`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import common

#: Rows of the sample on which costs and selectivities are measured, and its share of the table.
SAMPLE_ROWS, SAMPLE_SHARE = 200, 0.05
BLANK = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"


def _text(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def word_list(text: str = "text") -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(F.btrim(_text(text), F.lit(BLANK)), r"[\x20\x09-\x0D]+"), "")


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of `width` words which the list holds more than once (the first time counts too)."""

    def of_windows(windows: Column) -> Column:  # most texts repeat no window: nothing is sorted for them
        keys = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_let(F.sort_array(keys), covered))

    def covered(keys: Column) -> Column:
        n = F.size(keys)
        twice = F.filter(
            keys,
            lambda x, j: ((j > 0) & (F.get(keys, j - 1)["h"] == x["h"])) | ((j + 1 < n) & (F.get(keys, j + 1)["h"] == x["h"])),
        )
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        # each window adds the words that no window before it covers
        return F.aggregate(
            at,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last")),
            lambda s, i: F.struct((s["n"] + F.least(F.lit(width), i - s["last"])).cast("long").alias("n"), i.alias("last")),
            lambda s: s["n"],
        )

    first = F.slice(words, 1, F.greatest(F.size(words) - (width - 1), F.lit(0)))
    windows = F.transform(first, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, width))))
    return _let(windows, of_windows)


def _counts(value: Column, words: Column) -> dict[str, Column]:
    lines = F.filter(F.split(value, "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(value, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (each after the prefix)."""
    words = f"{prefix}words"
    counts = _counts(_text(text), F.col(words))
    return docs.withColumn(words, word_list(text)).withColumns({f"{prefix}{k}": v for k, v in counts.items()}).drop(words)


def rules(counts: Mapping[str, Column] | None = None) -> dict[str, Column]:
    """name: what rejects, over the counts (columns of these names). The first two are the base rules."""
    c = counts or {k: F.col(k) for k in COUNTS}
    n = c["n_words"]
    return {
        "few_words": n < 50,
        "repeated_words": c["n_repeat_words"] * 100 > n * 50,
        "word_length": (c["word_chars"] < n * 2) | (c["word_chars"] > n * 15),
        "symbols": c["n_symbols"] * 10 > n,
        "duplicate_lines": c["n_dup_lines"] * 10 > n,
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("few_words", "repeated_words", "word_length", "symbols", "duplicate_lines")
BASE = RULES[:2]
#: Cost of a rule in nanoseconds for each (character, line, word, word times log2 of words) of a text, beside the split that all share.
UNIT_COST = {"few_words": (0, 0, 0, 0), "repeated_words": (0, 0, 400, 20), "word_length": (0, 0, 100, 0), "symbols": (5, 0, 0, 0), "duplicate_lines": (5, 200, 0, 0)}


def order_rules(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS, share: float = SAMPLE_SHARE) -> list[str]:
    """Rule names by rejection per cost, best first; ties, and an empty sample, in the order of RULES. Numbers of at most `rows` texts reach the
    driver, no text does."""

    def sampled(few: DataFrame) -> list:
        counted = with_counts(few).select(
            *(F.coalesce(condition, F.lit(False)).cast("int").alias(name) for name, condition in rules().items()),
            F.length("text").alias("_chars"), F.regexp_count("text", F.lit("\n")).alias("_lines"), F.col("n_words").alias("_words"),
            (F.col("n_words") * F.log2(F.col("n_words") + 1)).alias("_sort"),
        )
        return counted.limit(rows).collect()

    few = docs.select(_text(text).alias("text"))
    sample = sampled(few.sample(withReplacement=False, fraction=share, seed=7)) or sampled(few)
    units = [sum(x[u] for x in sample) for u in ("_chars", "_lines", "_words", "_sort")]
    cost = {name: 1 + sum(w * u for w, u in zip(UNIT_COST[name], units)) for name in RULES}
    return sorted(RULES, key=lambda name: -sum(x[name] for x in sample) / cost[name])


def cascade(order: list[str], conditions: Mapping[str, Column]) -> Column:
    """The first rule of the order that rejects a row, else null."""
    out = F.when(conditions[order[0]], F.lit(order[0]))
    for name in order[1:]:
        out = out.when(conditions[name], F.lit(name))
    return out


def rejected_by(order: list[str], text: str = "text") -> Column:
    """cascade() over a text. The words are a variable of a lambda, so whatever Spark does with the expression they are split once, and it evaluates
    the branches one by one."""
    value = _text(text)
    return _let(word_list(text), lambda words: cascade(order, rules(_counts(value, words))))


def judge(docs: DataFrame, text: str = "text", order: list[str] | None = None, name: str = "_rejected_by") -> DataFrame:
    """All columns of docs, and the first rule of the cascade that rejects the row, null for a row that is kept (a column of this name, after
    common.free_prefix where docs has one)."""
    name = common.free_prefix(docs.columns, "", [name]) + name
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns), rejected_by(order or order_rules(docs, text), text).alias(name))


def keep(docs: DataFrame, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """The rows of docs, all columns, that no rule rejects."""
    return docs.where(rejected_by(order or order_rules(docs, text), text).isNull())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    order, counted, asked = order_rules(docs), with_counts(common.with_key(docs)), rules()
    base = F.lit(False)
    for name in BASE:
        base = base | asked[name]
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), cascade(order, asked).isNull().alias("kept"),
    )


def oracle_sql() -> str:
    return r"""
    WITH a AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    b AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM a),
    g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM b WHERE len(w) > 3),
    k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM g),
    r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY rid),
    l AS (SELECT rid, count(*) - count(DISTINCT x) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM b)
          WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
    c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                 (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                 coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
          FROM b LEFT JOIN l USING (rid) LEFT JOIN r USING (rid))
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
                OR 10 * n_symbols > n_words OR 10 * n_dup_lines > n_words) AS kept FROM c"""
