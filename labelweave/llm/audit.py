"""Filter interaction audit: what five filters remove, alone and in every order, by part of the corpus.

A relational word pipeline. Texts are exploded into words, counted by (document, word), and these counts by document give its words and distinct words. Flags of
capitals and symbols come from the row itself, the flag of copies from the smallest doc_id of each text's digest, and labels from their own table; outer joins bring
all to the document, whose five flags make a number from 0 to 31 (its mask). One aggregation by part with 32 conditional counts (and as many for good
and for toxic documents) then answers every order of the filters: a filter removes the masks that have its bit and none of the earlier filters' bits.

Plans: a document is named by (doc_id, hash of its text). Texts are dealt by document before they are exploded: that shuffles the input once, and both
counts, by (document, word) and by document, find their rows where they are. The task that read a row is part of its key, so a row that is repeated without
end (one without a doc_id, say) is dealt to as many tasks as read it; its counts meet afterwards, a row a task. The copy that stays is found by an equi-join on the document, not on the digest: thousands of copies of
a text share no key. Part counts are pre-aggregated, so a hot part costs one row a task.

Defined results: a null text is an empty one, without words; a null source is the part of the empty name; a row without a doc_id is never
a copy (nothing is smaller) and has no label, but is counted; repeated rows are counted each, and are no copies of one another, for no id is smaller; of
several labels of a doc_id any that says so counts; parts without failures have rows of zeros; an empty table has no parts, so no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The filters, in the order of their bits: fewer words, few distinct words, capitals, symbols, copies.
FILTERS = "ABCDE"
FEW_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOL = 200, 50, 2, r"[#$%&*|]"
MASKS = range(1 << len(FILTERS))
KINDS = ("all", "good", "toxic")


def _documents(docs: DataFrame, part: str, text: str) -> DataFrame:
    """(d, h, doc_id, part, text): d and h name the document. d is the doc_id; where that is missing, another hash of the text."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        F.coalesce(doc_id, F.xxhash64(body, F.lit("no id"))).alias("d"), F.xxhash64(body).alias("h"), doc_id.alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("text"),
    )


def word_counts(documents: DataFrame) -> DataFrame:
    """(d, h, n_words, n_distinct). A null stands beside each text's words, so that it is counted how often the row is there."""
    dealt = documents.select("d", "h", F.spark_partition_id().alias("task"), "text").repartition("d", "h", "task")
    found = F.array_append(F.split("text", r"[\x20\x09-\x0D]+"), F.lit(None).cast("string"))
    exploded = dealt.select("d", "h", "task", F.explode(found).alias("word")).where("word IS NULL OR word <> ''")
    by_word = exploded.groupBy("d", "h", "task", "word").agg(F.count("*").alias("n"))
    rows = F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("rows")
    total = F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0)).alias("total")
    by_task = by_word.groupBy("d", "h", "task").agg(rows, total, F.count("word").alias("n_distinct"))
    return by_task.groupBy("d", "h").agg((F.sum("total") / F.sum("rows")).cast("long").alias("n_words"), F.max("n_distinct").alias("n_distinct"))


def flags(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, part, mask, good, toxic), a row for each of docs; bit i of the mask: it fails filter i."""
    documents = _documents(docs, part, text)
    value = F.col("text")
    own = documents.select(
        "d", "h", "doc_id", "part", F.unhex(F.sha2(value, 256)).alias("digest"), value.rlike(SYMBOL).alias("symbols"),
        (F.length(F.regexp_replace(value, "[^A-Z]+", "")) * 100 > F.length(value) * CAPITAL_PERCENT).alias("capitals"),
    )
    # the row that stays, of each text; who is not one of these, is a copy
    first = own.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("d").alias("d"), F.min("h").alias("h")).select("d", "h", F.lit(True).alias("is_first"))
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    found = own.drop("digest").join(word_counts(documents), ["d", "h"], "left").join(first, ["d", "h"], "left").join(marked, "doc_id", "left")
    n = F.coalesce("n_words", F.lit(0))
    failed = {
        "A": n < FEW_WORDS,
        "B": F.coalesce("n_distinct", F.lit(0)) * 100 < n * DISTINCT_PERCENT,
        "C": F.col("capitals"),
        "D": F.col("symbols"),
        "E": F.col("doc_id").isNotNull() & F.col("is_first").isNull(),
    }
    mask = sum((failed[f].cast("int") * (1 << i) for i, f in enumerate(FILTERS)), F.lit(0))
    return found.select("doc_id", "part", mask.alias("mask"), *(F.coalesce(k, F.lit(False)).alias(k) for k in KINDS[1:]))


def mask_counts(flagged: DataFrame) -> DataFrame:
    """(part, all, good, toxic): of each kind the 32 counts by mask, as an array."""
    kind = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counted = flagged.groupBy("part").agg(*(F.count_if((F.col("mask") == m) & kind[k]).alias(f"{k}_{m}") for k in KINDS for m in MASKS))
    return counted.select("part", *(F.array(*(f"{k}_{m}" for m in MASKS)).alias(k) for k in KINDS))


def orders() -> list[str]:
    """Every order of the filters."""
    return ["".join(x) for x in permutations(FILTERS)]


def _bit(letter: Column) -> Column:
    return F.pow(F.lit(2), F.instr(F.lit(FILTERS), letter) - 1).cast("int")


def _total(counts: str, chosen, weight=None) -> Column:
    """Sum of the counts whose mask is chosen, each times its weight."""
    picked = F.transform(counts, lambda n, m: F.when(chosen(m), n * (weight(m) if weight else 1)).otherwise(0))
    return F.aggregate(picked, F.lit(0).cast("long"), lambda a, b: a + b)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text") -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, and shapley (what the step's filter removes, over all orders)."""
    rows = mask_counts(flags(docs, labels, part, text)).select("*", F.explode(F.split(F.lit(" ".join(orders())), " ")).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letter = lambda i: F.substring("filter_order", i, 1)
    own = sum((F.when(F.col("step") == i, _bit(letter(i))).otherwise(0) for i in range(1, len(FILTERS) + 1)), F.lit(0))
    earlier = sum((F.when(F.col("step") > i, _bit(letter(i))).otherwise(0) for i in range(1, len(FILTERS))), F.lit(0))
    rows = rows.select("*", own.alias("bit"), earlier.alias("before"))
    before, bit = F.col("before"), F.col("bit")
    fails = lambda m: m.bitwiseAND(bit) != 0
    met = lambda m: m.bitwiseAND(before) != 0
    return rows.select(
        "part", "filter_order", "step",
        _total("all", lambda m: ~fails(m) & ~met(m)).alias("kept"), _total("all", lambda m: fails(m) & ~met(m)).alias("removed"),
        _total("all", lambda m: fails(m) & met(m)).alias("redundant"), _total("all", lambda m: m == bit).alias("unique_fails"),
        _total("good", lambda m: fails(m) & ~met(m)).alias("good_lost"), _total("toxic", lambda m: fails(m) & ~met(m)).alias("toxic_lost"),
        # a document that k filters would remove is removed by each of them in one k-th of all orders
        _total("all", fails, lambda m: (F.lit(len(orders())) / F.bit_count(m)).cast("long")).alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def oracle_sql() -> str:
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    steps = ", ".join(f"('{o}', {s}, {sum(bit[f] for f in o[: s - 1])}, {bit[o[s - 1]]})" for o in orders() for s in range(1, 6))
    return rf"""
    WITH a AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM a),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                 (len(words) < 200)::INT * {bit["A"]} + (100 * len(list_distinct(words)) < 50 * len(words))::INT * {bit["B"]}
                 + (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT * {bit["C"]}
                 + regexp_matches(t, '[#$%&*|]')::INT * {bit["D"]} + coalesce(doc_id > first, false)::INT * {bit["E"]} AS mask
          FROM w LEFT JOIN l USING (doc_id)),
    c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY ALL),
    s AS (SELECT * FROM (VALUES {steps}) AS v(filter_order, step, before, bit))
    SELECT part, filter_order, step::INT AS step,
           coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
           coalesce(sum(g) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
           coalesce(sum(x) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
           coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit > 0), 0)::BIGINT AS shapley
    FROM c, s GROUP BY part, filter_order, step, before, bit"""
