"""URL filters: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

A term counts where no letter or digit of a-z0-9 stands directly before or after it in the lower-cased URL. One
strict term (a weight of `threshold` or more) rejects, and so do distinct soft terms whose weights reach `threshold` together.
The vocabulary is url_terms.txt beside this module (lines of weight and term), another such file, or a mapping; one walk over
the URL finds all terms, however many there are.

Defined results: a null URL has an empty host and path and is allowed; one without "://" has them empty too, and its terms count; a very long
URL is walked whole; a null key is kept; an empty table gives an empty result; repeated rows are judged alike, each; other columns of the table are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import common

#: verdict, host and its subdomains, start of the path
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
TERM_FILE = Path(__file__).with_name("url_terms.txt")
THRESHOLD = 2.0
SCHEMA = "host string, path string, rule string, verdict string, n_strict long, n_soft long, score double"
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return lower(host), rest[:end]


def lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def read_vocabulary(path: str | Path = TERM_FILE) -> dict[str, float]:
    """term: weight, from lines of weight and term; the last of a term's lines counts."""
    lines = Path(path).read_text(encoding="utf-8").splitlines()
    return {term.strip(): float(weight) for weight, _, term in (x.strip().partition(" ") for x in lines if x.strip() and x[0] != "#")}


def automaton(vocabulary: Mapping[str, float]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in vocabulary.items():
        found.add_word(lower(term), (lower(term), weight))
    if vocabulary:
        found.make_automaton()
    return found


def hits(terms: ahocorasick.Automaton, url: str) -> dict[str, float]:
    """The distinct terms that stand between boundaries, with their weights."""
    if not len(terms):
        return {}
    found, n = {}, len(url)
    for end, (term, weight) in terms.iter(url):
        start = end + 1 - len(term)
        if (not start or url[start - 1] not in _ALNUM) and (end + 1 == n or url[end + 1] not in _ALNUM):
            found[term] = weight
    return found


def judge_urls(
    df: DataFrame,
    key: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    vocabulary: Mapping[str, float] | str | Path = TERM_FILE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of df: its key, host, path, the rule that fits (longest wins, then the first named), the
    verdict (the rule's, else the vocabulary's), the numbers of distinct strict and soft terms and the sum of their weights."""
    vocabulary = dict(vocabulary) if isinstance(vocabulary, Mapping) else read_vocabulary(vocabulary)
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in rules:
        by_host.setdefault(host, []).append((path, verdict))

    def rule_of(host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        while host:  # the host, then each domain above it
            for start, verdict in by_host.get(host, ()):
                if path.startswith(start) and (best[0] is None or len(host + start) > len(best[0])):
                    best = (host + start, verdict)
            host = host.partition(".")[2]
        return best

    def run(batches):
        terms = automaton(vocabulary)
        for batch in batches:
            rows = []
            for x in batch.column(1).to_pylist():
                host, path = split_url(x)
                rule, verdict = rule_of(host, path)
                found = hits(terms, lower(x or ""))
                strict = sum(w >= threshold for w in found.values())
                score = math.fsum(found.values())
                if verdict is None:
                    verdict = "block" if strict or score >= threshold else "allow"
                rows.append((host, path, rule, verdict, strict, len(found) - strict, score))
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.float64()]
            names = [key, "host", "path", "rule", "verdict", "n_strict", "n_soft", "score"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return common.arrow(df.select(F.col(key).cast("long"), F.col(url).cast("string")), run, f"{key} long, {SCHEMA}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sum(weights: Mapping[str, float], value: str) -> str:
    """SQL that sums a value ({w}: the weight) over the terms found; the terms hold no special characters of patterns."""
    found = (f"CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN {value.format(w=w)} ELSE 0 END" for t, w in weights.items())
    return " + ".join(found)


def oracle_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    weights = read_vocabulary()
    strict, soft = ({t: w for t, w in weights.items() if (w >= THRESHOLD) == x} for x in (True, False))
    return f"""
    WITH r(v, h, p) AS (VALUES {rules}),
    a AS (SELECT page_id, url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
                 CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
                 coalesce(url, '') LIKE '%://%' AS ok FROM pages),
    b AS (SELECT page_id, u, ok, CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*') ELSE '' END AS raw, rest FROM a),
    c AS (SELECT page_id, u, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 CASE WHEN ok THEN regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') ELSE '' END AS path,
                 ({_sum(strict, "1")})::BIGINT AS n_strict, ({_sum(soft, "1")})::BIGINT AS n_soft,
                 ({_sum(weights, "{w}::DOUBLE")})::DOUBLE AS score FROM b),
    d AS (SELECT c.*, (SELECT max_by(struct_pack(rule := r.h || r.p, v := r.v), length(r.h || r.p)) FROM r
                       WHERE (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p)) AS best FROM c)
    SELECT page_id, host, path, best.rule AS rule,
           coalesce(best.v, CASE WHEN n_strict > 0 OR score >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
           n_strict, n_soft, score FROM d"""
