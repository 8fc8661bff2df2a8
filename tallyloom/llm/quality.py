"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

# Frequent function words of the languages that are kept.
STOP_WORDS = {
    "en": "the of and to in is that for it with as was on are by this",
    "de": "der die und in den das von zu ist mit nicht auf im ein eine dem",
    "fr": "de la le et les des en un une du que est pour dans par qui",
    "es": "de la que el en y los del se las por un para con una su",
}


class Rule(NamedTuple):
    """A text passes if low <= numerator / denominator <= high; a ratio over 0 passes."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 3.0, 10.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.1),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 0.05, 1.0),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.0, 0.4),
)
#: Word counts and repeated words under which a text fails whatever the rules say.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the measures of its texts: n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_stop_words, n_repeat_words (all long).

    Three projections in a row: words and lines, sorted three-word windows, counts. A window is
    known by a 64-bit hash; equal neighbours in the sorted list are the windows found twice or more.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    stop = F.array(*[F.lit(w) for w in sorted({w for v in STOP_WORDS.values() for w in v.split()})])
    own = [c for c in df.columns if c not in MEASURES]
    # The caller's columns travel as one structure, so that names of their own can't clash with those made here.
    split = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row") if own else F.lit(None).alias("__row"), text.alias("__text")).withColumns({
        "__words": F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)),
        "__lines": F.filter(F.split("__text", "\n"), lambda x: x.rlike(WORD)),
        "__symbols": F.regexp_count("__text", F.lit(SYMBOL)),
        "__spaces": F.regexp_count("__text", F.lit(r"[\x20\x09-\x0D]")),
        "__length": F.length("__text"),
    })
    n = F.size("__words")
    word = lambda i: F.col("__words")[i]
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(word(i), word(i + 1), word(i + 2)).alias("h"), i.alias("i")))
    sorted_ = split.withColumn("__windows", F.when(n >= 3, F.sort_array(windows)))
    at = lambda j: F.get("__windows", j)["h"]
    twice = F.filter("__windows", lambda x, j: F.coalesce(x["h"] == at(j - 1), F.lit(False)) | F.coalesce(x["h"] == at(j + 1), F.lit(False)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    # Generated from one structure a row: a filter on a measure can't be moved below, where it would be
    # computed with all that it is made of, once for each window.
    found = {
        "n_words": n,
        "word_chars": F.col("__length") - F.col("__spaces"),
        "n_symbols": F.col("__symbols"),
        "n_lines": F.size("__lines"),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_stop_words": F.size(F.filter(F.transform("__words", F.lower), lambda w: F.array_contains(stop, w))),
        "n_repeat_words": F.when(n >= 3, covered).otherwise(0),
    }
    row = F.struct(*[v.cast("long").alias(k) for k, v in found.items()])
    return sorted_.select("__row", F.explode(F.array(row)).alias("__found")).select(*[F.col("__row").getField(c).alias(c) for c in own], "__found.*")


def passes(rule: Rule) -> Column:
    top, bottom = F.col(rule.numerator), F.col(rule.denominator)
    return (bottom == 0) | ((top >= F.lit(rule.low) * bottom) & (top <= F.lit(rule.high) * bottom))


def quality_rules(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``df`` with its measures, base_failed, failed_rules (names, in the table's order) and kept.

    base_failed: under 50 words, or more than half of the words lie in repeated three-word windows.
    kept: not base_failed and every rule passes.

    Defined cases: a null text counts as an empty one, which is base_failed; a ratio over zero
    passes; windows of texts under three words are none; every row is judged alone, so repeated
    rows get equal verdicts; an empty table gives no rows. Columns of ``df`` with the name of a
    measure are replaced.
    """
    failed = F.filter(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules]) if rules else F.array().cast("array<string>"), lambda x: x.isNotNull())
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    out = measures(df, text_col).withColumns({"base_failed": base, "failed_rules": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "base_failed", "kept")


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for v in STOP_WORDS.values() for w in v.split()}))
    rules = " AND ".join(f"({r.denominator} = 0 OR ({r.numerator} >= {r.low}::DOUBLE * {r.denominator} AND {r.numerator} <= {r.high}::DOUBLE * {r.denominator}))" for r in RULES)
    return rf"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS rid, doc_id, COALESCE(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, REGEXP_EXTRACT_ALL(text, '[^\x20\x09-\x0D]+') AS words,
    LIST_FILTER(STRING_SPLIT(text, CHR(10)), LAMBDA x: REGEXP_MATCHES(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT rid, UNNEST(RANGE(1, LEN(words) + 1)) AS i, UNNEST(words) AS a FROM w),
t AS (SELECT rid, i, a, LEAD(a, 1) OVER o AS b, LEAD(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT rid, i, COUNT(*) OVER (PARTITION BY rid, a, b, c) AS n FROM t WHERE c IS NOT NULL),
r AS (SELECT rid, COUNT(DISTINCT j) AS n_repeat FROM (SELECT rid, UNNEST([i, i + 1, i + 2]) AS j FROM g WHERE n >= 2) GROUP BY rid),
m AS (SELECT doc_id, LEN(words)::BIGINT AS n_words, LENGTH(REGEXP_REPLACE(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    LENGTH(REGEXP_REPLACE(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, LEN(lines)::BIGINT AS n_lines,
    (LEN(lines) - LEN(LIST_DISTINCT(lines)))::BIGINT AS n_dup_lines,
    LEN(LIST_FILTER(words, LAMBDA x: LOWER(x) IN ({stop})))::BIGINT AS n_stop_words, COALESCE(n_repeat, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, base_failed, NOT base_failed AND {rules} AS kept FROM b
"""


OP2_SQL = _sql()
