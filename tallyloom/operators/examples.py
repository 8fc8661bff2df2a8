"""Ranked lists of examples: short lists that merge, so they are combined before rows are shuffled.

Examples are rows (pattern, hash, source, target, score, script, at); edits are rows (pattern, class, old, new, gain, script, at). ``at`` is
the order in which they came: among equals the earlier ones are kept. The best of any split's best are the best of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Examples of a pattern, edits of a pattern's class of failures, characters of sources, targets and edits.
EXAMPLES, EDITS, SOURCE, TARGET, EDIT = 3, 5, 300, 600, 300
_BASE = r"^(.+?)-(\d+)$"


def example_columns(source: Column, target: Column) -> list[Column]:
    """hash of the whole source, and both texts cut to what an example keeps."""
    return [F.substring(F.sha2(source.cast("binary"), 256), 1, 8).alias("hash"), F.substring(source, 1, SOURCE).alias("source"), F.substring(target, 1, TARGET).alias("target")]


def best_examples(rows: DataFrame, by: str = "pattern", most: int = EXAMPLES) -> DataFrame:
    """Of each hash its best row, of each pattern the ``most`` best ones. Aggregation and ranks are both cut down before their shuffles."""
    rest = [c for c in rows.columns if c not in (by, "hash", "score", "at")]
    once = rows.groupBy(by, "hash").agg(F.max(F.struct("score", (-F.col("at")).alias("first"), *rest)).alias("x"))
    once = once.select(by, "hash", "x.score", (-F.col("x.first")).alias("at"), *[f"x.{c}" for c in rest])
    return _first(once, [by], [F.desc("score"), "at", "hash"], most).select(*rows.columns)


def best_edits(rows: DataFrame, by: str = "pattern", most: int = EDITS) -> DataFrame:
    """Of each class of a pattern the ``most`` edits that gained most; equal edits are kept apart."""
    return _first(rows, [by, "class"], [F.desc("gain"), "at", "old", "new"], most).select(*rows.columns)


def _first(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= most)


def base_name(x: Column) -> Column:
    found = F.regexp_extract(x, _BASE, 1)
    return F.when(found == "", x).otherwise(found)


def canonical_ids(patterns: DataFrame) -> DataFrame:
    """id, base and canonical of each pattern of a base that has several: the base itself if it is one of them, else the first by name."""
    named = patterns.select("id", base_name(F.col("id")).alias("base"))
    of_base = named.groupBy("base").agg(F.coalesce(F.max(F.when(F.col("id") == F.col("base"), F.col("id"))), F.min("id")).alias("canonical"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return named.join(of_base.drop("n"), "base").select("id", "base", "canonical")


def consolidated(patterns: DataFrame, examples: DataFrame, edits: DataFrame, evidence: DataFrame, contradictions: DataFrame) -> dict[str, DataFrame]:
    """Patterns whose names differ in a number at the end as one, with everything that they hold.

    ``patterns``: id, ties. ``evidence``: pattern and any other columns; ``contradictions``: pattern, at, said.
    Gives ``patterns`` (canonical, base, n_merged, ties), ``removed`` (id, canonical), and the other tables under the canonical name:
    ``evidence`` with all rows; ``contradictions`` with each text once, at its first place; the best ``edits``; and the best ``examples`` with
    their ``place``, those whose target defines the function of the base's name first, then by score. Patterns of the canonical
    name come before the others, which follow by name. Nothing is collected; a base may have any number of patterns and rows.
    """
    ids = canonical_ids(patterns)
    of = ids.select(F.col("id").alias("pattern"), "base", "canonical", F.struct((F.col("id") != F.col("canonical")).alias("later"), F.col("id").alias("name")).alias("turn"))
    moved = lambda df: df.join(of, "pattern")
    merged = patterns.join(ids, "id").groupBy("canonical", "base").agg(F.count(F.lit(1)).alias("n_merged"), F.sum("ties").alias("ties"))

    def ranked(df: DataFrame, value: str) -> DataFrame:
        """``at`` as the place among the rows of the canonical name with this value: equals only are compared by it."""
        order = Window.partitionBy("canonical", value).orderBy("turn", "at")
        return moved(df).withColumn("at", F.row_number().over(order).cast("long")).drop("turn", "pattern").withColumnRenamed("canonical", "pattern")

    # Best of each pattern first, so that ranks of the canonical name see short lists only.
    best = best_examples(ranked(best_examples(examples), "score").drop("base")).join(ids.select(F.col("canonical").alias("pattern"), "base").distinct(), "pattern")
    defines = F.col("target").contains(F.concat(F.lit("def "), F.replace("base", F.lit("-"), F.lit("_")), F.lit("(")))
    place = F.row_number().over(Window.partitionBy("pattern").orderBy(F.when(defines, 0).otherwise(1), F.desc("score"), "at"))
    texts = moved(contradictions).groupBy("canonical", "said").agg(F.min(F.struct("turn", "at")).alias("first"))
    return {
        "patterns": merged,
        "removed": ids.where("id <> canonical").select("id", "canonical"),
        "examples": best.withColumn("defines", defines).withColumn("place", place).drop("base"),
        "edits": best_edits(ranked(best_edits(edits), "gain").drop("base")),
        "evidence": moved(evidence).drop("pattern", "base", "turn").withColumnRenamed("canonical", "pattern"),
        "contradictions": texts.select(F.col("canonical").alias("pattern"), "said", F.row_number().over(Window.partitionBy("canonical").orderBy("first", "said")).alias("place")),
    }
