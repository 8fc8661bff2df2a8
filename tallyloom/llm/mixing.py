"""Mixing sources to target weights: capped water-filling and seeded repetitions (SQL functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, shared_table

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
#: Buckets of the seeded order of a source; only one bucket of a source is ever sorted.
BUCKET_BITS, HASH_BITS = 10, 52


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_order(id_col: Column, seed: str = SEED) -> Column:
    """A whole number below 2**52 that depends on the seed and the id alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def water_fill(sources: DataFrame, share_num: int, share_den: int, max_epochs: int) -> DataFrame:
    """Targets of sources: ``weight`` shares of share_num/share_den of all sizes, none above its cap.

    ``sources`` has __source, __total and __weight, one row a source. A source is clamped at
    ``max_epochs * __total``; what it can't take goes to the others by weight, and so on. Ordered by
    cap over weight, the clamped ones come first, so running sums find them all in one pass.
    """
    wide = "decimal(19,0)"
    cap = F.col("__total") * max_epochs
    up = Window.orderBy((cap / F.col("__weight")), "__source")
    all_rows = Window.partitionBy()
    filled = (
        sources.withColumn("__before", F.sum(cap).over(up) - cap)
        .withColumn("__open", F.sum("__weight").over(all_rows) - F.sum("__weight").over(up) + F.col("__weight"))
        .withColumn("__goal", F.sum("__total").over(all_rows) * share_num)
        .withColumn(
            "__capped",
            (cap * share_den).cast(wide) * F.col("__open").cast(wide)
            <= (F.col("__goal") - share_den * F.col("__before")).cast(wide) * F.col("__weight").cast(wide),
        )
        .withColumn("__clamped", F.sum(F.when(F.col("__capped"), cap).otherwise(0)).over(all_rows))
        .withColumn("__weights", F.sum(F.when(F.col("__capped"), 0).otherwise(F.col("__weight"))).over(all_rows))
    )
    level = (F.col("__goal") - share_den * F.col("__clamped")).cast("double") / (share_den * F.col("__weights")).cast("double")
    target = F.when(F.col("__capped"), cap.cast("double")).otherwise(level * F.col("__weight"))
    return filled.select("__source", "__total", "__rows", target.alias("__target"))


def prepared(df: DataFrame, id_col: str, source_col: str, size: Column, seed: str) -> DataFrame:
    """``df`` with the three columns that mixing works on: __source, __size and __order."""
    return df.withColumns({"__source": F.col(source_col).cast("string"), "__size": size, "__order": seeded_order(F.col(id_col), seed)})


def mix_plan(sizes: DataFrame, weights: Sequence[int], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """One row a source: what its rows need to know to draw their own copies.

    Reads __source, __size, __order. All sums are grouped with map-side combining; windows see one row a
    source, at most 2**BUCKET_BITS rows of a source, or the rows of one bucket of a source.
    """
    per = sizes.groupBy("__source").agg(F.sum("__size").alias("__total"), F.count(F.lit(1)).alias("__rows"))
    place = (F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1) % len(weights)
    turns = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    per = per.withColumn("__weight", F.element_at(turns, (place + 1).cast("int")))
    rates = shared_table(
        water_fill(per, *share, max_epochs)
        .withColumn("__rate", F.when(F.col("__total") > 0, F.col("__target") / F.col("__total")).otherwise(F.lit(0.0)))
        .withColumn("__whole", F.floor("__rate"))
        .withColumn("__part", F.col("__rate") - F.col("__whole"))
        .withColumnRenamed("__source", "__of"),
        "mix-rates",
    )
    rows = sizes.join(rates, F.col("__source").eqNullSafe(F.col("__of")))
    shift = HASH_BITS - BUCKET_BITS
    bucket = F.shiftright("__order", shift)
    in_source = Window.partitionBy("__of")
    edges = (
        rows.groupBy("__of", bucket.alias("__bucket"), "__part", "__total")
        .agg(
            F.sum(F.when(is_long(), 0).otherwise(F.col("__size"))).alias("__sum"),
            F.sum(F.when(is_long() & is_drawn(), F.col("__size")).otherwise(0)).alias("__long"),
        )
        .withColumn("__need", F.round(F.col("__part") * F.col("__total")).cast("long") - F.sum("__long").over(in_source))
        .withColumn("__start", F.sum("__sum").over(in_source.orderBy("__bucket")) - F.col("__sum"))
        .where(F.col("__start") <= F.col("__need"))
        .groupBy("__of")
        .agg(F.max(F.struct("__bucket", "__start", "__need")).alias("__edge"))
        .select(F.col("__of").alias("__edge_of"), "__edge.*")
    )
    edges = shared_table(edges, "mix-edges")
    inside = (
        rows.where(~is_long())
        .join(edges, F.col("__of").eqNullSafe(F.col("__edge_of")) & (bucket == F.col("__bucket")))
        .groupBy("__of", "__order", "__start", "__need")
        .agg(F.sum("__size").alias("__size"))
        .withColumn("__at", F.col("__start") + F.sum("__size").over(in_source.orderBy("__order")) - F.col("__size"))
        .where(2 * F.col("__at") + F.col("__size") <= 2 * F.col("__need"))
        .groupBy(F.col("__of").alias("__in"))
        .agg(F.max("__order").alias("__last"))
    )
    limits = (
        edges.join(inside, F.col("__edge_of").eqNullSafe(F.col("__in")), "left")
        .select("__edge_of", F.coalesce("__last", F.shiftleft("__bucket", shift) - 1).alias("__limit"))
    )
    plan = shared_table(
        rates.join(limits, F.col("__of").eqNullSafe(F.col("__edge_of")), "left").drop("__edge_of").fillna(-1, ["__limit"]), "mix-plan"
    )
    discard(rates, edges)
    return plan


def is_long() -> Column:
    """Rows over twice the mean size of their source are drawn one by one."""
    return F.col("__size") * F.col("__rows") > 2 * F.col("__total")


def is_drawn() -> Column:
    return F.col("__order") < F.col("__part") * float(1 << HASH_BITS)


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with __total, __target and __copies (0 to the epoch limit) of each row."""
    extra = F.when(is_long(), is_drawn()).otherwise((F.col("__order") <= F.col("__limit")) & (F.col("__part") > 0))
    return (
        rows.join(plan, F.col("__source").eqNullSafe(F.col("__of")))
        .withColumn("__copies", (F.col("__whole") + F.when(extra, 1).otherwise(0)).cast("int"))
        .drop("__of", "__rows", "__rate", "__whole", "__part", "__limit")
    )


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    weights: Sequence[int] = (3, 1, 2),
    share: tuple[int, int] = (3, 2),
    max_epochs: int = 2,
    seed: str = SEED,
) -> DataFrame:
    """Copies of every row, so that the sources come to their targets.

    Returns _id, size, source_size, target, copies, taken: one row for each row of ``df``. Sources take
    ``weights`` in turn in the order of their code points, null last, and share ``share`` (a fraction) of
    all sizes; a source is clamped at ``max_epochs`` times its size and the excess reshared by weight.
    A source of rate r = target / size gets floor(r) whole repetitions of each row. The fraction that
    is left is drawn from a seeded order of ids: rows over twice the source's mean size are drawn one
    by one (hash below the fraction); the others are taken from the start of the order until the
    source's words, long rows included, are nearest to the target.

    Defined cases: a null text has size 0; null sources form a source of their own; a source of size
    0 has target 0; rows that repeat an id share its draw; a null id is drawn as the empty string;
    an empty table gives no rows. Other columns of ``df`` are neither read nor returned.
    """
    size = n_words(F.col("text")) if size is None else size
    rows = prepared(df, id_col, source_col, size, seed).select(F.col(id_col).alias("_id"), "__source", "__size", "__order")
    rows = shared_table(rows, "mix-sizes")
    out = with_copies(rows, mix_plan(rows, weights, share, max_epochs))
    return out.select(
        "_id", F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"),
        F.col("__copies").alias("copies"), (F.col("__copies") * F.col("__size")).alias("taken"),
    )


def repeat_rows(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), max_epochs: int = 2, seed: str = SEED) -> DataFrame:
    """The mixture itself: every row of ``df`` as often as :func:`mix_sources` says, columns unchanged."""
    rows = prepared(df, id_col, source_col, n_words(F.col("text")) if size is None else size, seed)
    sizes = shared_table(rows.select("__source", "__size", "__order"), "mix-sizes")
    out = with_copies(rows, mix_plan(sizes, weights, share, max_epochs)).where("__copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in df.columns])


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, COALESCE(LEN(REGEXP_EXTRACT_ALL(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || SUBSTR(MD5('mix-1:' || COALESCE(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS ord FROM documents),
p AS (SELECT source, SUM(size)::BIGINT AS total, COUNT(*) AS n, [3, 1, 2][((ROW_NUMBER() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1]::BIGINT AS w FROM d GROUP BY source),
f AS (SELECT *, SUM(2 * total) OVER up - 2 * total AS before, SUM(w) OVER () - SUM(w) OVER up + w AS open, 3 * SUM(total) OVER () AS goal
    FROM p WINDOW up AS (ORDER BY 2 * total / w, source)),
g AS (SELECT *, (4 * total)::HUGEINT * open <= (goal - 2 * before)::HUGEINT * w AS capped FROM f),
h AS (SELECT *, SUM(CASE WHEN capped THEN 2 * total ELSE 0 END) OVER () AS clamped, SUM(CASE WHEN capped THEN 0 ELSE w END) OVER () AS ws FROM g),
t AS (SELECT source, total, n, CASE WHEN capped THEN (2 * total)::DOUBLE ELSE (goal - 2 * clamped)::DOUBLE / (2 * ws)::DOUBLE * w END AS target FROM h),
r AS (SELECT *, CASE WHEN total > 0 THEN target / total ELSE 0.0::DOUBLE END AS rate FROM t),
s AS (SELECT *, FLOOR(rate) AS whole, rate - FLOOR(rate) AS part FROM r),
x AS (SELECT d.*, s.total, s.target, s.whole, s.part, d.size * s.n > 2 * s.total AS long, d.ord < s.part * 4503599627370496.0::DOUBLE AS drawn
    FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
need AS (SELECT source, ROUND(ANY_VALUE(part) * ANY_VALUE(total))::BIGINT - SUM(CASE WHEN long AND drawn THEN size ELSE 0 END) AS need FROM x GROUP BY source),
o AS (SELECT source, ord, SUM(size) AS size FROM x WHERE NOT long GROUP BY source, ord),
c AS (SELECT *, SUM(size) OVER (PARTITION BY source ORDER BY ord) - size AS start FROM o),
lim AS (SELECT c.source, MAX(ord) AS lim FROM c JOIN need n ON c.source IS NOT DISTINCT FROM n.source WHERE 2 * start + size <= 2 * need GROUP BY c.source)
SELECT doc_id, size, total AS source_size, target,
    ((whole + CASE WHEN CASE WHEN long THEN drawn ELSE ord <= COALESCE(lim, -1) AND part > 0 END THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM x LEFT JOIN lim ON x.source IS NOT DISTINCT FROM lim.source
"""
