"""Paired experiments: the signed-rank test over any number of pairs, and the report of a run."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from ..functions.scalar import binomial_tail
from .tables import written


def cumulated(rows: DataFrame, order: list, weight: str, out: str, parts: int = 64) -> DataFrame:
    """``rows`` with the sum of ``weight`` over all rows before each in ``order``, by which no two are equal.

    Rows are dealt to ranges, summed up in each, and moved by the sums of the ranges before: one row a range is windowed as a whole.
    """
    table = written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = table.groupBy("_part").agg(F.sum(weight).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")  # ``parts`` rows
    own = F.coalesce(F.sum(weight).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return table.withColumn(out, own).join(F.broadcast(before), "_part").withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")


def signed_ranks(pairs: DataFrame, nan: bool = False) -> DataFrame:
    """One row of pairs (delta): n, n_zero, r_plus and r_minus (sums of ranks of |delta|), ties (sum of c**3 - c), statistic and z.

    Equal values share their mean rank; the ranks of zeros are halved between both sides. Equal values are counted before they are
    ranked, so a value that very many pairs have is one row. z is null where there is no spread. NaN is left out, or with ``nan`` the largest of all.
    """
    sized = pairs.where(F.col("delta").isNotNull() & (F.lit(nan) | ~F.isnan("delta"))).groupBy(F.abs("delta").alias("size"))
    counted = sized.agg(F.count(F.lit(1)).alias("c"), F.count(F.when(F.col("delta") > 0, 1)).alias("up"), F.count(F.when(F.col("delta") < 0, 1)).alias("down"))
    ranked = cumulated(counted, ["size"], "c", "before").withColumn("rank", F.col("before") + (F.col("c") + 1) / 2)
    zero, c = F.when(F.col("size") == 0, F.col("c")).otherwise(0), F.col("c").cast("double")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    sums = ranked.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(zero), F.lit(0)).alias("n_zero"), total((F.col("up") + zero / 2) * F.col("rank")).alias("r_plus"),
        total((F.col("down") + zero / 2) * F.col("rank")).alias("r_minus"), total(c * c * c - c).alias("ties"))
    n = F.col("n").cast("double")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    least = F.least("r_plus", "r_minus")
    return sums.withColumn("statistic", least).withColumn("z", F.when(spread > 0, (least - n * (n + 1) / 4) / spread))


def significance(pairs: DataFrame, test: str = "wilcoxon") -> tuple[float, str]:
    """Two-sided p and the test's name: the signed-rank test's normal tail, or the sign test; 1 and insufficient_data under two pairs."""
    if test == "wilcoxon":
        r = signed_ranks(pairs).first()
        if r["n"] < 2:
            return 1.0, "insufficient_data"
        return (1.0 if r["z"] is None else math.erfc(abs(r["z"]) / math.sqrt(2))), test
    r = pairs.agg(F.count("delta").alias("n"), F.count_if(F.col("delta") > 0).alias("up"), F.count_if(F.col("delta") < 0).alias("down")).first()
    if r["n"] < 2:
        return 1.0, "insufficient_data"
    return (min(2 * binomial_tail(max(r["up"], r["down"]), r["up"] + r["down"]), 1.0) if r["up"] + r["down"] else 1.0), "sign_test"


def ablation_report(a: DataFrame, b: DataFrame, folder: str, compare: str, key: str = "script_id", score: str = "score", test: str = "wilcoxon") -> dict:
    """Write ``per_script`` (CSV: key, score_A, score_B, delta), ``regressions`` (CSV) and ``summary`` (one line of JSON) of both sides of an experiment.

    Scripts of either side are rows; a score that is missing or NaN makes the delta NaN and the pair invalid. The counts of
    the summary are observed while the rows are written; regressions may be many, so they are a table of their own.
    """
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    both = a.select(key, F.col(score).alias("x")).join(b.select(key, F.col(score).alias("y")), key, "full_outer").select(key, number("x").alias("score_A"), number("y").alias("score_B"))
    rows = written(both.withColumn("delta", F.col("score_B") - F.col("score_A")), "pairs")
    seen = Observation("ablation")
    valid = ~F.isnan("delta")
    counted = rows.observe(seen, F.count(F.lit(1)).alias("n_scripts"), F.count_if(valid).alias("n_valid"), F.avg(F.when(valid, F.col("delta"))).alias("mean_delta"), F.count_if(valid & (F.col("delta") < 0)).alias("n_regressions"))
    counted.write.option("header", True).csv(f"{folder}/per_script")
    rows.where(valid & (F.col("delta") < 0)).select(key).write.option("header", True).csv(f"{folder}/regressions")
    p, name = significance(rows.where(valid).select("delta"), test)
    found = seen.get
    summary = {"compare": compare, "n_scripts": found["n_scripts"], "n_valid": found["n_valid"], "mean_delta": found["mean_delta"] or 0.0, "p_value": p, "test": name, "n_regressions": found["n_regressions"]}
    rows.sparkSession.createDataFrame([Row(value=json.dumps(summary))]).coalesce(1).write.text(f"{folder}/summary")
    return summary


def append_curve(runs: DataFrame, path: str, columns: list[str]) -> dict:
    """Append the runs without an error to a CSV folder, and say how many were appended and left out, counted in the same pass."""
    seen = Observation("curve")
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    counted = runs.observe(seen, F.count_if(~failed).alias("n_appended"), F.count_if(failed).alias("n_failed"))
    counted.where(~failed).select(*columns).write.mode("append").option("header", True).csv(path)
    return dict(seen.get)


def weighted_sample(rows: DataFrame, by: list[str], key: str, weight: str, n: int | None = None, share: float | None = None, seed: int = 0) -> DataFrame:
    """``rows`` drawn without replacement by weight: ``n`` of each group, or ``share`` of its rows, rounded down; with ``place``, in the order of drawing.

    A row's draw is an exponential variable of rate ``weight``, made of a hash of seed and key; the least of a group are its sample. So it
    depends on the rows alone, and groups are cut down before they are shuffled. Rows without a weight over 0 are never drawn.
    """
    if (n is None) == (share is None):
        raise ValueError("weighted_sample: either n or share")
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 13), 16, 10).cast("double")
    draw = -F.ln((hashed + 0.5) / float(1 << 52)) / F.col(weight)
    drawn = rows.where(F.col(weight) > 0).withColumn("_draw", draw).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("_draw", key)))
    if n is not None:
        return drawn.where(F.col("place") <= n).drop("_draw")
    sizes = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.floor(F.count(F.lit(1)) * share).alias("_n"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return drawn.join(sizes, on).where("place <= _n").drop("_draw", "_n", *[f"_{c}" for c in by])
