"""Ranked selections, previous-row deltas, ranges, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered_within, running


def first_per(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def top_examples(df: DataFrame, group: Sequence[str], content: str, score: str, tie: str, n: int) -> DataFrame:
    """The n best rows of a group, each content once with its best score. The earliest of equals is kept."""
    once = first_per(df, [*group, content], F.col(score).desc(), F.col(tie))
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tie))
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def delta_since_previous(df: DataFrame, group: str, order: Sequence[str], value: str, names: str) -> DataFrame:
    """Change of a value and new members of an array since the row before; the first row counts from nothing."""
    w = Window.partitionBy(group).orderBy(*order)
    empty = F.array().cast(df.schema[names].dataType)
    return df.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0.0))).withColumn("added", F.array_except(names, F.coalesce(F.lag(names).over(w), empty)))


def sentinel_ranges(lines: DataFrame, group: str, line: str, mark: Column, blank: Column) -> DataFrame:
    """Ranges from each marked line to the last non-blank line before the next mark."""
    w = Window.partitionBy(group).orderBy(line)
    tagged = lines.withColumn("range_no", F.sum(mark.cast("int")).over(w)).where("range_no > 0")
    return tagged.groupBy(group, "range_no").agg(F.min(line).alias("start_line"), F.max(F.when(~blank | mark, F.col(line))).alias("end_line"))


def clip_ranges(df: DataFrame, group: str, start: str, end: str, tie: str) -> DataFrame:
    """Ranges in order of their starts, each cut before the next one; emptied ones go."""
    following = F.lead(start).over(Window.partitionBy(group).orderBy(start, tie))
    return df.withColumn(end, F.least(F.col(end), F.coalesce(following - 1, F.col(end)))).where(F.col(end) >= F.col(start))


def last_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def running_best(df: DataFrame, group: str, order: Sequence[str], score: str) -> DataFrame:
    """best_before and accepted: strictly better than everything before (the first row is)."""
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(score).over(before)
    return df.withColumn("best_before", best).withColumn("accepted", F.col("best_before").isNull() | (F.col(score) > F.col("best_before")))


def fresh_names(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """name, name_1, name_2, ... in order of appearance. A name may have any share of the rows."""
    n = F.col("__n") - 1
    return numbered_within(df, [name], order, "__n").withColumn("fresh", F.when(n == 0, F.col(name)).otherwise(F.concat_ws("_", name, n))).drop("__n")


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The table with new rows in place of old ones of their key; of several new ones the last by ``order``."""
    new = first_per(rows, keys, F.col(order).desc())
    return table.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def best_runs(runs: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """Best score of each key (earliest of equals), where it was, and the number of runs."""
    top = F.max(F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o")))
    return runs.groupBy(key).agg(top.alias("t"), F.count(F.lit(1)).alias("n_runs")).select(key, F.col("t.s").alias("best"), (-F.col("t.o")).alias("best_at"), "n_runs")


def store_content(df: DataFrame, text: str, tie: str, known: DataFrame | None = None) -> DataFrame:
    """One row for each new non-blank content, under its hash: the first by ``tie``."""
    hashed = df.where(F.trim(text) != "").groupBy(F.sha2(text, 256).alias("hash")).agg(F.min(tie).alias(tie), F.count(F.lit(1)).alias("n_copies"))
    return hashed if known is None else hashed.join(known.select("hash"), "hash", "left_anti")


def fill_missing(df: DataFrame, group: str, order: Sequence[str], value: str, how: str = "down") -> DataFrame:
    """Nulls from the last value above (down), the next below (up), or down then up (downup)."""
    w = Window.partitionBy(group).orderBy(*order)
    down = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    up = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("filled", {"down": down, "up": up, "downup": F.coalesce(down, up), "updown": F.coalesce(up, down)}[how])


def last_ranges(ranges: DataFrame, key: str, order: str, start: str, end: str) -> DataFrame:
    """Of the ranges of each key the last."""
    return ranges.groupBy(key).agg(F.max_by(F.struct(start, end), order).alias("r")).select(key, "r.*")


def first_differences(a: DataFrame, b: DataFrame, group: str, n: int = 3) -> DataFrame:
    """group, line, more and note of two sides of printed lines (group, line, text).

    Sides of as many lines give their first ``n`` lines that differ; more is true from the n-th difference on, whether or not others follow.
    Other groups give one row without a line and a note: no_expected or no_actual where a side has no lines at all, else uneven. Equal sides give none.
    """
    both = a.join(b.select(group, "line", F.col("text").alias("other")), [group, "line"], "full_outer")
    sides = a.select(group, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(group, F.lit(0).alias("x"), F.lit(1).alias("y"))).groupBy(group).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    note = F.when(F.col("x") == 0, "no_expected").when(F.col("y") == 0, "no_actual").when(F.col("x") != F.col("y"), "uneven")
    sides = sides.withColumn("note", note)
    differ = both.where(~F.col("text").eqNullSafe(F.col("other"))).join(sides.where("note is null").select(group), group, "left_semi")
    differ = differ.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("line"))).where(F.col("place") <= n)
    more = F.max("place").over(Window.partitionBy(group)) >= n
    lines = differ.select(group, "line", more.alias("more"), F.lit(None).cast("string").alias("note"))
    return lines.unionByName(sides.where("note is not null").select(group, F.lit(None).cast(a.schema["line"].dataType).alias("line"), F.lit(False).alias("more"), "note"))


def allocated_ids(rows: DataFrame, taken: DataFrame, base: str, order: Sequence[str], out: str = "id") -> DataFrame:
    """Fresh ids: the base if free, else base-1, base-2, ... that are neither in ``taken`` (id) nor given to a row before.

    Suffixes in use are taken out of those from 0 on: the n-th row of a base gets its n-th free one. A base may have any share of the rows.
    """
    wanted = numbered_within(rows, [base], order, "__n")
    named = taken.select("id", F.regexp_replace("id", r"-(\d+)$", "").alias("__b"), F.regexp_extract("id", r"-(\d+)$", 1).alias("__s"))
    numbers = named.where("__s rlike '^[1-9][0-9]{0,17}$'").select(F.col("__b").alias(base), F.col("__s").cast("long"))
    used = named.select(F.col("id").alias(base), F.lit(0).cast("long").alias("__s")).union(numbers).distinct().join(rows.select(base).distinct(), base, "left_semi")
    # The k-th used suffix s leaves s - k + 1 free ones below it: all later free ones are moved by k.
    moved = numbered_within(used, [base], ["__s"], "__k").groupBy(base, (F.col("__s") - F.col("__k") + 2).alias("__n")).agg(F.max("__k").alias("__k"))
    both = wanted.withColumns({"__k": F.lit(None).cast("long"), "__row": F.lit(1)}).unionByName(moved.withColumn("__row", F.lit(0)), allowMissingColumns=True)
    suffix = F.col("__n") - 1 + F.coalesce(F.col("__before"), F.lit(0))
    found = running(both, [base], ["__n", "__row"], F.col("__k"), "__before", "max").where("__row = 1")
    return found.withColumn(out, F.when(suffix == 0, F.col(base)).otherwise(F.concat_ws("-", base, suffix))).select(*rows.columns, out)
