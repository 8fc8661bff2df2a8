"""Comparison joins, interval joins and positional lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def presence_join(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join by keys with ``present``: a missing row is told from a null value."""
    return expected.join(actual.withColumn("present", F.lit(True)), list(keys), "left").fillna(False, ["present"])


def full_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row a key of either side: only_left, only_right, differs or same (nulls equal)."""
    x, y = a.select(key, F.col(value).alias("left_value"), F.lit(True).alias("l")), b.select(key, F.col(value).alias("right_value"), F.lit(True).alias("r"))
    state = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").when(F.col("left_value").eqNullSafe(F.col("right_value")), "same").otherwise("differs")
    return x.join(y, key, "full_outer").select(key, "left_value", "right_value", state.alias("state"))


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of ``after`` that are new or changed; deletions are not reported."""
    old = before.select(key, F.col(value).alias("old_value"))
    return after.join(old, key, "left").where(~F.col(value).eqNullSafe(F.col("old_value"))).select(key, value, F.col("old_value").isNull().alias("is_new"))


def positional(a: DataFrame, b: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """Values of two sides paired by their place in a group."""
    w = Window.partitionBy(group).orderBy(*order)
    left = a.withColumn("place", F.row_number().over(w)).select(group, "place", F.col(value).alias("left_value"))
    right = b.withColumn("place", F.row_number().over(w)).select(group, "place", F.col(value).alias("right_value"))
    return left.join(right, [group, "place"], "full_outer")


def points_in_intervals(points: DataFrame, spans: DataFrame, group: str, point: str, start: str, end: str, width: int) -> DataFrame:
    """All spans of a group that hold a point (both ends in), as an equi-join on buckets of ``width``.

    A span is repeated for each bucket that it touches, so neither side is compared as a whole.
    """
    cut = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return points.withColumn("bucket", F.floor(F.col(point) / width)).join(cut, [group, "bucket"]).where(F.col(point).between(F.col(start), F.col(end))).drop("bucket")


def contained(spans: DataFrame, group: str, key: str, start: Column, end: Column, width: int = 32) -> DataFrame:
    """Keys of spans that contain others of their group, equal spans each other too, by buckets of ``width``. Equal spans are joined as one.

    Starts and ends are numbers; ``position`` makes them of lines and columns.
    """
    own = spans.select(group, F.col(key).alias("outer_key"), start.alias("s0"), end.alias("e0"))
    x = own.groupBy(group, "s0", "e0").agg(F.count(F.lit(1)).alias("n"))
    y = x.select(group, F.col("s0").alias("s1"), F.col("e0").alias("e1"), F.col("n").alias("m"))
    inside = points_in_intervals(y, x, group, "s1", "s0", "e0", width).where("e1 <= e0").groupBy(group, "s0", "e0").agg((F.sum("m") - 1).alias("n_inside")).where("n_inside > 0")
    return own.join(inside, [group, "s0", "e0"]).select(group, "outer_key", "n_inside")


def position(line: Column, column: Column, most: int = 1 << 16) -> Column:
    """A place in a text as one number: lines first, then columns (under ``most``)."""
    return line.cast("long") * most + column


def lines_of_spans(spans: DataFrame, marks: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Spans with the sorted set of flags of the lines that they cover: spans are repeated for each of their lines and joined by line."""
    lines = spans.withColumn("line", F.explode(F.sequence(F.col(start), F.col(end))))
    found = lines.join(marks.select(group, "line", "flag"), [group, "line"]).groupBy(*spans.columns).agg(F.array_sort(F.collect_set("flag")).alias("flags"))
    return spans.join(found, spans.columns, "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))


def first_cover(points: DataFrame, spans: DataFrame, group: str, point: str, start: str, end: str, key: str, order: str, width: int = 32) -> DataFrame:
    """Of the spans that hold a point the first by ``order``; points in none have null."""
    hit = points_in_intervals(points, spans, group, point, start, end, width)
    best = hit.groupBy(*points.columns).agg(F.min_by(key, order).alias("cover"))
    return points.join(best, points.columns, "left")


def escaped(before: DataFrame, after: DataFrame, folder: str) -> DataFrame:
    """Files (path, hash) that are new or changed outside ``folder``."""
    return snapshot_changes(before, after, "path", "hash").where(~F.col("path").startswith(folder.rstrip("/") + "/"))


def files_score(expected: DataFrame, actual: DataFrame, group: str) -> DataFrame:
    """Share of the expected files (path, hash) with an equal actual one; 1 if neither side has any, 0 if only the actual side has."""
    both = expected.join(actual.select(group, "path", F.col("hash").alias("other")), [group, "path"], "left")
    score = both.groupBy(group).agg(F.avg(F.col("hash").eqNullSafe(F.col("other")).cast("double")).alias("score"))
    return score.unionByName(actual.select(group).distinct().join(expected.select(group), group, "left_anti").select(group, F.lit(0.0).alias("score")))


def env_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Variables (keys and value) that were added, changed or removed, with the value they have then; null for removed ones."""
    both = before.select(*keys, F.col("value").alias("old"), F.lit(True).alias("was")).join(after.select(*keys, F.col("value").alias("new"), F.lit(True).alias("is")), keys, "full_outer")
    changed = F.col("was").isNull() | F.col("is").isNull() | ~F.col("old").eqNullSafe(F.col("new"))
    return both.where(changed).select(*keys, F.col("new").alias("value"))


def shim_names(entities: DataFrame, references: DataFrame, captured: DataFrame, group: str) -> DataFrame:
    """Names that a shim must give: captured ones that are referred to, or that entities which aren't translated define."""
    wanted = references.select(group, "name").union(entities.where(~F.col("translatable")).select(group, "name")).distinct()
    return wanted.join(captured.select(group, "name"), [group, "name"], "left_semi")


def sidecar_names(captured: DataFrame, entities: DataFrame, shims: DataFrame, group: str) -> DataFrame:
    """Captured names that are no entities, or that shims need."""
    free = captured.join(entities.select(group, "name"), [group, "name"], "left_anti")
    return free.unionByName(captured.join(entities.select(group, "name"), [group, "name"], "left_semi").join(shims.select(group, "name"), [group, "name"], "left_semi"))


def graphics_score(expected: DataFrame, actual: DataFrame, group: str) -> DataFrame:
    """Pictures (place, hash) of two sides: verdict pass and score 1 if all are equal, fail and 0 for other counts, else uncomparable.

    Pictures that differ would need an image library. Groups that one side lacks have another count.
    """
    x = expected.groupBy(group, "place").agg(F.first("hash").alias("a"))
    y = actual.groupBy(group, "place").agg(F.first("hash").alias("b"))
    both = x.join(y, [group, "place"], "full_outer").groupBy(group).agg(F.max(F.col("a").isNull() | F.col("b").isNull()).alias("counts"), F.min(F.col("a").eqNullSafe(F.col("b"))).alias("same"))
    verdict = F.when(F.col("counts"), "fail").when(F.col("same"), "pass").otherwise("uncomparable")
    return both.select(group, verdict.alias("verdict"), F.when(verdict == "pass", 1.0).otherwise(0.0).alias("score"))


def latest_before(uses: DataFrame, definitions: DataFrame, name: Sequence[str], at: str) -> DataFrame:
    """As-of lookup: each use with the last definition of its name before it, by one sort of both sides."""
    both = uses.select(*name, at, F.lit(1).alias("is_use"), F.lit(None).cast(definitions.schema["definition"].dataType).alias("definition")).unionByName(definitions.select(*name, at, F.lit(0).alias("is_use"), "definition"))
    w = Window.partitionBy(*name).orderBy(at, F.col("is_use").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("resolved", F.last("definition", ignorenulls=True).over(w)).where("is_use = 1").select(*name, at, "resolved")


def lookup_with_fallback(rows: DataFrame, index: DataFrame, exact: Sequence[str], loose: str) -> DataFrame:
    """Index rows of the exact key; those of the loose key (exact part empty) where there are none."""
    first = rows.join(index, list(exact), "left")
    rest = exact[-1]
    wide = index.where(F.col(rest) == "").drop(rest)
    missing = first.where(F.col("id").isNull()).drop("id").join(wide, loose, "left")
    return first.where(F.col("id").isNotNull()).withColumn("tier", F.lit(0)).unionByName(missing.withColumn("tier", F.lit(1)))


def attribute(failures: DataFrame, entities: DataFrame, group: str) -> DataFrame:
    """Each failing variable to the last entity of its name, or to all entities of its group if none has it."""
    named = entities.groupBy(group, F.col("name").alias("variable")).agg(F.max_by("entity", "ord").alias("entity"))
    found = failures.join(named, [group, "variable"], "left")
    spread = found.where("entity is null").drop("entity").join(entities.select(group, "entity"), group)
    return found.where("entity is not null").unionByName(spread)


def greedy_match(scores: DataFrame, group: str) -> DataFrame:
    """Greedy assignment of a similarity matrix (group, row, col, score): rows by their best score, each takes the best free column.

    A row that no column is left for scores 0, with a null column. Scores that are null or NaN come last. A group is folded as one array of its rows.
    """
    kind = scores.schema["col"].dataType
    worth = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    cell = F.struct((-worth).isNull().alias("none"), (-worth).alias("worst_first"), "col", "score")
    rows = scores.groupBy(group, "row").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    best = F.col("cells")[0]
    line = F.struct(best["none"].alias("none"), best["worst_first"].alias("worst_first"), "row", F.transform("cells", lambda c: F.struct(c["col"].alias("col"), c["score"].alias("score"))).alias("cells"))
    groups = rows.groupBy(group).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    taken = F.array().cast(T.ArrayType(kind))
    none = F.struct(F.lit(None).cast(kind).alias("col"), F.lit(0.0).cast(scores.schema["score"].dataType).alias("score"))

    def take(state: Column, x: Column) -> Column:
        # the first free column of the row, which is in the order of its scores
        found = F.coalesce(F.try_element_at(F.filter(x["cells"], lambda c: ~F.array_contains(state["taken"], c["col"])), F.lit(1)), none)
        return F.struct(
            F.when(found["col"].isNull(), state["taken"]).otherwise(F.array_append(state["taken"], found["col"])).alias("taken"),
            F.array_append(state["out"], F.struct(x["row"].alias("row"), found["col"].alias("col"), found["score"].alias("score"))).alias("out"))

    made = T.ArrayType(T.StructType([T.StructField("row", scores.schema["row"].dataType), T.StructField("col", kind), T.StructField("score", scores.schema["score"].dataType)]))
    start = F.struct(taken.alias("taken"), F.array().cast(made).alias("out"))
    return groups.select(group, F.explode(F.aggregate("lines", start, take, lambda s: s["out"])).alias("x")).select(group, "x.row", "x.col", "x.score")


def requests_scores(rows: DataFrame, group: str, key: str, expected: Column, actual: Column) -> DataFrame:
    """Jaccard similarity of the expected and the actual keys of each group as sets; 1 if both are empty. Keys are counted, so a group may have any number of them."""
    once = rows.groupBy(group, key).agg(F.max(F.coalesce(expected, F.lit(False))).alias("a"), F.max(F.coalesce(actual, F.lit(False))).alias("b"))
    either, both = F.count_if(F.col("a") | F.col("b")), F.count_if(F.col("a") & F.col("b"))
    return once.groupBy(group).agg(F.when(either == 0, 1.0).otherwise(both / either).alias("score"))


def covered_score(matched: DataFrame, group: str) -> DataFrame:
    """Mean score of the rows of each group of a ``greedy_match``: columns that are left over cost nothing."""
    return matched.groupBy(group).agg(F.avg("score").alias("score"), F.count(F.when(F.col("col").isNull(), 1)).alias("n_unmatched"))
