"""Scores of comparisons: kinds, dimensions, aggregates, rankings and experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

DIMENSIONS = ("type_match", "control_flow_match", "data_output", "variable_output", "callable_output", "side_effects")
_DATA_KINDS = ("VARIABLE", "CONSTANT")
_CALLS = ("FUNCTION_CALL", "EXTERNAL_SYMBOL")


def compare_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of verdicts and the mean score of each group."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), n("pass").alias("n_pass"), n("missing").alias("n_missing"), F.avg((F.col("verdict") == "pass").cast("double")).alias("score"))


def kind_scores(kind: Column, ok: Column, data: Column, stdout: Column, global_data: Column) -> Column:
    """type, control_flow and callable scores of an entity by its kind."""
    s = lambda a, b, c: F.struct(a.cast("double").alias("type_score"), b.cast("double").alias("flow_score"), c.cast("double").alias("callable_score"))
    one = F.lit(1.0)
    return (
        F.when(kind.isin(*_DATA_KINDS), s(data, ok, one))
        .when(kind == "FUNCTION_DEF", s(ok, stdout, global_data))
        .when(kind.isin(*_CALLS), s(data, data, data))
        .otherwise(s(ok, ok, one))
    )


def active_dimensions(kind: Column, has_data: Column, has_stdout: Column, has_effects: Column) -> dict[str, Column]:
    calls, definition, values = kind.isin(*_CALLS), kind == "FUNCTION_DEF", kind.isin(*_DATA_KINDS)
    return {
        "type_match": ~(values | calls) | has_data,
        "control_flow_match": (definition & has_stdout) | (calls & has_data) | ~(definition | calls),
        "data_output": has_data,
        "variable_output": has_data,
        "callable_output": (definition | calls) & has_data,
        "side_effects": has_effects | has_stdout,
    }


def mean_of_active(active: dict[str, Column], scores: dict[str, Column], otherwise: Column) -> Column:
    """Mean of the active dimensions' scores; ``otherwise`` if none is active."""
    n = sum((F.when(a, 1).otherwise(0) for a in active.values()), F.lit(0))
    total = sum((F.when(a, scores[k]).otherwise(0.0) for k, a in active.items()), F.lit(0.0))
    return F.when(n > 0, total / n).otherwise(otherwise)


def aggregate_score(entities: DataFrame, by: str) -> DataFrame:
    """0 where only the actual side crashed; else the mean over entities with output, or over all if none has any."""
    means = entities.groupBy(by).agg(F.avg(F.when(F.col("has_output"), F.col("score"))).alias("a"), F.avg("score").alias("b"), F.max((F.col("expected_ok") & ~F.col("actual_ok")).cast("int")).alias("crash"))
    return means.select(by, F.when(F.col("crash") == 1, 0.0).otherwise(F.coalesce("a", "b", F.lit(1.0))).alias("aggregate"))


def proxy_score(expected: dict[str, Column], actual: dict[str, Column], scores: dict[str, Column], otherwise: Column) -> Column:
    """Mean of the effects that the expected side has; 1 if neither has any, ``otherwise`` if only the actual side has."""
    n = sum((x.cast("int") for x in expected.values()), F.lit(0))
    total = sum((F.when(x, scores[k]).otherwise(0.0) for k, x in expected.items()), F.lit(0.0))
    some = sum((x.cast("int") for x in actual.values()), F.lit(0))
    return F.when(n > 0, total / n).when(some == 0, 1.0).otherwise(otherwise)


def side_effect_mean(rows: DataFrame, by: str) -> DataFrame:
    """Mean over effects; FILES and ENV don't count where HTML compared well by content."""
    html = F.max(F.when((F.col("effect") == "HTML") & (F.col("score") >= 0.7) & F.col("explanation").startswith("html_content_compared:"), 1).otherwise(0)).alias("html")
    flag = rows.groupBy(by).agg(html)
    kept = rows.join(flag, by).where((F.col("html") == 0) | ~F.col("effect").isin("FILES", "ENV"))
    return flag.select(by).join(kept.groupBy(by).agg(F.avg("score").alias("m")), by, "left").select(by, F.coalesce("m", F.lit(1.0)).alias("side_effects"))


def bundle_merge(parts: DataFrame, by: str, order: str) -> DataFrame:
    """Texts joined in order, run times added, the last exit code, for each name the last value."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "stdout"))), lambda x: x["stdout"]), "")
    return parts.groupBy(by).agg(text.alias("stdout"), F.sum("run_time_s").alias("run_time_s"), F.max_by("exit_code", order).alias("exit_code"), F.count(F.lit(1)).alias("n_parts"))


def last_write(parts: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    return parts.groupBy(*by).agg(F.max_by(value, order).alias(value))


def coverage(rows: DataFrame, statuses: list[str]) -> DataFrame:
    """Rows of every status, also of those that no row has, and their share (1 for no rows)."""
    names = rows.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    counts = names.join(rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("status", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(1.0).alias("share"))


def best_status(rows: DataFrame, by: str, statuses: list[str]) -> DataFrame:
    """The status of the least rank that a key has had."""
    rank = F.array_position(F.array(*[F.lit(s) for s in statuses]), F.col("status"))
    return rows.groupBy(by).agg(F.min_by("status", rank).alias("status"))


def ndcg(rows: DataFrame, group: str, score: str, gain: str, tie: str, k: int, ideal_of_first: bool = False) -> DataFrame:
    """NDCG@k of each group. ``ideal_of_first``: the ideal order is that of the first k candidates only."""
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie))))
    pool = ranked.where(F.col("r") <= k) if ideal_of_first else ranked
    best = pool.withColumn("i", F.row_number().over(Window.partitionBy(group).orderBy(F.col(gain).desc(), F.col(tie))))
    part = lambda at: F.sum(F.when(F.col(at) <= k, F.col(gain) / F.log2(F.col(at) + 1)).otherwise(0.0))
    sums = best.groupBy(group).agg(part("r").alias("dcg"), part("i").alias("idcg"))
    return sums.select(group, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def grouped_folds(rows: DataFrame, group: str, order: str, n_folds: int) -> DataFrame:
    """Contiguous folds of groups in the order in which they are first seen; what is left over is in no fold (null)."""
    first = rows.groupBy(group).agg(F.min(order).alias("first_seen"))
    ranked = numbered(first, ["first_seen", group], "place").withColumn("place", (F.col("place") - 1).cast("int"))
    total = first.agg(F.count(F.lit(1)).alias("total"))
    fold = F.floor(F.col("place") / F.floor(F.col("total") / n_folds))
    return ranked.crossJoin(F.broadcast(total)).select(group, "place", F.when(fold < n_folds, fold).alias("fold"))


def paired_deltas(a: DataFrame, b: DataFrame, key: str, score: str) -> DataFrame:
    """Pairs of both sides of an experiment, without NaN or null on either."""
    both = a.select(key, F.col(score).alias("score_a")).join(b.select(key, F.col(score).alias("score_b")), key)
    return both.where("score_a is not null and score_b is not null and not isnan(score_a) and not isnan(score_b)").withColumn("delta", F.col("score_b") - F.col("score_a"))


def sign_test(pairs: DataFrame) -> DataFrame:
    """n, mean_delta, n_regressions and the two-tailed sign test's p (1 for under two pairs or none that differ)."""
    from ..functions.scalar import binomial_tail

    @F.udf("double")
    def tail(k, n):  # one row
        return min(2 * binomial_tail(k, n), 1.0) if n else 1.0

    pos, neg = F.count(F.when(F.col("delta") > 0, 1)), F.count(F.when(F.col("delta") < 0, 1))
    got = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean_delta"), pos.alias("n_improved"), neg.alias("n_regressions"))
    p = tail(F.greatest("n_improved", "n_regressions"), F.col("n_improved") + F.col("n_regressions"))
    return got.withColumn("p_value", F.when(F.col("n") < 2, 1.0).otherwise(p))


def score_table(entities: DataFrame, expected: DataFrame, actual: DataFrame, variables: DataFrame, ran: bool, mapped: bool, data: float, stdout: float, effects: float) -> DataFrame:
    """Scores of each entity (id, name, kind, lines: whether it has lines of the translation, before_crash).

    ``expected`` and ``actual`` have what was seen at each entity (id, has_data, has_stdout, n_graphics), ``actual`` the scores against the
    other side too (data, stdout, graphics). An entity that the expected side never reached, although it reached others, is empty there; one
    that the translation has no lines of is empty on the actual side where lines are known (``mapped``). If the entity ran and both sides
    are known, its data score is the mean over the effects that the expected side has, or 1 if neither side has any; else the
    scores of the whole run count: that of the variable of its name (``variables``: name, score), or ``data``. A run that crashed (not ``ran``)
    has neither: there they are 0.
    """
    some = expected.limit(1).agg(F.count(F.lit(1)).alias("reached"))  # one row
    x = expected.select("id", F.lit(True).alias("seen"), "has_data", "has_stdout", "n_graphics")
    y = actual.select("id", F.lit(True).alias("found"), *[F.col(c).alias(f"other_{c}") for c in ("has_data", "has_stdout", "n_graphics")], *[F.col(c).alias(f"score_{c}") for c in ("data", "stdout", "graphics")])
    rows = entities.join(x, "id", "left").join(y, "id", "left").crossJoin(F.broadcast(some)).join(variables.select("name", F.col("score").alias("of_name")), "name", "left")
    ok = F.lit(ran) | F.coalesce("before_crash", F.lit(False))
    left = F.coalesce("seen", F.col("reached") > 0)
    right = F.coalesce("found", F.lit(mapped) & ~F.col("lines"))
    has = {"data": F.coalesce("has_data", F.lit(False)), "stdout": F.coalesce("has_stdout", F.lit(False)), "graphics": F.coalesce(F.col("n_graphics") > 0, F.lit(False))}
    other = {"data": F.coalesce("other_has_data", F.lit(False)), "stdout": F.coalesce("other_has_stdout", F.lit(False)), "graphics": F.coalesce(F.col("other_n_graphics") > 0, F.lit(False))}
    # A side that is empty scores 1 against an empty one, else 0.
    score = {k: F.coalesce(F.col(f"score_{k}"), F.when(has[k] == other[k], 1.0).otherwise(0.0)) for k in has}
    n = sum((h.cast("int") for h in has.values()), F.lit(0))
    total = sum((F.when(h, score[k]).otherwise(0.0) for k, h in has.items()), F.lit(0.0))
    silent = ~(other["data"] | other["stdout"] | other["graphics"])
    own = ok & left & right & ((n > 0) | silent)
    data_score = F.when(own, F.when(n > 0, total / n).otherwise(1.0)).otherwise(F.coalesce("of_name", F.lit(data)) if ran else F.lit(0.0))
    return rows.select("id", ok.alias("executed_ok"), own.alias("per_entity"), data_score.alias("data_output"), F.when(own, score["stdout"]).otherwise(F.lit(stdout)).alias("stdout_output"), F.when(own, (score["graphics"] + score["stdout"]) / 2).otherwise(F.lit(effects)).alias("side_effects"))


def representatives(rows: DataFrame, name: str, code: str, order: str) -> DataFrame:
    """One row for each name: the first whose code defines it (def name(), dots and colons as underscores), else the first."""
    plain = F.replace(F.replace(F.col(name), F.lit("::"), F.lit(".")), F.lit("."), F.lit("_"))
    defines = F.contains(F.col(code), F.concat(F.lit("def "), plain, F.lit("(")))
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(name).orderBy(defines.desc(), order))).where("__n = 1").drop("__n")


def last_fifth(rows: DataFrame, unit: str, order: str) -> DataFrame:
    """Units in the order in which they are first seen, with validation: the last fifth, of which the first unit is never one."""
    first = rows.groupBy(unit).agg(F.min(order).alias("seen"))
    placed = numbered(first, ["seen", unit], "place")
    total = first.agg(F.count(F.lit(1)).alias("total"))
    return placed.crossJoin(F.broadcast(total)).select(unit, (F.col("place") > F.greatest(F.lit(1), F.floor(F.col("total") * 0.8))).alias("validation"))


def numbered(rows: DataFrame, order: list, out: str, parts: int = 64) -> DataFrame:
    """``rows`` with their place, from 1, in the order of columns of which the last tells all rows apart.

    Range partitions are numbered each for itself and moved by the rows of those before, so no task sees all rows.
    """
    ranged = written(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.withColumn("__before", F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).drop("__size")  # a row a part
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(before), "__part").withColumn(out, place + F.col("__before")).drop("__part", "__before")
