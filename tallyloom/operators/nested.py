"""Comparison of nested values (VARIANT): level by level, only where both sides have the same shape so far.

A pair of values is a row; lists of one length and maps of one key set give a row for each element, in the same
partition, so nothing is shuffled until the failures of all levels are brought together by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compare import ATOL, RTOL, formals_score, text_similarity, within
from .tables import written

#: The member that marks a map as the description of a callable.
CALLABLE = "__callable_meta__"
_MAP, _LIST = "map<string,variant>", "array<variant>"


def kind(v: Column) -> Column:
    """null (also NaN), bool, number, text, list or map."""
    s = F.schema_of_variant(v)
    number = F.when(F.isnan(F.try_variant_get(v, "$", "double")), "null").otherwise("number")
    return (
        F.when(v.isNull() | F.is_variant_null(v) | (s == "VOID"), "null").when(s == "BOOLEAN", "bool").when(s.startswith("ARRAY<"), "list").when(s.startswith("OBJECT<"), "map")
        .when(s.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), number).otherwise("text")
    )


def finite_value(x: Column, kind: T.DataType) -> Column:
    """A typed value as VARIANT, at any depth: NaN becomes null, infinities the texts Inf and -Inf."""
    text = lambda s: F.lit(s).cast("variant")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(x), F.lit(None)).when(x == float("inf"), text("Inf")).when(x == float("-inf"), text("-Inf")).otherwise(x.cast("variant"))
    if isinstance(kind, T.ArrayType):
        return F.to_variant_object(F.transform(x, lambda v: finite_value(v, kind.elementType)))
    if isinstance(kind, T.MapType):
        return F.to_variant_object(F.transform_values(x, lambda k, v: finite_value(v, kind.valueType)))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.to_variant_object(F.struct(*[finite_value(x[f.name], f.dataType).alias(f.name) for f in kind.fields])))
    return x.cast("variant")


def _judged(pairs: DataFrame, rtol: float, atol: float, sentinel: str) -> DataFrame:
    """tag (null where nothing fails here), reason, score and whether the elements are to be compared."""
    e, a = F.col("e"), F.col("a")
    get = lambda v, t: F.try_variant_get(v, "$", t)
    df = pairs.withColumns({"ke": kind(e), "ka": kind(a)})
    both = lambda *kinds: F.col("ke").isin(*kinds) & F.col("ka").isin(*kinds)
    number = lambda v, k: F.when(F.col(k) == "bool", get(v, "boolean").cast("int").cast("double")).otherwise(get(v, "double"))
    df = df.withColumns({"el": F.when(both("list"), get(e, _LIST)), "al": F.when(both("list"), get(a, _LIST)), "em": F.when(both("map"), get(e, _MAP)), "am": F.when(both("map"), get(a, _MAP))})
    keys = lambda m: F.array_sort(F.map_keys(m))
    marked = lambda m: F.coalesce(kind(F.try_element_at(m, F.lit(sentinel))).isin("bool", "number", "text", "list", "map"), F.lit(False)) & F.coalesce(F.try_variant_get(F.try_element_at(m, F.lit(sentinel)), "$", "boolean"), F.lit(True))
    formals = lambda m: F.coalesce(F.try_variant_get(F.try_element_at(m, F.lit("formals")), "$", "array<string>"), F.array().cast("array<string>"))
    attributes = lambda m: F.transform_values(F.coalesce(F.try_variant_get(F.try_element_at(m, F.lit("attributes")), "$", _MAP), F.create_map().cast(_MAP)), lambda k, v: F.to_json(v))
    df = df.withColumn("callables", both("map") & marked(F.col("em")) & marked(F.col("am")))
    df = df.withColumn("likeness", F.when(F.col("callables"), formals_score(formals(F.col("em")), formals(F.col("am")), attributes(F.col("em")), attributes(F.col("am")))))
    reason = (
        F.when(both("null"), None).when((F.col("ke") == "null") | (F.col("ka") == "null"), "null")
        .when(both("bool", "number"), F.when(~within(number(e, "ke"), number(a, "ka"), rtol, atol), "number"))
        .when(both("text"), F.when(get(e, "string") != get(a, "string"), "text"))
        .when(both("list"), F.when(F.size("el") != F.size("al"), "length"))
        .when(F.col("callables"), F.when(F.col("likeness") < 0.95, "callable"))
        .when(both("map"), F.when(keys(F.col("em")) != keys(F.col("am")), "keys"))
        .otherwise("type")
    )
    df = df.withColumn("reason", reason)
    tag = F.when(F.col("reason").isin("length", "keys", "type") | ((F.col("reason") == "callable") & (F.col("likeness") >= 0.5)), "infra").when(F.col("reason").isNotNull(), "value")
    further = F.col("reason").isNull() & ~F.col("callables")
    names = keys(F.col("em"))
    element = lambda i, at, x, y: F.struct(i.cast("int").alias("i"), at.alias("at"), x.alias("e"), y.alias("a"))
    listed = F.transform(F.zip_with("el", "al", lambda x, y: F.struct(x.alias("e"), y.alias("a"))), lambda p, i: element(i, F.concat(F.lit("["), i.cast("string"), F.lit("]")), p.e, p.a))
    mapped = F.transform(names, lambda k, i: element(i, F.concat(F.lit("."), k), F.col("em")[k], F.col("am")[k]))
    df = df.withColumns({"tag": tag, "score": F.coalesce(F.when(F.col("reason") == "callable", F.col("likeness")), F.lit(0.0))})
    return df.withColumn("inner", F.when(further & both("list"), listed).when(further & both("map"), mapped))


def nested_compare(pairs: DataFrame, keys: list[str], rtol: float = RTOL, atol: float = ATOL, sentinel: str = CALLABLE) -> DataFrame:
    """keys, score, verdict, tag, at and reason of each pair of VARIANT columns e (expected) and a (actual); keys are unique.

    Rules, in this order: nulls (and NaN) are equal to each other and to nothing else (value); booleans count as 0 and 1 beside
    numbers; numbers within the tolerance (value); texts equal (value); lists need one length (infra) and equal elements; maps that
    ``sentinel`` marks on both sides are callables, which pass from a likeness of 0.95 (infra from 0.5, else value); other maps
    need the same keys (infra) and equal members; anything else is a mismatch of types (infra). A pair fails with the first failure
    in the order of places and sorted keys, ``at`` it; its score is 0, but for callables that are the value itself. One round for each level of nesting.
    """
    front = pairs.select(*keys, F.array().cast("array<int>").alias("order"), F.lit("").alias("at"), "e", "a")
    failed = None
    while True:
        level = written(_judged(front, rtol, atol, sentinel).select(*keys, "order", "at", "tag", "reason", "score", "inner"), "nested")
        # the first level has every pair, so pairs without a failure keep a row
        here = level.select(*keys, F.when(F.col("tag").isNotNull(), F.struct("order", "at", "tag", "reason", "score")).alias("f"))
        failed = here if failed is None else failed.unionByName(here.where("f is not null"))
        deeper = level.where("size(inner) > 0")
        if deeper.isEmpty():
            break
        front = deeper.select(*keys, "order", F.col("at").alias("upper"), F.explode("inner").alias("x")).select(*keys, F.concat("order", F.array("x.i")).alias("order"), F.concat("upper", "x.at").alias("at"), "x.e", "x.a")
    # No join: its side would look small beside what its files hold, and be broadcast through the driver.
    out = failed.groupBy(*keys).agg(F.min("f").alias("f"))
    fails = F.col("f").isNotNull()
    return out.select(
        *keys, F.when(~fails, 1.0).when(F.size("f.order") == 0, F.col("f.score")).otherwise(0.0).alias("score"), F.when(fails, "fail").otherwise("pass").alias("verdict"),
        F.col("f.tag").alias("tag"), F.col("f.at").alias("at"), F.col("f.reason").alias("reason"))


def data_scores(expected: DataFrame, actual: DataFrame, uncapturable: DataFrame | None = None, mode: str = "auto", rtol: float = RTOL, atol: float = ATOL) -> tuple[DataFrame, DataFrame]:
    """Scores of variables (run, name, value as VARIANT), and of runs.

    Variables: run, name, score, tag, reason, fallback; uncapturable ones (run, name) are left out, variables that only the actual side has don't count.
    ``exact`` scores as ``nested_compare`` does; ``auto`` replaces failures of kind infra by the similarity of the JSON texts;
    ``embedding`` takes that similarity for all. A missing variable scores 0. Runs: run, score (the mean), verdict, n_scored,
    n_uncomparable: uncomparable with 0 where all are uncapturable, pass with 1 where nothing is expected, pass_via_fallback from 0.9 if
    a similarity was taken, pass from 1, else fail.
    """
    if mode not in ("auto", "exact", "embedding"):
        raise ValueError(f"mode must be auto, exact or embedding, not {mode}")
    key = ["run", "name"]
    left = expected.select(*key, F.col("value").alias("e"))
    flagged = left.select(*key).join(uncapturable.select(*key).distinct(), key, "left_semi") if uncapturable is not None else left.select(*key).where("false")
    counted = left.join(flagged, key, "left_anti").join(actual.select(*key, F.col("value").alias("a"), F.lit(True).alias("present")), key, "left")
    counted = written(counted.withColumn("present", F.coalesce("present", F.lit(False))), "data-pairs")
    there = counted.where("present")
    missing = counted.where("not present").select(*key, F.lit(0.0).alias("score"), F.lit("value").alias("tag"), F.lit("missing").alias("reason"), F.lit(False).alias("fallback"))
    text = lambda c: F.coalesce(F.to_json(F.col(c)), F.lit("null"))
    if mode == "embedding":
        likened = there.select(*key, text("e").alias("x"), text("a").alias("y"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("string").alias("reason"))
        kept = None
    else:
        found = written(nested_compare(there, key, rtol, atol), "data-found")
        infra = F.coalesce(F.col("tag") == "infra", F.lit(False)) if mode == "auto" else F.lit(False)
        rescue = found.where(infra).hint("merge")
        kept = found.where(~infra).select(*key, "score", "tag", "reason", F.lit(False).alias("fallback"))
        likened = there.join(rescue.select(*key, "tag", "reason"), key).select(*key, text("e").alias("x"), text("a").alias("y"), "tag", "reason")
    if mode != "exact":
        likened = text_similarity(likened, "x", "y", "score").select(*key, "score", "tag", "reason", (F.col("score") > 0 if mode == "auto" else F.lit(True)).alias("fallback"))
        kept = likened if kept is None else kept.unionByName(likened)
    variables = written(kept.unionByName(missing), "data-scores")
    runs = expected.select("run").union(actual.select("run")).distinct()
    n = variables.groupBy("run").agg(F.count(F.lit(1)).alias("n_scored"), F.avg("score").alias("mean"), F.max("fallback").alias("fallback"))
    u = flagged.groupBy("run").agg(F.count(F.lit(1)).alias("n_uncomparable"))
    joined = runs.join(n, "run", "left").join(u, "run", "left").fillna(0, ["n_scored", "n_uncomparable"])
    nothing = F.col("n_scored") == 0
    return variables, joined.select(
        "run", F.when(nothing, (F.col("n_uncomparable") == 0).cast("double")).otherwise(F.col("mean")).alias("score"),
        F.when(nothing, F.when(F.col("n_uncomparable") > 0, "uncomparable").otherwise("pass")).when(F.col("fallback") & (F.col("mean") >= 0.9), "pass_via_fallback").when(F.col("mean") >= 1, "pass").otherwise("fail").alias("verdict"),
        "n_scored", "n_uncomparable")
