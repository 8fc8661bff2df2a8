"""Named queries on experiments and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiments as X
from .catalog import _r, _t, query


@query("""WITH s AS (SELECT user_id, event_type, ROUND(AVG(value) FILTER (event_id % 2 = 0), 0) AS a, ROUND(AVG(value) FILTER (event_id % 2 = 1), 0) AS b FROM events GROUP BY ALL),
d AS (SELECT b - a AS delta FROM s WHERE a IS NOT NULL AND b IS NOT NULL),
r AS (SELECT delta, COUNT(*) OVER (PARTITION BY ABS(delta)) AS c, RANK() OVER (ORDER BY ABS(delta)) AS low FROM d),
t AS (SELECT *, low + (c - 1) / 2.0::DOUBLE AS rank FROM r),
z AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (delta = 0) AS n_zero, SUM(rank * CASE WHEN delta > 0 THEN 1.0::DOUBLE WHEN delta = 0 THEN 0.5 ELSE 0 END) AS r_plus, SUM(rank * CASE WHEN delta < 0 THEN 1.0::DOUBLE WHEN delta = 0 THEN 0.5 ELSE 0 END) AS r_minus, SUM(c::DOUBLE * c - 1) AS ties FROM t)
SELECT n, n_zero, r_plus, r_minus, ties, LEAST(r_plus, r_minus) AS statistic, ROUND((LEAST(r_plus, r_minus) - n * (n + 1) / 4.0::DOUBLE) / SQRT((n::DOUBLE * (n + 1) * (2 * n + 1) - ties / 2) / 24), 6) AS z FROM z""")
def signed_rank_test(spark, d):
    """Even events of a user and type against odd ones, means as whole numbers so that many are tied.

    Values are added in the order of events: means that lie on a half round as their sum of doubles does, which depends on its order.
    """
    from pyspark.sql import Window

    in_order = F.avg("value").over(Window.partitionBy("k").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ev = _t(spark, d, "events").withColumn("k", F.struct("user_id", "event_type"))  # null is a user and a type, as in the SQL
    side = lambda r, out: ev.where(F.col("event_id") % 2 == r).select("k", in_order.alias("mean")).groupBy("k").agg(F.round(F.first("mean"), 0).alias(out))
    found = X.signed_ranks(side(0, "a").join(side(1, "b"), "k").select((F.col("b") - F.col("a")).alias("delta")), nan=True)
    some = lambda c: F.when(F.col("n") > 0, F.col(c))
    return found.withColumns({c: some(c) for c in ("r_plus", "r_minus", "ties", "statistic")} | {"z": _r(F.col("z")), "n_zero": F.col("n_zero").cast("long")})


@query("""SELECT o_orderpriority, o_orderkey, place FROM (SELECT o_orderpriority, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY -LN((('0x' || SUBSTR(MD5('7:' || o_orderkey), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE) / o_totalprice, o_orderkey)::INTEGER AS place
FROM orders WHERE o_totalprice > 0) WHERE place <= 40""")
def weighted_sample(spark, d):
    """Forty orders of each priority, drawn by their price."""
    return X.weighted_sample(_t(spark, d, "orders"), ["o_orderpriority"], "o_orderkey", "o_totalprice", n=40, seed=7).select("o_orderpriority", "o_orderkey", "place")


@query("""WITH v AS (SELECT event_id, UNNEST([0, 1, -1, 1e15, -1e15]) AS x FROM events)
SELECT event_id, CASE WHEN MIN(ABS(x - value)) IS NULL THEN 0 ELSE COUNT(*) FILTER (ABS(x) <= 2 * GREATEST(ABS(value), 1)) END AS n_boundary, 6 + 4 AS n_cases FROM v JOIN events USING (event_id) GROUP BY event_id, value""")
def fuzz_inputs(spark, d):
    """Boundary cases and four samples after each event's value: how many boundaries lie within the samples' range, and how many cases there are."""
    from ..operators.fuzz import inputs

    ev = _t(spark, d, "events").select("event_id", "value")
    made = inputs(ev, "event_id", F.col("value").cast("string"), samples=4, seed=1).join(ev, "event_id")
    number = F.get_json_object(F.concat(F.lit('{"x":'), "input", F.lit("}")), "$.x").cast("double")
    near = F.abs(number) <= 2 * F.greatest(F.abs("value"), F.lit(1.0))
    wrong = F.count_if(~F.col("boundary") & ~near)  # samples out of range would be counted as boundaries
    return made.groupBy("event_id").agg((F.count_if(F.col("boundary") & near) + wrong).alias("n_boundary"), F.count(F.lit(1)).cast("int").alias("n_cases"))
