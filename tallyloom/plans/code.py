"""Named queries on sources of functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import structure as S
from ..operators.closure import callee_closure as closure
from .catalog import _t, query


@query("""WITH RECURSIVE n AS (SELECT l_orderkey, l_partkey AS p, LEAD(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS c FROM lineitem),
calls AS (SELECT p, LIST(c ORDER BY first, c) AS cs FROM (SELECT p, c, MIN(l_orderkey) AS first FROM n WHERE c IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
w(query, queue, seen, spent, place, symbol, lines) AS (
  SELECT p_partkey, [p_partkey], [p_partkey], 0::BIGINT, -1::BIGINT, NULL::BIGINT, 0::BIGINT FROM part
  UNION ALL
  SELECT w.query, LIST_CONCAT(w.queue[2:], new), LIST_CONCAT(w.seen, new), w.spent + LEAST(p_size, 80, 200 - w.spent), w.place + 1, p_partkey, LEAST(p_size, 80, 200 - w.spent)::BIGINT
  FROM w JOIN part ON p_partkey = w.queue[1] LEFT JOIN calls ON calls.p = p_partkey, LATERAL (SELECT LIST_FILTER(COALESCE(cs, []), lambda c: NOT LIST_CONTAINS(w.seen, c)) AS new)
  WHERE LEN(w.queue) > 0 AND w.spent < 200)
SELECT query, place, symbol, lines FROM w WHERE place >= 0""")
def callee_closure(spark, d):
    """Parts call the parts that follow them in an order: what each reaches within 200 lines, a part having as many as its size."""
    part = _t(spark, d, "part")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    calls = _t(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("symbol"), after.alias("callee")).where("callee is not null")
    calls = calls.groupBy("symbol", "callee").agg(F.min("l_orderkey").alias("ord")).withColumn("package", F.lit("p"))
    queries = part.select(F.col("p_partkey").alias("query"), F.col("p_partkey").alias("symbol"))
    found = closure(queries, queries.select("query", F.lit("p").alias("package"), F.lit(0).alias("ord")), part.select(F.lit("p").alias("package"), F.col("p_partkey").alias("symbol"), F.col("p_size").cast("long").alias("lines")), calls)
    return found.select("query", "place", "symbol", "lines")


@query(r"""WITH t AS (SELECT conv_id, turn, TRANSLATE(text, '{}()', '') AS x FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN x || chr(10) || 'g()' || chr(10) WHEN turn % 4 = 1 THEN '  f(1)' || chr(10) || x WHEN turn % 4 = 2 THEN '  x <- 1' || chr(10) || x || chr(10) || '  if (y) {' || chr(10) || '  }' || chr(10) ELSE x END AS stripped FROM t""")
def guard_strip(spark, d):
    """Turns as sources, guarded in several ways."""
    x, k = F.translate("text", "{}()", ""), F.col("turn")
    join = lambda *c: F.concat(*[F.lit(s) if isinstance(s, str) else s for s in c])
    source = (
        F.when(k % 4 == 0, join("if (interactive()) {\n", x, "\n}\ng()\n")).when(k % 4 == 1, join("  if (requireNamespace('a', quietly = TRUE)) f(1)\n", x))
        .when(k % 4 == 2, join("if(FALSE){\n  x <- 1\n", x, "\n  if (y) {\n  }\n}\n")).otherwise(x)
    )
    return _t(spark, d, "conversations").select("conv_id", "turn", S.guard_strip(source).alias("stripped"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'f(' || p_size || ', g("' || p_name || '", b=2), k=' || p_partkey || ')' WHEN 1 THEN 'f("' || p_name || ', (", k=' || p_size || ')' ELSE 'f(k = 1' END AS code FROM part""")
def call_reorder(spark, d):
    """Calls on parts, those with a positional argument after a keyword put in order."""
    k, n, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size")
    join = lambda *c: F.concat(*[F.lit(s) if isinstance(s, str) else s for s in c])
    code = F.when(k % 3 == 0, join("f(k=", k, ", ", size, ', g(b=2, "', n, '"))')).when(k % 3 == 1, join("f(k=", size, ', "', n, ', (")')).otherwise("f(k = 1")
    return _t(spark, d, "part").select("p_partkey", S.call_reorder(code).alias("code"))
