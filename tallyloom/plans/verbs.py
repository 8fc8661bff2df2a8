"""Named queries of verbs on tables, which extend the library: each is named ``ext_``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from .catalog import _r, _t, query


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey > 10 ORDER BY c_name DESC")
def ext_filter_arrange(spark, d):
    return _t(spark, d, "customer").where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_custkey") > 10)).orderBy(F.desc("c_name")).select("c_custkey", "c_name")


@query("SELECT event_type, ROUND(AVG(NULLIF(event_id % 5, 0)), 6) AS mean, COUNT(*) AS n FROM events GROUP BY 1")
def ext_summarise(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(_r(F.avg(F.nullif(F.col("event_id") % 5, F.lit(0)))).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, ((LENGTH(text) - LENGTH(REPLACE(text, 'e', ''))))::INTEGER AS n FROM documents")
def ext_str_count(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("e")).alias("n"))


@query("""WITH t AS (SELECT n_regionkey, n_nationkey % 3 AS k, MIN(n_nationkey) + 1 AS pos FROM nation GROUP BY ALL) SELECT s_suppkey, pos::BIGINT AS pos FROM supplier LEFT JOIN t ON n_regionkey = s_suppkey % 6 AND k = s_nationkey % 3""")
def ext_row_match(spark, d):
    """The first row, from 1, of a table that equals a row."""
    t = _t(spark, d, "nation").groupBy("n_regionkey", (F.col("n_nationkey") % 3).alias("k")).agg((F.min("n_nationkey") + 1).cast("long").alias("pos"))
    s = _t(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 6).alias("n_regionkey"), (F.col("s_nationkey") % 3).alias("k"))
    return s.join(t, ["n_regionkey", "k"], "left").select("s_suppkey", "pos")


@query("""WITH c AS (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY ALL), m AS (SELECT user_id, MAX(n) AS n FROM c GROUP BY 1), v AS (SELECT user_id, MEDIAN(value) AS med FROM events GROUP BY 1)
SELECT user_id, ROUND(med, 6) AS median, STRING_AGG(event_type, ',' ORDER BY event_type) AS modes FROM c JOIN m USING (user_id, n) JOIN v USING (user_id) GROUP BY ALL""")
def ext_typical(spark, d):
    """The median of numbers and all modes of texts."""
    ev = _t(spark, d, "events")
    counts = ev.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("r", F.rank().over(W.Window.partitionBy("user_id").orderBy(F.desc("n")))).where("r = 1")
    modes = top.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("event_type")), ",").alias("modes"))
    return ev.groupBy("user_id").agg(_r(F.median("value")).alias("median")).join(modes, "user_id")


@query("SELECT event_id, LAST_DAY(ts)::DATE AS last, (ts::DATE - (((EXTRACT(isodow FROM ts) + 6) % 7)::INTEGER))::DATE AS monday FROM events")
def ext_set_day(spark, d):
    """The last day of the month, and the Monday on or before the day."""
    day = F.col("ts").cast("date")
    return _t(spark, d, "events").select("event_id", F.last_day(day).alias("last"), F.date_sub(day, F.weekday(day)).alias("monday"))


@query("""SELECT r.l_returnflag, s.l_linestatus, COUNT(l.l_orderkey) AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem) r CROSS JOIN (SELECT DISTINCT l_linestatus FROM lineitem) s LEFT JOIN lineitem l ON l.l_returnflag = r.l_returnflag AND l.l_linestatus = s.l_linestatus GROUP BY ALL""")
def ext_contingency(spark, d):
    """Counts of all pairs of levels, also of those that no row has; levels are few."""
    li = _t(spark, d, "lineitem")
    levels = li.select("l_returnflag").distinct().crossJoin(F.broadcast(li.select("l_linestatus").distinct()))
    n = li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(n, ["l_returnflag", "l_linestatus"], "left").fillna(0, ["n"])


@query("SELECT doc_id, lang FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND NULLIF(n_chars % 3, 0) IS NOT NULL")
def ext_complete_cases(spark, d):
    return _t(spark, d, "documents").withColumn("m", F.nullif(F.col("n_chars") % 3, F.lit(0))).na.drop().select("doc_id", "lang")


@query("""WITH p AS (SELECT event_type, QUANTILE_CONT(value, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM events GROUP BY 1) SELECT event_type, UNNEST([0, 1, 2, 3, 4])::INTEGER AS place, ROUND(UNNEST(q), 6) AS value FROM p""")
def ext_profile_grid(spark, d):
    p = _t(spark, d, "events").groupBy("event_type").agg(F.percentile("value", [0.0, 0.25, 0.5, 0.75, 1.0]).alias("q"))
    return p.select("event_type", F.posexplode("q").alias("place", "value")).withColumn("value", _r(F.col("value")))


@query("""WITH g AS (SELECT user_id, event_type, AVG(value) AS y, VAR_SAMP(value) / COUNT(*) AS v FROM events GROUP BY ALL HAVING COUNT(*) > 1 AND VAR_SAMP(value) > 0)
SELECT event_type, COUNT(*) AS k, ROUND(SUM(y / v) / SUM(1 / v), 5) AS pooled FROM g GROUP BY 1""")
def ext_pooling(spark, d):
    """Means of groups pooled by the inverse of their variances."""
    g = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("y"), (F.var_samp("value") / F.count(F.lit(1))).alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1 and v > 0")
    return g.groupBy("event_type").agg(F.count(F.lit(1)).alias("k"), _r(F.sum(F.col("y") / F.col("v")) / F.sum(1 / F.col("v")), 5).alias("pooled"))


@query("""WITH c AS (SELECT event_type, AVG(value) AS m, VAR_SAMP(value) AS v, COUNT(*) AS n FROM events GROUP BY 1), a AS (SELECT VAR_SAMP(value) AS g FROM events)
SELECT event_id, ROUND(ABS(value - m) / SQRT(0.5::DOUBLE * v + 0.5::DOUBLE * g), 5) AS distance FROM events JOIN c USING (event_type), a""")
def ext_class_distance(spark, d):
    """Distance of each row to the mean of its class, by the class's variance shrunken to that of all rows."""
    ev = _t(spark, d, "events")
    classes = ev.groupBy("event_type").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    whole = ev.agg(F.var_samp("value").alias("g"))  # one row
    both = ev.join(classes.crossJoin(F.broadcast(whole)), "event_type")
    return both.select("event_id", _r(F.abs(F.col("value") - F.col("m")) / F.sqrt(0.5 * F.col("v") + 0.5 * F.col("g")), 5).alias("distance"))


@query("SELECT p_partkey, name, v AS value FROM (SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice AS price FROM part) UNPIVOT (v FOR name IN (size, price))")
def ext_unpivot(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "name", "value").where("value is not null")


@query("SELECT l_orderkey, l_linenumber, ROUND((l_discount + l_tax) / 2, 6) AS mean, l_discount > 0.05 OR l_tax > 0.05 AS any_high FROM lineitem")
def ext_row_mean(spark, d):
    a, b = F.col("l_discount"), F.col("l_tax")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _r((a + b) / 2).alias("mean"), ((a > 0.05) | (b > 0.05)).alias("any_high"))


@query("SELECT page_id, REPLACE(REPLACE(REPLACE(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe FROM pages")
def ext_sanitise(spark, d):
    safe = F.col("html")
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(plain), F.lit(written))
    return _t(spark, d, "pages").select("page_id", safe.alias("safe"))


@query("SELECT c_custkey, c_mktsegment = 'BUILDING' AS kept FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def ext_keep_at(spark, d):
    """Entries of a map with the wanted names."""
    m = F.create_map(F.col("c_mktsegment"), F.lit(1))
    kept = F.map_filter(m, lambda k, v: k.isin("BUILDING", "MACHINERY"))
    return _t(spark, d, "customer").select("c_custkey", F.map_contains_key(kept, "BUILDING").alias("kept"), F.size(kept).alias("n")).where("n > 0").drop("n")


@query("""SELECT 'region' AS name, COUNT(*) AS n_rows, 2 AS n_cols FROM region UNION ALL SELECT 'nation', COUNT(*), 3 FROM nation UNION ALL SELECT 'labels', COUNT(*), 3 FROM labels""")
def ext_inventory(spark, d):
    out = None
    for name in ("region", "nation", "labels"):
        t = _t(spark, d, name)
        row = t.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(t.columns)).alias("n_cols"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT n_nationkey, i::INTEGER AS place, SUBSTR(n_name, i + 1, 1) AS piece FROM nation, (SELECT UNNEST(RANGE(0, 20)) AS i) WHERE i < LENGTH(n_name)")
def ext_split(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", F.posexplode(F.regexp_extract_all("n_name", F.lit("(?s)."), F.lit(0))).alias("place", "piece"))
