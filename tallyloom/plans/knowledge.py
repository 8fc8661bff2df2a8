"""Named queries on the upkeep of knowledge: evidence, indexes, seeds, ranking labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import windows as W
from ..sources import readers
from .catalog import _PATTERNS, _RETRIEVED, _patterns, _r, _retrieved, _t, query


@query(f"""WITH {_PATTERNS}, f AS (SELECT event_id AS "at", CASE WHEN event_id % 9 = 0 THEN '' ELSE (user_id * 3)::VARCHAR END AS pattern, value - 50 AS delta, CASE WHEN event_id % 4 = 1 THEN ' rule ' || event_type || ' ' WHEN event_id % 4 = 2 THEN '  ' END AS guidance FROM events),
k AS (SELECT f.*, id IS NOT NULL AS known, TRIM(COALESCE(f.guidance, '')) <> '' AS says FROM f LEFT JOIN p ON id::VARCHAR = pattern WHERE pattern <> ''),
b AS (SELECT *, MIN("at") FILTER (says) OVER (PARTITION BY pattern) AS begins FROM k)
SELECT pattern, NOT known AS created, COUNT(*) AS evidence, COUNT(*) FILTER (delta > 0) AS real_evidence, ROUND(SUM(GREATEST(0, delta)), 4) AS gain, ARG_MIN(TRIM(guidance), "at") FILTER (says) AS guidance FROM b WHERE known OR "at" >= begins GROUP BY ALL""")
def record_evidence(spark, d):
    k = F.col("event_id")
    facts = _t(spark, d, "events").select(
        k.alias("at"), F.when(k % 9 == 0, "").otherwise((F.col("user_id") * 3).cast("string")).alias("pattern"), (F.col("value") - 50).alias("delta"),
        F.when(k % 4 == 1, F.concat(F.lit(" rule "), "event_type", F.lit(" "))).when(k % 4 == 2, "  ").alias("guidance"),
    )
    known = _patterns(spark, d).select(F.col("id").cast("string").alias("id"))
    return E.recorded(facts, known).withColumn("gain", _r(F.col("gain"), 4))


@query(f"WITH {_PATTERNS} SELECT id FROM p WHERE id % 2 = 0 AND NOT seed AND confidence <> 'contradicted' AND real_evidence = 0")
def prune_unimproved(spark, d):
    p = _patterns(spark, d)
    return E.unimproved(p, p.where("id % 2 = 0")).select("id")


@query(f"""WITH {_PATTERNS}, o2 AS (SELECT id, confidence, contradicted_at FROM p WHERE id % 4 <> 1), n AS (SELECT id, 'contradicted' AS confidence, CASE WHEN id % 9 = 0 THEN 99 END AS stamp FROM p WHERE id % 3 = 0 OR id % 4 = 1)
SELECT COALESCE(o2.id, n.id) AS id, COALESCE(n.confidence, o2.confidence) AS confidence, COALESCE(stamp, contradicted_at, 0)::INTEGER AS contradicted_at FROM o2 FULL OUTER JOIN n ON o2.id = n.id""")
def index_upsert(spark, d):
    p = _patterns(spark, d)
    new = p.where("id % 3 = 0 or id % 4 = 1").select("id", F.lit("contradicted").alias("confidence"), F.when(F.col("id") % 9 == 0, 99).alias("contradicted_at"))
    return E.index_upsert(p.where("id % 4 <> 1"), new)


@query(f"""WITH {_PATTERNS}, g AS (SELECT package, shape, MIN(LOWER(guidance)) AS a, MAX(LOWER(guidance)) AS b FROM p WHERE confidence = 'confirmed' GROUP BY ALL HAVING MIN(LOWER(guidance)) <> MAX(LOWER(guidance)))
SELECT id, 'tentative' AS after FROM p JOIN g ON p.package = g.package AND p.shape = g.shape WHERE confidence = 'confirmed'""")
def conflict_demotion(spark, d):
    return E.demoted_by_conflict(_patterns(spark, d))


@query(f"""WITH {_PATTERNS}, g AS (SELECT package, shape, LOWER(guidance) AS said, MIN(id) AS id FROM p WHERE confidence = 'confirmed' GROUP BY ALL), m AS (SELECT package, shape, MIN(said) AS said FROM g GROUP BY ALL)
SELECT 'conflict_' || LEAST(a.id, b.id) || '_vs_' || GREATEST(a.id, b.id) AS id, 'tentative' AS confidence, 'Conflict detected between `' || LEAST(a.id, b.id) || '` and `' || GREATEST(a.id, b.id) || '`. Both have been demoted to tentative. Human review required.' AS guidance
FROM m JOIN g a USING (package, shape, said) JOIN g b ON a.package = b.package AND a.shape = b.shape AND a.said < b.said""")
def conflict_notes(spark, d):
    return E.conflict_notes(_patterns(spark, d)).select("id", "confidence", "guidance")


@query(f"WITH {_PATTERNS} SELECT id, package FROM p WHERE seed")
def reset_seeds(spark, d):
    return E.seeds_only(_patterns(spark, d)).select("id", "package")


@query("SELECT event_type, COUNT(*) AS runs, COUNT(*) % 10 = 0 AS review_due FROM events GROUP BY 1")
def periodic_review(spark, d):
    """Runs counted from their facts; every tenth is followed by a review."""
    n = F.count(F.lit(1))
    return _t(spark, d, "events").groupBy("event_type").agg(n.alias("runs"), (n % 10 == 0).alias("review_due"))


@query("""WITH b AS (SELECT o_orderkey, o_orderpriority || '-' || CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS base FROM orders), t AS (SELECT base, UNNEST([0, 1, 4]) AS s FROM (SELECT DISTINCT base FROM b WHERE base LIKE '%-a')),
f AS (SELECT base, i, ROW_NUMBER() OVER (PARTITION BY base ORDER BY i) AS n FROM (SELECT DISTINCT base FROM b), (SELECT UNNEST(RANGE(0, (SELECT COUNT(*) + 5 FROM orders))) AS i) WHERE (base, i) NOT IN (SELECT (base, s) FROM t)),
w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY base ORDER BY o_orderkey) AS n FROM b) SELECT o_orderkey, CASE WHEN i = 0 THEN w.base ELSE w.base || '-' || i END AS id FROM w JOIN f ON w.base = f.base AND w.n = f.n""")
def allocate_ids(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit("-"), F.when(F.col("o_custkey") % 2 == 0, "a").otherwise("b")).alias("base"))
    bases = rows.where("base like '%-a'").select("base").distinct()
    taken = bases.select(F.explode(F.array(F.col("base"), F.concat("base", F.lit("-1")), F.concat("base", F.lit("-4")), F.concat("base", F.lit("-04")))).alias("id"))
    return W.allocated_ids(rows, taken, "base", ["o_orderkey"]).select("o_orderkey", "id")


@query("""SELECT c_custkey AS id, c_mktsegment AS package FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0 AND CONTAINS('g → ' || c_name, '→')""")
def list_patterns(spark, d):
    """Patterns of one package that say what becomes what."""
    p = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("package"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("g → "), "c_name")).otherwise(F.col("c_name")).alias("guidance"))
    return p.where((F.col("package") == "BUILDING") & F.contains("guidance", F.lit("→"))).orderBy("package", "id").drop("guidance")


@query("SELECT doc_id AS id, text IS NOT NULL AS found, 0 AS tier FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT item_id + 1000000000, TRUE, 1 FROM benchmark")
def store_get(spark, d):
    """Rows by id from the flat store, and from the nested one for those that it lacks."""
    labels, other = _t(spark, d, "labels"), (F.col("item_id") + 1_000_000_000).cast("long").alias("id")
    flat = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").isNotNull().alias("found"))
    nested = _t(spark, d, "benchmark").select(other, F.col("text").isNotNull().alias("found"))
    ids = labels.select(F.col("doc_id").alias("id")).union(nested.select("id"))
    return readers.store_get(ids, flat, nested)


@query("SELECT DISTINCT url AS id FROM pages ORDER BY url")
def list_ids(spark, d):
    return _t(spark, d, "pages").select(F.col("url").alias("id")).distinct().orderBy("id")


@query("SELECT event_type AS model, ARG_MAX('m-' || event_id, event_id) AS newest FROM events WHERE event_id % 3 <> 0 GROUP BY 1")
def latest_model(spark, d):
    m = _t(spark, d, "events").where("event_id % 3 <> 0")  # those with a file
    return m.groupBy(F.col("event_type").alias("model")).agg(F.max_by(F.concat(F.lit("m-"), F.col("event_id").cast("string")), "event_id").alias("newest"))


@query(f"""WITH {_RETRIEVED}, r AS (SELECT * FROM top WHERE rank <= 8) SELECT query, (ROW_NUMBER() OVER (PARTITION BY query ORDER BY LENGTH(id) DESC, rank))::INTEGER AS place, id FROM r""")
def retrieve_rerank(spark, d):
    """The first patterns of a query in the order of a model's score, here the length of the id; equal scores keep their order."""
    r = _retrieved(spark, d, 8)
    place = F.row_number().over(W.Window.partitionBy("query").orderBy(F.length("id").desc(), "rank"))
    return r.select("query", place.alias("place"), "id")


@query(f"""WITH {_RETRIEVED} SELECT id, MIN(query) AS first_query FROM top WHERE rank <= 2 GROUP BY 1""")
def prefetch_patterns(spark, d):
    """The two best patterns of each query, each pattern once."""
    return _retrieved(spark, d, 2).groupBy("id").agg(F.min("query").alias("first_query"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_type = 'purchase' THEN GREATEST(0, value - 50) ELSE 0 END AS label FROM events""")
def rank_labels(spark, d):
    """What a ranker learns: the gain of a pattern that was chosen and accepted, else 0."""
    chosen = (F.col("event_id") % 2 == 0) & (F.col("event_type") == "purchase")
    return _t(spark, d, "events").select("event_id", F.when(chosen, F.greatest(F.lit(0.0), F.col("value") - 50)).otherwise(0.0).alias("label"))


@query("""WITH x AS (SELECT CASE WHEN user_id % 4 = 0 THEN 'k' || user_id // 4 ELSE 'k' || user_id // 4 || '-' || user_id % 4 END AS id, user_id // 4 AS b, user_id % 4 AS v, event_id, event_type AS item FROM events),
f AS (SELECT 'k' || b AS base, item, MIN((v <> 0, id, event_id)) AS "at" FROM x GROUP BY ALL) SELECT base, STRING_AGG(item, ',' ORDER BY "at") AS contradictions FROM f GROUP BY 1""")
def merge_contradictions(spark, d):
    k = F.col("user_id")
    base = F.concat(F.lit("k"), F.expr("cast(user_id div 4 as string)"))
    x = _t(spark, d, "events").groupBy(F.when(k % 4 == 0, base).otherwise(F.concat(base, F.lit("-"), (k % 4).cast("string"))).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda e: e["event_type"]).alias("contradictions"))
    return E.merged_texts(x, "contradictions").select("base", F.array_join("contradictions", ",").alias("contradictions"))


@query("SELECT r_regionkey, 'generic.' || r_name AS method FROM region WHERE r_name IN ('ASIA', 'EUROPE')")
def method_filter(spark, d):
    """Methods of a generic whose class is among the hints."""
    hints = spark.createDataFrame([("ASIA",), ("EUROPE",), ("none",)], "suffix string")
    m = _t(spark, d, "region").select("r_regionkey", F.concat(F.lit("generic."), "r_name").alias("method"))
    return m.withColumn("suffix", F.regexp_replace("method", r"^generic\.", "")).join(F.broadcast(hints), "suffix", "left_semi").drop("suffix")
