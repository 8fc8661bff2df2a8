"""Named queries of the library over the star-schema tables, each with the SQL that gives the same rows.

Queries that only extend the library (calendar, windows, fills) are named ``ext_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compare as C
from ..functions import markup as M
from ..functions import scalar as S
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import joins as J
from ..operators import scoring as R
from ..operators import windows as W
from ..sources import readers
from ..streaming import evidence as stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(x, digits: int = 6):
    return F.round(x, digits)


# --- comparison -----------------------------------------------------------------------------------

_DAMAGED = """actual AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN o_totalprice * (1 + CAST(5e-7 AS DOUBLE)) WHEN 2 THEN o_totalprice * CAST(1.01 AS DOUBLE) ELSE o_totalprice END AS actual FROM orders WHERE o_orderkey % 11 <> 0)"""


def _damaged(spark, d):
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    value = F.when(k % 7 == 0, None).when(k % 7 == 1, v * (1 + 5e-7)).when(k % 7 == 2, v * 1.01).otherwise(v)
    return _t(spark, d, "orders").where(k % 11 != 0).select("o_orderkey", value.alias("actual"))


@query(f"""WITH {_DAMAGED},
v AS (SELECT o_orderpriority, CASE WHEN a.o_orderkey IS NULL THEN 'missing' WHEN a.actual IS NULL THEN 'null_mismatch' WHEN ABS(o_totalprice - a.actual) <= 1e-9 + 1e-6 * ABS(a.actual) THEN 'pass' ELSE 'value' END AS verdict
  FROM orders o LEFT JOIN actual a USING (o_orderkey))
SELECT o_orderpriority, COUNT(*) AS n, COUNT(*) FILTER (verdict = 'pass') AS n_pass, COUNT(*) FILTER (verdict = 'missing') AS n_missing, AVG(CASE WHEN verdict = 'pass' THEN 1.0::DOUBLE ELSE 0 END) AS score FROM v GROUP BY 1""")
def flagship_compare(spark, d):
    both = J.presence_join(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), _damaged(spark, d), ["o_orderkey"])
    return R.compare_summary(both.withColumn("verdict", C.verdict(F.col("o_totalprice"), F.col("actual"), F.col("present"))), ["o_orderpriority"])


@query("""SELECT l_returnflag, COUNT(*) AS n, COUNT(*) FILTER (NULLIF(l_discount, 0) IS NOT DISTINCT FROM NULLIF(l_tax, 0)) AS n_equal,
 COUNT(*) FILTER (ABS(l_discount - l_tax) <= 0.01 + 1e-6 * ABS(l_tax)) AS n_close FROM lineitem GROUP BY 1""")
def null_nan_equality(spark, d):
    a, b = F.nullif("l_discount", F.lit(0.0)), F.nullif("l_tax", F.lit(0.0))
    nan = lambda x: F.coalesce(x, F.lit(float("nan")))
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(C.within(nan(a), b, 0.0, 0.0), 1)).alias("n_equal"), F.count(F.when(C.within(F.col("l_discount"), F.col("l_tax"), 1e-6, 0.01), 1)).alias("n_close")
    )


@query("SELECT quality, COUNT(*) AS n, COUNT(*) FILTER ((toxic = 1)::INTEGER = quality) AS n_equal FROM labels GROUP BY 1")
def bool_int_equality(spark, d):
    return _t(spark, d, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(C.bool_equals_number(F.col("toxic") == 1, F.col("quality")), 1)).alias("n_equal"))


@query("""WITH a AS (SELECT user_id, LIST(value ORDER BY event_id) AS x FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, LIST(value ORDER BY event_id) AS y FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT user_id, CASE WHEN LEN(x) <> LEN(y) THEN 'infra' WHEN LEN(LIST_FILTER(LIST_ZIP(x, y), LAMBDA p: NOT ABS(p[1] - p[2]) <= 1000 + 1e-6 * ABS(p[2]))) = 0 THEN 'pass' ELSE 'value' END AS verdict FROM a JOIN b USING (user_id)""")
def list_compare(spark, d):
    ev = _t(spark, d, "events")
    side = lambda r, n: ev.where(F.col("event_id") % 2 == r).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda s: s["value"]).alias(n))
    return side(0, "x").join(side(1, "y"), "user_id").select("user_id", C.list_verdict(F.col("x"), F.col("y"), 1e-6, 1000.0).alias("verdict"))


@query("""WITH a AS (SELECT o_orderkey, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 4 <> 0)
SELECT CASE WHEN b.o_orderkey IS NULL THEN 'only_left' WHEN a.o_orderkey IS NULL THEN 'only_right' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'differs' END AS state, COUNT(*) AS n FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey GROUP BY 1""")
def env_full_outer_diff(spark, d):
    o, k = _t(spark, d, "orders"), F.col("o_orderkey")
    a = o.where(k % 3 != 0).select(k, F.col("o_totalprice").alias("v"))
    b = o.where(k % 4 != 0).select(k, F.when(k % 5 == 0, -1.0).otherwise(F.col("o_totalprice")).alias("v"))
    return J.full_diff(a, b, "o_orderkey", "v").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT doc_id, SHA256(text) AS h FROM documents WHERE doc_id % 5 <> 0), a AS (SELECT doc_id, SHA256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 3 <> 0)
SELECT a.doc_id, a.h AS hash, b.doc_id IS NULL AS is_new FROM a LEFT JOIN b USING (doc_id) WHERE a.h IS DISTINCT FROM b.h""")
def snapshot_diff(spark, d):
    docs, k = _t(spark, d, "documents"), F.col("doc_id")
    before = docs.where(k % 5 != 0).select(k, F.sha2("text", 256).alias("hash"))
    after = docs.where(k % 3 != 0).select(k, F.sha2(F.when(k % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return J.snapshot_changes(before, after, "doc_id", "hash")


@query("SELECT doc_id, SUBSTR(SHA256(text), 1, 8) AS snippet_hash, SUBSTR(SHA1(text), 1, 12) AS script_id, SUBSTR(MD5(lang), 1, 8) AS shape_hash FROM documents")
def sha_prefixes(spark, d):
    h = S.short_hash
    return _t(spark, d, "documents").select("doc_id", h(F.col("text"), "sha256", 8).alias("snippet_hash"), h(F.col("text"), "sha1", 12).alias("script_id"), h(F.col("lang"), "md5", 8).alias("shape_hash"))


@query(r"""WITH u AS (SELECT page_id % 10 AS g, page_id % 2 AS side, CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS verb, REGEXP_REPLACE(url, '[?#].*$', '') AS u FROM pages),
k AS (SELECT g, side, verb || ' ' || LOWER(RTRIM(CASE WHEN CONTAINS(u, '://') THEN u ELSE '://' || u END, '/')) AS k FROM u),
s AS (SELECT g, LIST(DISTINCT k) FILTER (side = 0) AS a, LIST(DISTINCT k) FILTER (side = 1) AS b FROM k GROUP BY g)
SELECT g, ROUND(LEN(LIST_INTERSECT(COALESCE(a, []), COALESCE(b, [])))::DOUBLE / LEN(LIST_DISTINCT(LIST_CONCAT(a, b))), 6) AS score FROM s""")
def request_jaccard(spark, d):
    verb = F.when(F.col("page_id") % 3 == 0, "POST").otherwise("GET")
    k = _t(spark, d, "pages").select((F.col("page_id") % 10).alias("g"), (F.col("page_id") % 2).alias("side"), C.request_key(verb, F.col("url")).alias("k"))
    return J.requests_scores(k, "g", "k", F.col("side") == 0, F.col("side") == 1).select("g", _r(F.col("score")).alias("score"))


@query("""WITH t AS (SELECT p_partkey, LIST_DISTINCT(LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(LOWER(p_name), '[\\s._\\-]+'), LAMBDA x: x <> '')) AS a, LIST_DISTINCT(LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(LOWER(p_type || ' ' || p_name), '[\\s._\\-]+'), LAMBDA x: x <> '')) AS b FROM part)
SELECT p_partkey, ROUND(LEN(LIST_INTERSECT(a, b))::DOUBLE / LEN(LIST_DISTINCT(LIST_CONCAT(a, b))), 6) AS overlap FROM t""".replace("\\\\", "\\"))
def token_jaccard(spark, d):
    return _t(spark, d, "part").select("p_partkey", _r(C.jaccard(C.tokens(F.col("p_name")), C.tokens(F.concat_ws(" ", "p_type", "p_name")))).alias("overlap"))


@query("""WITH s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS place FROM events),
z AS (SELECT COALESCE(a.user_id, b.user_id) AS user_id, a.value AS x, b.value AS y FROM (SELECT * FROM s WHERE event_id % 2 = 0) a FULL OUTER JOIN (SELECT * FROM s WHERE event_id % 2 = 1) b ON a.user_id = b.user_id AND a.place = b.place)
SELECT user_id, COUNT(*) AS n, COUNT(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND ABS(x - y) <= GREATEST(0.1 * GREATEST(ABS(x), ABS(y)), 1e-9)) AS n_close FROM z GROUP BY 1""")
def positional_zip(spark, d):
    ev = _t(spark, d, "events")
    z = J.positional(ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1"), "user_id", ["event_id"], "value")
    return z.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("left_value").isNotNull() & C.close(F.col("left_value"), F.col("right_value"), 0.1), 1)).alias("n_close"))


@query("""SELECT event_type, COUNT(*) AS n, ROUND(AVG(CASE WHEN event_id % 3 = 0 AND user_id % 2 = 0 THEN 1.0::DOUBLE WHEN event_id % 3 <> 0 AND user_id % 2 <> 0 THEN 0.8 ELSE 0 END), 6) AS score FROM events GROUP BY 1""")
def exit_symmetry(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), _r(F.avg(C.exit_score(F.col("event_id") % 3, F.col("user_id") % 2))).alias("score"))


@query("""WITH x AS (SELECT a.vec_id AS a, b.vec_id AS b, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT a, b, ROUND(LIST_COSINE_SIMILARITY(x::DOUBLE[], y::DOUBLE[]), 6) AS cosine FROM x""")
def cosine_pairs(spark, d):
    e = _t(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return e.join(nxt, "vec_id").select(F.col("vec_id").alias("a"), "b", _r(C.cosine(F.col("embedding"), F.col("y"))).alias("cosine"))


@query("""WITH w AS (SELECT p_partkey, p_size, p_brand, LIST_FILTER(STRING_SPLIT(LOWER(p_name), ' '), LAMBDA x: x <> '...') AS a, CASE WHEN p_partkey % 5 = 0 THEN LIST_FILTER(STRING_SPLIT(LOWER(p_name), ' '), LAMBDA x: x <> '...') ELSE STRING_SPLIT(LOWER(p_type), ' ') END AS b FROM part)
SELECT p_partkey, CASE WHEN s >= 0.95 THEN 1.0::DOUBLE ELSE s END AS score, CASE WHEN s >= 0.95 THEN NULL WHEN s >= 0.5 THEN 'infra' ELSE 'value' END AS tag
FROM (SELECT p_partkey, ROUND(0.7::DOUBLE * CASE WHEN a = b THEN 1.0::DOUBLE WHEN GREATEST(LEN(a), LEN(b)) = 0 THEN 1.0 ELSE LEN(LIST_INTERSECT(a, b))::DOUBLE / GREATEST(LEN(a), LEN(b)) END + 0.3::DOUBLE * (1 + (p_brand = 'Brand#11')::INTEGER) / 2, 6) AS s FROM w)""")
def formals_overlap(spark, d):
    """Callable comparison of word lists as formals, every fifth part's own ones on both sides; attributes are the table's columns."""
    p = _t(spark, d, "part")
    words = lambda c: F.split(F.lower(c), " ")
    attrs = lambda v: F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), v)
    actual = F.when(F.col("p_partkey") % 5 == 0, F.concat(words("p_name"), F.array(F.lit("args"), F.lit("kwargs")))).otherwise(words("p_type"))
    likeness = _r(C.formals_score(F.concat(words("p_name"), F.array(F.lit("..."))), actual, attrs(F.col("p_brand")), attrs(F.lit("Brand#11"))))
    return p.select("p_partkey", C.callable_score(likeness).alias("score"), C.callable_tag(likeness).alias("tag"))


@query()
def text_similarity(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.col("text").alias("a"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return C.text_similarity(docs.join(other, "doc_id"), "a", "b").select("doc_id", _r(F.col("similarity")).alias("similarity"))


@query()
def greedy_match(spark, d):
    """Parts matched by their words within runs of ten keys, even keys as rows and odd ones as columns."""
    p = _t(spark, d, "part").select(F.expr("p_partkey div 10").alias("g"), "p_partkey", C.tokens(F.concat_ws(" ", "p_type", "p_name")).alias("t"))
    rows, cols = p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1")
    m = rows.select("g", F.col("p_partkey").alias("row"), F.col("t").alias("x")).join(cols.select("g", F.col("p_partkey").alias("col"), F.col("t").alias("y")), "g")
    return J.greedy_match(m.select("g", "row", "col", _r(C.jaccard(F.col("x"), F.col("y"))).alias("score")), "g")


# --- intervals and attribution --------------------------------------------------------------------

_SPANS = "spans AS (SELECT event_id AS span, user_id, event_id % 1000 AS s, event_id % 1000 + 20 + event_id % 7 AS e FROM events)"


def _spans(spark, d):
    k = F.col("event_id")
    return _t(spark, d, "events").select(k.alias("span"), "user_id", (k % 1000).alias("s"), (k % 1000 + 20 + k % 7).alias("e"))


@query(f"""WITH {_SPANS}, points AS (SELECT event_id, user_id, event_id % 997 AS place FROM events)
SELECT p.event_id, ARG_MAX(span, (s, span)) AS span, COUNT(*) AS n FROM points p JOIN spans USING (user_id) WHERE place BETWEEN s AND e GROUP BY 1""")
def crash_attribution(spark, d):
    points = _t(spark, d, "events").select("event_id", "user_id", (F.col("event_id") % 997).alias("at"))
    hit = J.points_in_intervals(points, _spans(spark, d), "user_id", "at", "s", "e", 32)
    return hit.groupBy("event_id").agg(F.max_by("span", F.struct("s", "span")).alias("span"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_SPANS} SELECT a.user_id, a.span AS outer_key, COUNT(*) AS n_inside FROM spans a JOIN spans b USING (user_id)
WHERE a.s <= b.s AND b.e <= a.e AND a.span <> b.span GROUP BY ALL""")
def span_containment(spark, d):
    return J.contained(_spans(spark, d), "user_id", "span", F.col("s"), F.col("e"))


@query(f"""WITH {_SPANS}, n AS (SELECT *, LEAD(s) OVER (PARTITION BY user_id ORDER BY s, span) AS nx FROM spans)
SELECT span, user_id, s, LEAST(e, COALESCE(nx - 1, e)) AS e FROM n WHERE LEAST(e, COALESCE(nx - 1, e)) >= s""")
def range_clip(spark, d):
    return W.clip_ranges(_spans(spark, d), "user_id", "s", "e", "span")


@query("""WITH l AS (SELECT *, SUM((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) AS range_no FROM conversations)
SELECT conv_id, range_no::BIGINT AS range_no, MIN(turn) AS start_line, MAX(turn) FILTER (LENGTH(text) > 200 OR role = 'user') AS end_line FROM l WHERE range_no > 0 GROUP BY ALL""")
def sentinel_ranges(spark, d):
    return W.sentinel_ranges(_t(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user", F.length("text") <= 200)


@query("""WITH d AS (SELECT user_id, event_type, event_id AS at, value AS definition FROM events WHERE event_id % 4 = 0), u AS (SELECT user_id, event_type, event_id AS at FROM events WHERE event_id % 4 <> 0)
SELECT u.user_id, u.event_type, u.at, d.definition AS resolved FROM u ASOF LEFT JOIN d ON u.user_id = d.user_id AND u.event_type = d.event_type AND u.at > d.at""")
def dependency_asof(spark, d):
    ev = _t(spark, d, "events").withColumn("at", F.col("event_id"))
    return J.latest_before(ev.where("event_id % 4 <> 0"), ev.where("event_id % 4 = 0").withColumn("definition", F.col("value")), ["user_id", "event_type"], "at")


@query("""WITH d AS (SELECT user_id, event_type AS name, MIN(event_id) AS m FROM events WHERE event_id % 4 = 0 GROUP BY ALL)
SELECT e.user_id, event_type AS name, event_id AS "at" FROM events e LEFT JOIN d ON e.user_id = d.user_id AND event_type = name WHERE event_id % 4 <> 0 AND (m IS NULL OR m >= event_id)""")
def free_names(spark, d):
    ev = _t(spark, d, "events").select("user_id", F.col("event_type").alias("name"), F.col("event_id").alias("at"))
    return G.free_names(ev.where("at % 4 <> 0"), ev.where("at % 4 = 0"), "user_id")


@query("""WITH e AS (SELECT n_regionkey AS g, n_nationkey AS ord, 'e' || n_nationkey AS entity, CASE WHEN n_nationkey % 2 = 0 THEN 'x' ELSE 'y' END AS name FROM nation), f AS (SELECT r_regionkey AS g, v AS variable FROM region, (VALUES ('x'), ('z')) t(v)),
n AS (SELECT g, name AS variable, ARG_MAX(entity, ord) AS entity FROM e GROUP BY ALL), j AS (SELECT f.g, f.variable, n.entity FROM f LEFT JOIN n ON f.g = n.g AND f.variable = n.variable)
SELECT * FROM j WHERE entity IS NOT NULL UNION ALL SELECT j.g, j.variable, e.entity FROM j JOIN e ON j.g = e.g WHERE j.entity IS NULL""")
def feedback_attribution(spark, d):
    e = _t(spark, d, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("ord"), F.concat(F.lit("e"), "n_nationkey").alias("entity"), F.when(F.col("n_nationkey") % 2 == 0, "x").otherwise("y").alias("name"))
    f = _t(spark, d, "region").select(F.col("r_regionkey").alias("g"), F.explode(F.array(F.lit("x"), F.lit("z"))).alias("variable"))
    return J.attribute(f, e, "g").select("g", "variable", "entity")


# --- scores ---------------------------------------------------------------------------------------

_KIND = "CASE event_type WHEN 'click' THEN 'VARIABLE' WHEN 'view' THEN 'FUNCTION_DEF' WHEN 'purchase' THEN 'FUNCTION_CALL' WHEN 'signup' THEN 'LIBRARY_IMPORT' ELSE 'CONSTANT' END"


def _entities(spark, d):
    return _t(spark, d, "events").select(
        "event_id", "user_id", F.expr(_KIND).alias("kind"), ((F.col("event_id") % 10) / 10.0).alias("data"), F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(1.0).alias("ok"),
        (F.col("event_id") % 3 != 0).alias("has_data"), (F.col("event_id") % 5 == 0).alias("has_stdout"), (F.col("event_id") % 8 == 0).alias("has_effects"),
    )


@query(f"""WITH e AS (SELECT event_id, {_KIND} AS kind, (event_id % 10) / 10.0::DOUBLE AS data, CASE WHEN event_id % 4 = 0 THEN 0.0::DOUBLE ELSE 1 END AS ok FROM events)
SELECT kind, COUNT(*) AS n, ROUND(AVG(CASE WHEN kind IN ('VARIABLE', 'CONSTANT', 'FUNCTION_CALL') THEN data ELSE ok END), 6) AS type_score,
ROUND(AVG(CASE kind WHEN 'FUNCTION_DEF' THEN 0.5::DOUBLE WHEN 'FUNCTION_CALL' THEN data ELSE ok END), 6) AS flow_score, ROUND(AVG(CASE kind WHEN 'FUNCTION_DEF' THEN 0.25::DOUBLE WHEN 'FUNCTION_CALL' THEN data ELSE 1 END), 6) AS callable_score FROM e GROUP BY 1""")
def kind_scores(spark, d):
    e = _entities(spark, d).withColumn("s", R.kind_scores(F.col("kind"), F.col("ok"), F.col("data"), F.lit(0.5), F.lit(0.25)))
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *[_r(F.avg(f"s.{c}")).alias(c) for c in ("type_score", "flow_score", "callable_score")])


_DIMS = f"""e AS (SELECT event_id, user_id, {_KIND} AS kind, (event_id % 10) / 10.0::DOUBLE AS data, CASE WHEN event_id % 4 = 0 THEN 0.0::DOUBLE ELSE 1 END AS ok, event_id % 3 <> 0 AS hd, event_id % 5 = 0 AS hs, event_id % 8 = 0 AS he FROM events),
a AS (SELECT *, (kind IN ('FUNCTION_DEF', 'LIBRARY_IMPORT') OR hd)::INTEGER AS d1, ((kind = 'FUNCTION_DEF' AND hs) OR (kind = 'FUNCTION_CALL' AND hd) OR kind NOT IN ('FUNCTION_DEF', 'FUNCTION_CALL'))::INTEGER AS d2,
 hd::INTEGER AS d3, (kind IN ('FUNCTION_DEF', 'FUNCTION_CALL') AND hd)::INTEGER AS d5, (he OR hs)::INTEGER AS d6 FROM e),
m AS (SELECT *, CASE WHEN d1 + d2 + 2 * d3 + d5 + d6 > 0 THEN (d1 * data + d2 * ok + 2 * d3 * data + d5 * 0.5 + d6 * 1.0) / (d1 + d2 + 2 * d3 + d5 + d6) ELSE ok END AS score FROM a)"""


def _means(spark, d):
    e = _entities(spark, d)
    active = R.active_dimensions(F.col("kind"), F.col("has_data"), F.col("has_stdout"), F.col("has_effects"))
    scores = {"type_match": F.col("data"), "control_flow_match": F.col("ok"), "data_output": F.col("data"), "variable_output": F.col("data"), "callable_output": F.lit(0.5), "side_effects": F.lit(1.0)}
    return e.withColumn("score", R.mean_of_active(active, scores, F.col("ok")))


@query(f"WITH {_DIMS} SELECT kind, COUNT(*) AS n, ROUND(AVG(score), 6) AS score FROM m GROUP BY 1")
def active_dims_mean(spark, d):
    return _means(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("score")).alias("score"))


@query(f"""WITH {_DIMS} SELECT user_id, ROUND(CASE WHEN MAX((event_id % 50 <> 0 AND event_id % 97 = 0)::INTEGER) = 1 THEN 0 ELSE COALESCE(AVG(score) FILTER (hd OR hs), AVG(score), 1) END, 6) AS aggregate FROM m GROUP BY 1""")
def aggregate_score(spark, d):
    m = _means(spark, d).withColumns({"has_output": F.col("has_data") | F.col("has_stdout"), "expected_ok": F.col("event_id") % 50 != 0, "actual_ok": F.col("event_id") % 97 != 0})
    return R.aggregate_score(m, "user_id").select("user_id", _r(F.col("aggregate")).alias("aggregate"))


@query("""SELECT event_id, ROUND(CASE WHEN (event_id % 2 = 0)::INTEGER + (event_id % 3 = 0)::INTEGER > 0 THEN ((event_id % 2 = 0)::INTEGER * 0.5::DOUBLE + (event_id % 3 = 0)::INTEGER * 1.0::DOUBLE) / ((event_id % 2 = 0)::INTEGER + (event_id % 3 = 0)::INTEGER)
 WHEN event_id % 5 <> 0 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END, 6) AS score FROM events""")
def proxy_score(spark, d):
    k = F.col("event_id")
    s = R.proxy_score({"data": k % 2 == 0, "stdout": k % 3 == 0}, {"data": k % 5 == 0}, {"data": F.lit(0.5), "stdout": F.lit(1.0)}, F.lit(0.1))
    return _t(spark, d, "events").select("event_id", _r(s).alias("score"))


@query("""WITH r AS (SELECT user_id, CASE event_id % 4 WHEN 0 THEN 'FILES' WHEN 1 THEN 'ENV' WHEN 2 THEN 'HTML' ELSE 'WARNINGS' END AS effect, (event_id % 11) / 10.0::DOUBLE AS score FROM events),
f AS (SELECT user_id, MAX((effect = 'HTML' AND score >= 0.7)::INTEGER) AS html FROM r GROUP BY 1)
SELECT f.user_id, ROUND(COALESCE(AVG(score) FILTER (html = 0 OR effect NOT IN ('FILES', 'ENV')), 1), 6) AS side_effects FROM f JOIN r USING (user_id) GROUP BY 1""")
def side_effect_mean(spark, d):
    k = F.col("event_id") % 4
    r = _t(spark, d, "events").select("user_id", F.when(k == 0, "FILES").when(k == 1, "ENV").when(k == 2, "HTML").otherwise("WARNINGS").alias("effect"), ((F.col("event_id") % 11) / 10.0).alias("score"), F.lit("html_content_compared: all").alias("explanation"))
    return R.side_effect_mean(r, "user_id").select("user_id", _r(F.col("side_effects")).alias("side_effects"))


@query("""SELECT user_id, STRING_AGG(event_type, '' ORDER BY event_id) AS stdout, ROUND(SUM(value), 6) AS run_time_s, ARG_MAX(event_id % 3, event_id) AS exit_code, COUNT(*) AS n_parts FROM events GROUP BY 1""")
def bundle_merge(spark, d):
    parts = _t(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("stdout"), F.col("value").alias("run_time_s"), (F.col("event_id") % 3).alias("exit_code"))
    return R.bundle_merge(parts, "user_id", "event_id").withColumn("run_time_s", _r(F.col("run_time_s")))


@query("SELECT user_id, event_type, ARG_MAX(value, event_id) AS value FROM events GROUP BY ALL")
def last_write_map(spark, d):
    return R.last_write(_t(spark, d, "events"), ["user_id", "event_type"], "event_id", "value")


@query("""WITH s AS (SELECT status, COUNT(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'analyzed' WHEN 'O' THEN 'dynamic' ELSE 'branch' END AS status FROM orders) GROUP BY 1)
SELECT t.status, COALESCE(n, 0) AS n, COALESCE(n, 0)::DOUBLE / (SELECT COUNT(*) FROM orders) AS share FROM (VALUES ('analyzed'), ('dynamic'), ('branch'), ('unreachable')) t(status) LEFT JOIN s USING (status)""")
def coverage_report(spark, d):
    rows = _t(spark, d, "orders").select(F.expr("CASE o_orderstatus WHEN 'F' THEN 'analyzed' WHEN 'O' THEN 'dynamic' ELSE 'branch' END").alias("status"))
    return R.coverage(rows, ["analyzed", "dynamic", "branch", "unreachable"])


@query("""SELECT o_custkey, ARG_MIN(o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) AS status FROM orders GROUP BY 1""")
def best_status(spark, d):
    return R.best_status(_t(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("status")), "o_custkey", ["F", "O", "P"])


# --- windows and stores ---------------------------------------------------------------------------

@query("""WITH e AS (SELECT user_id, event_id, value, event_type, SUM(1) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT event_id, user_id, value - COALESCE(LAG(value) OVER w, 0.0::DOUBLE) AS delta, CASE WHEN LAG(event_type) OVER w = event_type THEN 0 ELSE 1 END::INTEGER AS n_added FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def delta_since_prev(spark, d):
    ev = _t(spark, d, "events").select("event_id", "user_id", "value", F.array("event_type").alias("names"))
    return W.delta_since_previous(ev, "user_id", ["event_id"], "value", "names").select("event_id", "user_id", "delta", F.size("added").alias("n_added"))


@query("""WITH b AS (SELECT event_id, user_id, value, MAX(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM events)
SELECT event_id, user_id, value, best_before, best_before IS NULL OR value > best_before AS accepted FROM b""")
def running_best(spark, d):
    return W.running_best(_t(spark, d, "events").select("event_id", "user_id", "value"), "user_id", ["event_id"], "value")


@query("""WITH o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
SELECT o_custkey, o_orderpriority, o_totalprice, o_orderkey, rank FROM (SELECT *, (ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))::INTEGER AS rank FROM o WHERE n = 1) WHERE rank <= 3""")
def topn_examples(spark, d):
    return W.top_examples(_t(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_totalprice", "o_orderkey"), ["o_custkey"], "o_orderpriority", "o_totalprice", "o_orderkey", 3)


@query("""SELECT user_id, event_type, event_id, value, rank FROM (SELECT *, (ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id))::INTEGER AS rank FROM events) WHERE rank <= 5""")
def topn_per_class(spark, d):
    return W.top_examples(_t(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id", "value", "event_id", 5)


@query("""SELECT o_custkey, MAX(o_totalprice) AS best, ARG_MAX(o_orderkey, (o_totalprice, -o_orderkey)) AS best_at, COUNT(*) AS n_runs FROM orders GROUP BY 1""")
def best_run_per_script(spark, d):
    return W.best_runs(_t(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderkey")


@query("""WITH old AS (SELECT o_orderkey, o_totalprice, 0::BIGINT AS version FROM orders WHERE o_orderkey % 4 <> 1), new AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, 1::BIGINT AS version FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 4 = 1)
SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new) UNION ALL SELECT * FROM new""")
def upsert_scoring(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    old = o.where("o_orderkey % 4 <> 1").withColumn("version", F.lit(0).cast("long"))
    new = o.where("o_orderkey % 3 = 0 or o_orderkey % 4 = 1").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(1).cast("long").alias("version"))
    return W.upsert(old, new, ["o_orderkey"], "version")


@query("SELECT SHA256(text) AS hash, MIN(doc_id) AS doc_id, COUNT(*) AS n_copies FROM documents WHERE TRIM(text) <> '' GROUP BY 1")
def dedup_content(spark, d):
    return W.store_content(_t(spark, d, "documents"), "text", "doc_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def skip_existing(spark, d):
    return _t(spark, d, "customer").select("c_custkey", "c_name").join(_t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""WITH n AS (SELECT o_orderkey, o_orderpriority, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS n FROM orders)
SELECT o_orderkey, CASE WHEN n = 0 THEN o_orderpriority ELSE o_orderpriority || '_' || n END AS fresh FROM n""")
def fresh_ids(spark, d):
    return W.fresh_names(_t(spark, d, "orders"), "o_orderpriority", ["o_orderkey"]).select("o_orderkey", "fresh")


@query("SELECT conv_id, turn, role FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def last_n_history(spark, d):
    return W.last_n(_t(spark, d, "conversations"), ["conv_id", "role"], [F.col("turn").desc()], 3).select("conv_id", "turn", "role")


# --- ranking and knowledge ------------------------------------------------------------------------

def _patterns(spark, d):
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_totalprice") > 200000, 1)).alias("big"))
    k = F.col("c_custkey")
    return c.join(o, "c_custkey", "left").select(
        k.alias("id"), F.col("c_mktsegment").alias("package"), F.concat(F.lit("s"), k % 5).alias("shape"), F.when(k % 3 == 0, "confirmed").otherwise("tentative").alias("confidence"), (k % 4 == 0).alias("seed"),
        F.coalesce("n", F.lit(0)).cast("int").alias("evidence"), F.coalesce("big", F.lit(0)).cast("int").alias("real_evidence"), (k % 13).cast("int").alias("contradictions"), (k % 120).cast("int").alias("ties"), (k % 60).cast("int").alias("contradicted_at"),
        F.concat_ws(" ", F.lit("Use"), F.col("c_mktsegment"), F.concat(F.lit("g"), k % 6)).alias("guidance"),
    )


_PATTERNS = """o AS (SELECT o_custkey, COUNT(*) AS n, COUNT(*) FILTER (o_totalprice > 200000) AS big FROM orders GROUP BY 1),
p AS (SELECT c_custkey AS id, c_mktsegment AS package, 's' || c_custkey % 5 AS shape, CASE WHEN c_custkey % 3 = 0 THEN 'confirmed' ELSE 'tentative' END AS confidence, c_custkey % 4 = 0 AS seed, COALESCE(n, 0)::INTEGER AS evidence, COALESCE(big, 0)::INTEGER AS real_evidence,
 (c_custkey % 13)::INTEGER AS contradictions, (c_custkey % 120)::INTEGER AS ties, (c_custkey % 60)::INTEGER AS contradicted_at, 'Use ' || c_mktsegment || ' g' || c_custkey % 6 AS guidance FROM customer LEFT JOIN o ON c_custkey = o_custkey)"""


@query(f"""WITH {_PATTERNS}, a AS (SELECT *, CASE WHEN confidence = 'tentative' AND real_evidence >= 2 THEN 'confirmed' ELSE confidence END AS c1, CASE WHEN real_evidence = 0 THEN CASE WHEN seed THEN 5 ELSE 1 END ELSE GREATEST(3, CEIL(0.75 * real_evidence)) END AS lim FROM p)
SELECT id, confidence, CASE WHEN contradictions >= lim THEN CASE c1 WHEN 'confirmed' THEN 'tentative' ELSE 'contradicted' END ELSE c1 END AS after FROM a""")
def promote_demote(spark, d):
    return E.review(_patterns(spark, d)).select("id", "confidence", "after")


@query(f"""WITH {_PATTERNS}, g AS (SELECT package, shape, LOWER(guidance) AS said, MIN(id) AS id, COUNT(*) AS n FROM p WHERE confidence = 'confirmed' GROUP BY ALL)
SELECT a.package, a.shape, LEAST(a.id, b.id) AS id_a, GREATEST(a.id, b.id) AS id_b, a.n * b.n AS n_pairs FROM g a JOIN g b ON a.package = b.package AND a.shape = b.shape AND a.said < b.said
WHERE a.said = (SELECT MIN(said) FROM g c WHERE c.package = a.package AND c.shape = a.shape)""")
def conflict_pairs(spark, d):
    return E.conflicts(_patterns(spark, d))


@query(f"""WITH {_PATTERNS}, q AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'contradicted' ELSE confidence END AS confidence, seed, 0 AS real_evidence, ties, contradictions, contradicted_at FROM p)
SELECT id, CASE WHEN confidence = 'contradicted' AND 70 - contradicted_at >= 30 THEN 'stale' WHEN NOT seed AND confidence <> 'contradicted' AND ties + contradictions >= 100 THEN 'unimproved' END AS archive FROM q
WHERE (confidence = 'contradicted' AND 70 - contradicted_at >= 30) OR (NOT seed AND confidence <> 'contradicted' AND ties + contradictions >= 100)""")
def archive_rules(spark, d):
    p = _patterns(spark, d).withColumns({"confidence": F.when(F.col("id") % 7 == 0, "contradicted").otherwise(F.col("confidence")), "real_evidence": F.lit(0)})
    return E.archived(p, 70).select("id", "archive")


@query(f"""WITH {_PATTERNS}, n AS (SELECT CASE WHEN id % 10 = 0 THEN 'k' || id // 10 ELSE 'k' || id // 10 || '-' || id % 10 END AS id, ties, evidence FROM p), b AS (SELECT *, COALESCE(NULLIF(REGEXP_EXTRACT(id, '^(.+?)-(\\d+)$', 1), ''), id) AS base FROM n)
SELECT base, COALESCE(MAX(id) FILTER (id = base), MIN(id)) AS canonical, COUNT(*) AS n_merged, SUM(ties)::BIGINT AS ties, SUM(evidence)::BIGINT AS evidence FROM b GROUP BY 1 HAVING COUNT(*) > 1""")
def consolidate_suffix(spark, d):
    k = F.col("id")
    name = F.when(k % 10 == 0, F.concat(F.lit("k"), F.expr("id div 10"))).otherwise(F.concat(F.lit("k"), F.expr("id div 10"), F.lit("-"), k % 10))
    return E.consolidate(_patterns(spark, d).withColumn("id", name))


@query("""SELECT id, LEN(LIST_FILTER(s, LAMBDA x: x >= 0.3))::INTEGER AS n_kept FROM (SELECT user_id AS id, LIST(value / 100) AS s FROM events GROUP BY 1)""")
def prune_examples(spark, d):
    p = _t(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.collect_list(F.struct((F.col("value") / 100).alias("score"))).alias("examples"))
    return E.pruned_examples(p).select("id", F.size("examples").alias("n_kept"))


@query(f"WITH {_PATTERNS} SELECT package, shape, LIST(id ORDER BY id)[1] AS first_id, COUNT(*)::INTEGER AS n FROM p GROUP BY ALL")
def index_by_key(spark, d):
    return E.index_by_key(_patterns(spark, d)).select("package", "shape", F.col("ids")[0].alias("first_id"), F.size("ids").alias("n"))


_RETRIEVED = f"""{_PATTERNS}, n AS (SELECT * REPLACE (LOWER(package) || '.' || shape || '-' || id AS id) FROM p),
q AS (SELECT n_nationkey AS query, CASE WHEN n_nationkey % 6 = 5 THEN 'NONE' WHEN n_nationkey % 6 = 4 THEN '' ELSE s.package END AS package, 's' || n_nationkey % 5 AS kind, n_name || '_use g' || n_nationkey % 6 AS text
  FROM nation JOIN (SELECT package, ROW_NUMBER() OVER (ORDER BY package) - 1 AS r FROM (SELECT DISTINCT package FROM p)) s ON n_nationkey % 5 = r),
g AS (SELECT id, package, LIST_DISTINCT(REGEXP_SPLIT_TO_ARRAY(LOWER(id), '[ ._-]+')) AS i, LIST_DISTINCT(STRING_SPLIT(LOWER(guidance), ' ')) AS g FROM n WHERE seed OR confidence = 'confirmed' OR real_evidence >= 2),
j AS (SELECT query, id, CASE WHEN q.package = g.package THEN 0 ELSE 1 END AS tier, [kind] AS k, i, LIST_DISTINCT(REGEXP_SPLIT_TO_ARRAY(LOWER(text), '[ ._-]+')) AS t, g FROM q JOIN g ON q.package = g.package OR q.package NOT IN (SELECT package FROM p)),
s AS (SELECT *, LEN(LIST_INTERSECT(k, i))::DOUBLE / LEN(LIST_DISTINCT(LIST_CONCAT(k, i))) AS shape, LEN(LIST_INTERSECT(t, g))::DOUBLE / LEN(LIST_DISTINCT(LIST_CONCAT(t, g))) AS overlap FROM j),
top AS (SELECT query, (ROW_NUMBER() OVER (PARTITION BY query ORDER BY tier, shape DESC, overlap DESC, id))::INTEGER AS rank, id, tier, ROUND(shape, 6) AS shape, ROUND(overlap, 6) AS overlap FROM s)"""


def _retrieved(spark, d, k):
    p = _patterns(spark, d).withColumn("id", F.concat(F.lower("package"), F.lit("."), "shape", F.lit("-"), F.col("id").cast("string")))
    packages = p.select("package").distinct().withColumn("r", F.row_number().over(W.Window.orderBy("package")) - 1)  # five rows
    key = F.col("n_nationkey")
    q = _t(spark, d, "nation").join(F.broadcast(packages), key % 5 == F.col("r"))
    q = q.select(key.alias("query"), F.when(key % 6 == 5, "NONE").when(key % 6 == 4, "").otherwise(F.col("package")).alias("package"), F.concat(F.lit("s"), key % 5).alias("kind"), F.concat("n_name", F.lit("_use g"), key % 6).alias("text"))
    return E.retrieve(q, p, k).withColumns({c: _r(F.col(c)) for c in ("shape", "overlap")})


@query(f"WITH {_RETRIEVED} SELECT * FROM top WHERE rank <= 3")
def retrieve_topk(spark, d):
    return _retrieved(spark, d, 3)


@query("""WITH r AS (SELECT user_id, event_id, value, event_id % 4 AS gain, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id % 4 DESC, event_id) AS i FROM events),
s AS (SELECT user_id, SUM(CASE WHEN r <= 3 THEN gain / LOG2(r + 1) ELSE 0 END) AS dcg, SUM(CASE WHEN i <= 3 THEN gain / LOG2(i + 1) ELSE 0 END) AS idcg FROM r GROUP BY 1) SELECT user_id, ROUND(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM s""")
def ndcg_at_3(spark, d):
    ev = _t(spark, d, "events").withColumn("gain", F.col("event_id") % 4)
    return R.ndcg(ev, "user_id", "value", "gain", "event_id", 3).select("user_id", _r(F.col("ndcg")).alias("ndcg"))


@query("""WITH r AS (SELECT user_id, event_id, event_id % 4 AS gain, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events), f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY gain DESC, event_id) AS i FROM r WHERE r <= 3),
s AS (SELECT user_id, SUM(gain / LOG2(r + 1)) AS dcg, SUM(gain / LOG2(i + 1)) AS idcg FROM f GROUP BY 1) SELECT user_id, ROUND(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM s""")
def heuristic_ndcg(spark, d):
    ev = _t(spark, d, "events").withColumn("gain", F.col("event_id") % 4)
    return R.ndcg(ev, "user_id", "value", "gain", "event_id", 3, ideal_of_first=True).select("user_id", _r(F.col("ndcg")).alias("ndcg"))


@query("""WITH f AS (SELECT user_id, ROW_NUMBER() OVER (ORDER BY MIN(event_id), user_id) - 1 AS place, COUNT(*) OVER () // 5 AS size FROM events GROUP BY user_id)
SELECT user_id, place::INTEGER AS place, CASE WHEN place // size < 5 THEN place // size END AS fold FROM f""")
def grouped_folds(spark, d):
    return R.grouped_folds(_t(spark, d, "events"), "user_id", "event_id", 5)


@query("""WITH a AS (SELECT user_id, AVG(value) AS s FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, AVG(value) AS s FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT COUNT(*) AS n, ROUND(AVG(b.s - a.s), 6) AS mean_delta, COUNT(*) FILTER (b.s > a.s) AS n_improved, COUNT(*) FILTER (b.s < a.s) AS n_regressions FROM a JOIN b USING (user_id)""")
def paired_ablation(spark, d):
    return sign_test(spark, d).select("n", _r(F.col("mean_delta")).alias("mean_delta"), "n_improved", "n_regressions")


@query()
def sign_test(spark, d):
    ev = _t(spark, d, "events")
    side = lambda r: ev.where(F.col("event_id") % 2 == r).groupBy("user_id").agg(F.avg("value").alias("s"))
    return R.sign_test(R.paired_deltas(side(0), side(1), "user_id", "s"))


@query(f"""WITH {_PATTERNS}, q AS (SELECT id AS query, CASE WHEN id % 6 = 0 THEN '' ELSE package END AS qp, 'n_' || id % 4 || '.' || (id + 1) AS kind, 'use ' || package || ' G' || id % 4 AS text FROM p),
t AS (SELECT LIST_DISTINCT(LIST_FILTER(STRING_SPLIT_REGEX(LOWER(kind), '[\\s._\\-]+'), lambda w: w <> '')) AS k, LIST_DISTINCT(LIST_FILTER(STRING_SPLIT_REGEX(LOWER(text), '[\\s._\\-]+'), lambda w: w <> '')) AS x, LIST_DISTINCT(STRING_SPLIT(LOWER(guidance), ' ')) AS g,
  CASE WHEN id % 6 = 0 THEN '' ELSE package END AS p2, CASE WHEN id % 11 > 0 THEN DATE '1997-01-01' + (id % 700)::INTEGER END AS reviewed, * FROM q JOIN p ON id IN (query, query + 1, query + 6))
SELECT query, id, (qp = p2 AND qp <> '')::INTEGER AS package_match, ROUND(LEN(LIST_INTERSECT(k, [id::VARCHAR]))::DOUBLE / LEN(LIST_DISTINCT(LIST_CONCAT(k, [id::VARCHAR]))), 6) AS shape, ROUND(LEN(LIST_INTERSECT(x, g))::DOUBLE / LEN(LIST_DISTINCT(LIST_CONCAT(x, g))), 6) AS overlap,
(confidence = 'confirmed')::INTEGER AS confirmed, evidence, contradictions, ROUND(evidence::DOUBLE / (evidence + contradictions + 1), 6) AS support, ROUND(COALESCE(GREATEST(0, 1 - DATE_DIFF('day', reviewed, DATE '1998-12-31') / 365.0::DOUBLE), 0), 6) AS recency FROM t""")
def rank_features(spark, d):
    """Each pattern's text as a query, with its own pattern, the next and the sixth after it."""
    k, shown = F.col("id"), lambda p: F.when(F.col("id") % 6 == 0, "").otherwise(F.col(p))
    p = _patterns(spark, d)
    q = p.select(k.alias("query"), shown("package").alias("package"), F.concat(F.lit("n_"), k % 4, F.lit("."), k + 1).alias("kind"), F.concat(F.lit("use "), "package", F.lit(" G"), k % 4).alias("text"), F.explode(F.array(k, k + 1, k + 6)).alias("id"))
    known = p.select("id", shown("package").alias("p"), "guidance", "confidence", "evidence", "contradictions", F.when(k % 11 > 0, F.date_add(F.lit("1997-01-01"), (k % 700).cast("int")).cast("string")).alias("reviewed"))
    return E.features(q.join(known, "id"), "1998-12-31").withColumns({c: _r(F.col(c)) for c in ("shape", "overlap", "support", "recency")})


# --- graphs, texts, sources -----------------------------------------------------------------------

@query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
w(node, level) AS (SELECT DISTINCT parent, 0 FROM e WHERE parent NOT IN (SELECT child FROM e) UNION ALL SELECT child, level + 1 FROM w JOIN e ON parent = node) SELECT node, MAX(level) AS level FROM w GROUP BY 1""")
def dep_levels(spark, d):
    n, s = _t(spark, d, "nation"), _t(spark, d, "supplier")
    name = lambda p, c: F.concat(F.lit(p), c)
    return G.levels(n.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child")).union(s.select(name("n", "s_nationkey"), name("s", "s_suppkey"))))


@query("""SELECT conv_id, turn::VARCHAR AS node, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations""")
def topological_order(spark, d):
    c = _t(spark, d, "conversations")
    name = lambda x: x.cast("string")
    nodes = c.select("conv_id", name(F.col("turn")).alias("node"), (-F.col("turn")).alias("ord"))
    edges = c.where("turn > 0").select("conv_id", name(F.col("turn")).alias("node"), name(F.col("turn") - 1).alias("needs"))
    return G.topological_order(nodes, edges, "conv_id")


@query("SELECT p_partkey, SUBSTR(REGEXP_REPLACE(LOWER(p_name || ' ' || p_type), '[^a-z0-9.\\-]', '-', 'g'), 1, 60) AS slug FROM part")
def slugify(spark, d):
    return _t(spark, d, "part").select("p_partkey", S.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


_ADDRESSES = """(SELECT page_id, CASE page_id % 8 WHEN 0 THEN REPLACE(url, 'https://', 'https://github.com/') WHEN 1 THEN 'https://github.com/a/' || page_id || '.R' WHEN 2 THEN url || '/x_' || page_id || '.tar.gz/' WHEN 3 THEN 'https://cran.r-project.org/' || page_id
  WHEN 4 THEN url || '.r' WHEN 5 THEN 'https://rpubs.com/u/' || page_id WHEN 6 THEN 'https://rpubs.com/' || page_id || '.R' ELSE url END AS url FROM pages)"""


@query(f"""SELECT page_id, CASE WHEN CONTAINS(u, 'github.com') AND NOT SUFFIX(u, '.R') THEN 'github' WHEN CONTAINS(u, 'cran.r-project.org') OR SUFFIX(u, '.tar.gz') THEN 'cran' WHEN SUFFIX(u, '.R') OR SUFFIX(u, '.r') THEN 'script' WHEN CONTAINS(u, 'rpubs.com') THEN 'rpubs' ELSE 'other' END AS kind
FROM (SELECT page_id, RTRIM(url, '/') AS u FROM {_ADDRESSES})""")
def url_classes(spark, d):
    k, url = F.col("page_id"), F.col("url")
    join = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    address = (
        F.when(k % 8 == 0, F.replace(url, F.lit("https://"), F.lit("https://github.com/"))).when(k % 8 == 1, join("https://github.com/a/", k, ".R")).when(k % 8 == 2, join(url, "/x_", k, ".tar.gz/"))
        .when(k % 8 == 3, join("https://cran.r-project.org/", k)).when(k % 8 == 4, join(url, ".r")).when(k % 8 == 5, join("https://rpubs.com/u/", k)).when(k % 8 == 6, join("https://rpubs.com/", k, ".R")).otherwise(url)
    )
    return _t(spark, d, "pages").select("page_id", S.url_class(address).alias("kind"))


@query("SELECT doc_id, CASE WHEN LENGTH(text) > 120 THEN SUBSTR(text, 1, 120) || '…' ELSE text END AS preview, CASE WHEN LENGTH(text) > 500 THEN SUBSTR(text, 1, 500) || '... (' || (LENGTH(text) - 500) || ' more chars)' ELSE text END AS shortened FROM documents")
def previews(spark, d):
    return _t(spark, d, "documents").select("doc_id", S.preview(F.col("text")).alias("preview"), S.shortened(F.col("text")).alias("shortened"))


@query("""SELECT page_id, COUNT(*) AS n_blocks, SUM(LENGTH(REPLACE(REPLACE(REPLACE(REPLACE(b, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')))::BIGINT AS n_chars FROM (SELECT page_id, UNNEST(REGEXP_EXTRACT_ALL(html, '(?is)<p[^>]*>(.*?)</p>', 1)) AS b FROM pages) GROUP BY 1""")
def html_blocks(spark, d):
    return readers.html_blocks(_t(spark, d, "pages"), "html", "p").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("block")).alias("n_chars"))


@query("""SELECT user_id AS key, COUNT(*) FILTER (event_type = 'view') AS evidence, COUNT(*) FILTER (event_type = 'view' AND value > 50) AS real_evidence, COUNT(*) FILTER (event_type = 'click') AS ties, COUNT(*) FILTER (event_type = 'purchase') AS contradictions FROM events GROUP BY 1""")
def evidence_fold(spark, d):
    kind = F.expr("CASE event_type WHEN 'view' THEN 'evidence' WHEN 'click' THEN 'tie' WHEN 'purchase' THEN 'contradiction' ELSE 'other' END")
    return stream.fold(_t(spark, d, "events").select(F.col("user_id").alias("key"), kind.alias("kind"), (F.col("value") - 50).alias("delta")))


@query(r"""SELECT doc_id, TRIM(REGEXP_REPLACE(TRANSLATE(REGEXP_REPLACE(REGEXP_REPLACE('[1] TRUE "' || lang || '", (' || source || ')  FALSE #' || CASE WHEN doc_id % 2 = 0 THEN 'aabbcc' ELSE 'AABBCCDDE' END, '(?m)^[ ]*\[\d+\][ ]*', '', 'g'), '\bTRUE\b', 'True', 'g'), '"''[](),{}:', ''), '\s+', ' ', 'g')) AS plain FROM documents""")
def normalise_printed(spark, d):
    shown = F.concat(F.lit('[1] TRUE "'), "lang", F.lit('", ('), "source", F.lit(")  FALSE #"), F.when(F.col("doc_id") % 2 == 0, "AABBcc").otherwise("AABBCCDDE"))
    return _t(spark, d, "documents").select("doc_id", F.regexp_replace(C.normalise_printed(shown), "False", "FALSE").alias("plain"))


@query(r"""SELECT p_partkey, REGEXP_REPLACE('f(size=' || p_size || ', size == 1)', '\bsize(\s*)=([^=])', 'size_val\1=\2', 'g') AS renamed FROM part""")
def kwarg_rename(spark, d):
    return _t(spark, d, "part").select("p_partkey", S.rename_keyword(F.concat(F.lit("f(size="), "p_size", F.lit(", size == 1)")), "size").alias("renamed"))


_SOURCES = r"""(SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'x <- rnorm(' || p_size || ') # ' || p_name WHEN 1 THEN '  y.z = mean(sample(' || p_size || '))' WHEN 2 THEN '# ' || p_name || chr(10) || '1 + read.csv ("a")' WHEN 3 THEN '# load(' || p_name || ')'
  WHEN 4 THEN p_name || ' == Sys.time()' ELSE 'f.' || p_size || '(runif(1))' END AS source FROM part)"""


@query(rf"""SELECT p_partkey, call, call IN ('rnorm', 'runif', 'sample', 'read.csv', 'load', 'Sys.time') AS is_source
FROM (SELECT p_partkey, REGEXP_EXTRACT(REGEXP_REPLACE(TRIM(REGEXP_REPLACE(source, '#[^\n]*', '', 'g'), ' ' || chr(10)), '^[A-Za-z_.][\w.]*\s*(<-|=)\s*', ''), '\b([A-Za-z_][\w.]*)\s*\(', 1) AS call FROM {_SOURCES})""")
def comment_strip_classify(spark, d):
    n = F.col("p_size")
    join = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    name = F.col("p_name")
    source = (
        F.when(n % 6 == 0, join("x <- rnorm(", n, ") # ", name)).when(n % 6 == 1, join("  y.z = mean(sample(", n, "))")).when(n % 6 == 2, join("# ", name, '\n1 + read.csv ("a")'))
        .when(n % 6 == 3, join("# load(", name, ")")).when(n % 6 == 4, join(name, " == Sys.time()")).otherwise(join("f.", n, "(runif(1))"))
    )
    return _t(spark, d, "part").select("p_partkey", S.leading_call(source).alias("call"), S.is_source(source).alias("is_source"))


@query("""WITH b AS (SELECT o_custkey, MAX(o_totalprice) AS best, COUNT(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, best, n, ROW_NUMBER() OVER (ORDER BY COALESCE(best, -1) DESC, c_custkey)::INTEGER AS place FROM customer LEFT JOIN b ON c_custkey = o_custkey""")
def status_sort(spark, d):
    best = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("best"), F.count(F.lit(1)).alias("n"))
    rows = _t(spark, d, "customer").select("c_custkey").join(best, "c_custkey", "left")
    return R.numbered(rows, [F.coalesce("best", F.lit(-1.0)).desc(), "c_custkey"], "place").withColumn("place", F.col("place").cast("int"))


@query()
def warnings_compare(spark, d):
    """Sorted messages of two sides of a conversation, compared as one text."""
    c = _t(spark, d, "conversations")
    side = lambda role, n: c.where(F.col("role") == role).groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias(n))
    return C.text_similarity(side("user", "a").join(side("assistant", "b"), "conv_id"), "a", "b").select("conv_id", _r(F.col("similarity")).alias("similarity"))


@query()
def html_similarity(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.col("html").alias("a"))
    other = p.select((F.col("page_id") - 1).alias("page_id"), F.col("a").alias("b"))
    return p.join(other, "page_id").select("page_id", _r(M.markup_ratio(F.col("a"), F.col("b"))).alias("similarity"))


# --- extensions -----------------------------------------------------------------------------------

@query("SELECT TIME_BUCKET(INTERVAL 1 HOUR, ts) AS start, event_type, COUNT(*) AS n, ROUND(SUM(value), 6) AS total FROM events GROUP BY ALL")
def ext_event_windows(spark, d):
    return stream.windowed(_t(spark, d, "events"))


@query("""WITH e AS (SELECT user_id, event_id, NULLIF(event_id % 3, 0) AS v FROM events)
SELECT event_id, user_id, COALESCE(LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), FIRST_VALUE(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM e""")
def ext_fill_missing(spark, d):
    ev = _t(spark, d, "events").select("event_id", "user_id", F.nullif(F.col("event_id") % 3, F.lit(0)).alias("v"))
    return W.fill_missing(ev, "user_id", ["event_id"], "v", "downup").drop("v")


@query("""SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def ext_rollup(spark, d):
    li = _t(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.rollup("l_returnflag", "l_linestatus").agg(_r(F.sum("l_quantity"), 2).alias("sum_qty"), _r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("""WITH y AS (SELECT UNNEST(RANGE(1990, 2040))::INTEGER AS y), a AS (SELECT y, y % 19 AS g, y // 100 AS c FROM y), b AS (SELECT *, (c - c // 4 - (8 * c + 13) // 25 + 19 * g + 15) % 30 AS h FROM a),
i AS (SELECT *, h - (h // 28) * (1 - (29 // (h + 1)) * ((21 - g) // 11)) AS i FROM b), l AS (SELECT *, i - (y + y // 4 + i + 2 - c + c // 4) % 7 AS l FROM i)
SELECT y AS year, MAKE_DATE((y)::BIGINT, (3 + (l + 40) // 44)::BIGINT, (l + 28 - 31 * ((3 + (l + 40) // 44) // 4))::BIGINT) AS day FROM l""")
def ext_easter(spark, d):
    return spark.range(1990, 2040).select(F.col("id").cast("int").alias("year"), S.easter(F.col("id").cast("int")).alias("day"))
