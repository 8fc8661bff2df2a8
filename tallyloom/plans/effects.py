"""Named queries on observed effects: files, environments, pictures, printed text, captured names, entities of scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import compare as C
from ..functions import scalar as S
from ..operators import graph as G
from ..operators import joins as J
from ..operators import scoring as R
from ..operators import windows as W
from ..sources import readers
from .catalog import _r, _t, query

# --- files, environment, pictures -----------------------------------------------------------------

_FILES = """e AS (SELECT source AS g, 'f' || doc_id // 2 AS path, MIN(SHA256(text)) AS hash FROM documents GROUP BY ALL),
a AS (SELECT source AS g, 'f' || doc_id // 2 AS path, MIN(SHA256(CASE WHEN doc_id % 6 = 0 THEN text || '!' ELSE text END)) AS hash FROM documents WHERE doc_id % 10 > 1 GROUP BY ALL)"""


def _files(spark, d):
    docs, k = _t(spark, d, "documents"), F.col("doc_id")
    path = F.concat(F.lit("f"), F.expr("doc_id div 2")).alias("path")
    side = lambda df, text: df.groupBy(F.col("source").alias("g"), path).agg(F.min(F.sha2(text, 256)).alias("hash"))
    return side(docs, F.col("text")), side(docs.where(k % 10 > 1), F.when(k % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))


@query(f"""WITH {_FILES}, s AS (SELECT e.g, AVG((e.hash IS NOT DISTINCT FROM a.hash)::INTEGER::DOUBLE) AS score FROM e LEFT JOIN a ON e.g IS NOT DISTINCT FROM a.g AND e.path = a.path GROUP BY 1)
SELECT g, ROUND(score, 6) AS score, CASE WHEN score >= 1 THEN 'pass' ELSE 'fail' END AS verdict FROM s""")
def hash_compare(spark, d):
    s = J.files_score(*_files(spark, d), "g")
    return s.select("g", _r(F.col("score")).alias("score"), C.passes(F.lit("FILES"), F.col("score")).alias("verdict"))


@query("""WITH b AS (SELECT doc_id, '/w/' || lang || '/' || doc_id AS path, SHA256(text) AS h FROM documents WHERE doc_id % 5 <> 0),
a AS (SELECT '/w/' || lang || '/' || doc_id AS path, SHA256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents)
SELECT a.path, a.h AS hash, b.path IS NULL AS is_new FROM a LEFT JOIN b USING (path) WHERE a.h IS DISTINCT FROM b.h AND NOT STARTS_WITH(a.path, '/w/en/')""")
def escape_check(spark, d):
    docs, k = _t(spark, d, "documents"), F.col("doc_id")
    path = F.concat(F.lit("/w/"), "lang", F.lit("/"), k.cast("string")).alias("path")
    before = docs.where(k % 5 != 0).select(path, F.sha2("text", 256).alias("hash"))
    return J.escaped(before, docs.select(path, F.sha2(F.when(k % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash")), "/w/en")


@query("""WITH x AS (SELECT user_id, event_type AS name, MAX(value) FILTER (event_id % 3 <> 1) AS b, COUNT(*) FILTER (event_id % 3 <> 1) AS nb, MAX(value) FILTER (event_id % 3 <> 0) AS a, COUNT(*) FILTER (event_id % 3 <> 0) AS na FROM events GROUP BY ALL)
SELECT user_id, name, a AS value FROM x WHERE (nb > 0 OR na > 0) AND (nb = 0 OR na = 0 OR a IS DISTINCT FROM b)""")
def env_diff(spark, d):
    side = lambda r: _t(spark, d, "events").where(F.col("event_id") % 3 != r).groupBy("user_id", F.col("event_type").alias("name")).agg(F.max("value").alias("value"))
    return J.env_changes(side(1), side(0), ["user_id", "name"])


@query("""WITH p AS (SELECT page_id % 50 AS g, page_id // 50 AS place, page_id, SHA256(html) AS h FROM pages), e AS (SELECT * FROM p),
a AS (SELECT g, place, CASE WHEN page_id % 35 = 0 THEN SHA256('') ELSE h END AS h FROM p WHERE NOT (g % 7 = 3 AND place = 0)),
z AS (SELECT COALESCE(e.g, a.g) AS g, MAX((e.h IS NULL OR a.h IS NULL)::INTEGER) AS counts, MIN((e.h IS NOT DISTINCT FROM a.h)::INTEGER) AS same FROM e FULL OUTER JOIN a ON e.g = a.g AND e.place = a.place GROUP BY 1)
SELECT g, CASE WHEN counts = 1 THEN 'fail' WHEN same = 1 THEN 'pass' ELSE 'uncomparable' END AS verdict, CASE WHEN counts = 0 AND same = 1 THEN 1.0::DOUBLE ELSE 0 END AS score FROM z""")
def graphics_compare(spark, d):
    p = _t(spark, d, "pages").select((F.col("page_id") % 50).alias("g"), F.expr("page_id div 50").alias("place"), "page_id", F.sha2("html", 256).alias("hash"))
    other = p.where("not (g % 7 = 3 and place = 0)").withColumn("hash", F.when(F.col("page_id") % 35 == 0, F.sha2(F.lit(""), 256)).otherwise(F.col("hash")))
    return J.graphics_score(p, other, "g")


@query("SELECT page_id, STRLEN(html)::BIGINT AS n_bytes FROM pages WHERE STRLEN(html) >= 2000")
def min_size(spark, d):
    return _t(spark, d, "pages").select("page_id", F.octet_length("html").cast("long").alias("n_bytes")).where("n_bytes >= 2000")


@query("""SELECT doc_id, REGEXP_MATCHES(LOWER(source || CASE doc_id % 5 WHEN 0 THEN '.CSV' WHEN 1 THEN '.json' WHEN 2 THEN '.yml' WHEN 3 THEN '.png' ELSE '.csv.gz' END), '\\.(csv|txt|json|tsv|xml|yaml|yml|log)$') AS is_text FROM documents""".replace("\\\\", "\\"))
def text_files(spark, d):
    ending = F.expr("CASE doc_id % 5 WHEN 0 THEN '.CSV' WHEN 1 THEN '.json' WHEN 2 THEN '.yml' WHEN 3 THEN '.png' ELSE '.csv.gz' END")
    return _t(spark, d, "documents").select("doc_id", C.is_text_file(F.concat("source", ending)).alias("is_text"))


@query()
def stdout_compare(spark, d):
    """Printed text of a turn and the next one: similarity and verdict."""
    c = _t(spark, d, "conversations").select("conv_id", "turn", "text")
    other = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    s = C.text_similarity(c.withColumnRenamed("text", "a").join(other, ["conv_id", "turn"]), "a", "b")
    return s.select("conv_id", "turn", _r(F.col("similarity")).alias("similarity"), C.passes(F.lit("STDOUT"), F.col("similarity")).alias("verdict"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'infra' WHEN event_id % 4 = 1 THEN 'value' END AS tag, ROUND(CASE WHEN event_id % 4 = 0 THEN (event_id % 9) / 9.0::DOUBLE WHEN event_id % 4 = 1 THEN 0 ELSE 1 END, 6) AS score FROM events""")
def infra_rescue(spark, d):
    k = F.col("event_id")
    tag = F.when(k % 4 == 0, "infra").when(k % 4 == 1, "value")
    score = C.infra_rescue(tag, F.when(tag.isNull(), 1.0).otherwise(0.0), (k % 9) / 9.0)
    return _t(spark, d, "events").select("event_id", tag.alias("tag"), _r(F.coalesce(score, F.lit(1.0))).alias("score"))


@query("""WITH l AS (SELECT conv_id, turn, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS line, text, CASE WHEN (conv_id + turn) % 3 = 0 THEN text || '.' ELSE text END AS other FROM conversations),
u AS (SELECT * FROM l WHERE NOT (conv_id % 5 = 4 AND line = 1)), m AS (SELECT conv_id FROM l GROUP BY 1 HAVING conv_id % 5 <> 4),
f AS (SELECT conv_id, line, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY line) AS n, COUNT(*) OVER (PARTITION BY conv_id) AS total FROM l JOIN m USING (conv_id) WHERE text IS DISTINCT FROM other)
SELECT conv_id, line, total >= 3 AS more, NULL::VARCHAR AS note FROM f WHERE n <= 3
UNION ALL SELECT conv_id, NULL, FALSE, CASE WHEN COUNT(*) = 1 THEN 'no_actual' ELSE 'uneven' END FROM l WHERE conv_id % 5 = 4 GROUP BY 1""")
def diff_lines(spark, d):
    """Lines that differ, at most three a conversation; those of conversations without as many lines on the other side are no subject of it, but are noted."""
    line = F.row_number().over(W.Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("line")
    lines = _t(spark, d, "conversations").select("conv_id", "turn", line, "text")
    other = lines.where("not (conv_id % 5 = 4 and line = 1)").withColumn("text", F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return W.first_differences(lines.drop("turn"), other.drop("turn"), "conv_id")


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'uncomparable' END AS verdict FROM conversations""")
def judge_verdict(spark, d):
    said = F.expr("CASE turn % 4 WHEN 0 THEN ' <verdict> PASS </verdict>' WHEN 1 THEN '<Verdict>fail</Verdict>' WHEN 2 THEN '<verdict>maybe</verdict>' ELSE '' END")
    return _t(spark, d, "conversations").select("conv_id", "turn", C.judged(F.concat(F.replace("text", F.lit("<"), F.lit(" ")), said)).alias("verdict"))


@query("""WITH e AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'DATA' WHEN 1 THEN 'STDOUT' WHEN 2 THEN 'FILES' WHEN 3 THEN 'HTML' WHEN 4 THEN 'GRAPHICS' WHEN 5 THEN CASE WHEN event_id % 2 = 0 THEN 'WARNINGS' ELSE 'NETWORK' END ELSE CASE WHEN event_id % 2 = 0 THEN 'ENV' ELSE 'OTHER' END END AS effect, value / 100 AS score FROM events)
SELECT event_id, effect, CASE WHEN effect = 'OTHER' THEN NULL WHEN score >= CASE effect WHEN 'HTML' THEN 0.7::DOUBLE WHEN 'GRAPHICS' THEN 0.9 WHEN 'STDOUT' THEN 0.95 WHEN 'WARNINGS' THEN 0.95 WHEN 'NETWORK' THEN 0.95 ELSE 1 END THEN 'pass' ELSE 'fail' END AS verdict FROM e""")
def threshold_verdicts(spark, d):
    effect = F.expr("CASE event_id % 7 WHEN 0 THEN 'DATA' WHEN 1 THEN 'STDOUT' WHEN 2 THEN 'FILES' WHEN 3 THEN 'HTML' WHEN 4 THEN 'GRAPHICS' WHEN 5 THEN CASE WHEN event_id % 2 = 0 THEN 'WARNINGS' ELSE 'NETWORK' END ELSE CASE WHEN event_id % 2 = 0 THEN 'ENV' ELSE 'OTHER' END END")
    return _t(spark, d, "events").select("event_id", effect.alias("effect"), C.passes(effect, F.col("value") / 100).alias("verdict"))


@query("""WITH e AS (SELECT user_id, CASE event_id % 4 WHEN 0 THEN 'DATA' WHEN 1 THEN 'STDOUT' WHEN 2 THEN 'HTML' ELSE 'SYNTAX' END AS effect, event_id % 3 = 0 AS had, value FROM events),
p AS (SELECT user_id, effect FROM e WHERE had GROUP BY ALL)
SELECT user_id, effect, COUNT(*) AS n FROM e WHERE effect = 'SYNTAX' OR (user_id, effect) IN (SELECT (user_id, effect) FROM p) GROUP BY ALL""")
def by_effect(spark, d):
    """Scores of effects that the expected side had, and always those of the syntax."""
    effect = F.expr("CASE event_id % 4 WHEN 0 THEN 'DATA' WHEN 1 THEN 'STDOUT' WHEN 2 THEN 'HTML' ELSE 'SYNTAX' END").alias("effect")
    e = _t(spark, d, "events").select("user_id", effect, (F.col("event_id") % 3 == 0).alias("had"))
    return e.groupBy("user_id", "effect").agg(F.count(F.lit(1)).alias("n"), F.max("had").alias("had")).where("had or effect = 'SYNTAX'").drop("had")


@query("""SELECT o_custkey, COUNT(*) FILTER (o_totalprice > 200000) > 0 AS data, COUNT(*) FILTER (o_orderstatus = 'F') > 0 AS stdout, COUNT(*) FILTER (o_orderpriority = '1-URGENT') AS n_graphics,
COUNT(*) FILTER (o_totalprice > 200000 OR o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') > 0 AS has_output FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, NULL, NULL, NULL, TRUE FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def has_output(spark, d):
    """Which effects a side had; a side that was never seen counts as one with output."""
    some = lambda c: F.max(F.expr(c))
    seen = _t(spark, d, "orders").groupBy("o_custkey").agg(some("o_totalprice > 200000").alias("data"), some("o_orderstatus = 'F'").alias("stdout"), F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("n_graphics"))
    both = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")).join(seen, "o_custkey", "left")
    return both.withColumn("has_output", F.col("data").isNull() | F.col("data") | F.col("stdout") | (F.col("n_graphics") > 0))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 3 ELSE 2 END AS n_left, s_name AS home, CASE WHEN s_suppkey % 2 = 0 THEN 'en' END AS lang FROM supplier""")
def env_allowlist(spark, d):
    env = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("HOME"), F.col("s_name"), F.lit("SECRET"), F.lit("x"), F.lit("LANG"), F.lit("en"))).otherwise(F.create_map(F.lit("HOME"), F.col("s_name"), F.lit("PYTHONIOENCODING"), F.lit("latin-1")))
    got = _t(spark, d, "supplier").select("s_suppkey", S.scrubbed_env(env).alias("m"))
    return got.select("s_suppkey", F.size("m").alias("n_left"), F.element_at("m", "HOME").alias("home"), F.try_element_at("m", F.lit("LANG")).alias("lang"))


# --- captured values and bundles ------------------------------------------------------------------

@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Inf' WHEN 2 THEN (event_id % 100)::VARCHAR WHEN 3 THEN CASE WHEN event_id % 4 = 1 THEN 'true' ELSE 'false' END WHEN 4 THEN STRFTIME(ts, '%Y-%m-%d') ELSE '__uncapturable__' END AS value FROM events""")
def canonical_value(spark, d):
    k = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("nan", "inf", "int", "flag", "day", "handle")]), (k % 6 + 1).cast("int"))
    number = F.when(kind == "nan", float("nan")).when(kind == "inf", float("inf"))
    adapters = [(kind.isin("nan", "inf"), S.finite(number)), (kind == "int", (k % 100).cast("string")), (kind == "flag", (k % 4 == 1).cast("string")), (kind == "day", F.date_format("ts", "yyyy-MM-dd"))]
    return _t(spark, d, "events").select("event_id", S.canonical_value(adapters).alias("value"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 ELSE 3 END AS n, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '[1,2]' ELSE '{"a":' || event_id || '}' END AS x, CASE WHEN event_id % 5 <> 0 THEN 'null' END AS y, CASE WHEN event_id % 5 <> 0 THEN '"Inf"' END AS z FROM events""")
def state_decode(spark, d):
    """Captured state: broken JSON is empty, values that are JSON in a string are decoded once more, numbers that JSON lacks get names."""
    k = F.col("event_id").cast("string")
    inner = F.when(F.col("event_id") % 5 == 1, F.lit('"[1, 2]"')).when(F.col("event_id") % 5 == 2, F.concat(F.lit('"{\\"a\\": '), k, F.lit('}"'))).otherwise(F.concat(F.lit('{"a": '), k, F.lit("}")))
    text = F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.concat(F.lit('{"x": '), inner, F.lit(', "y": NaN, "z": Infinity}')))
    m = _t(spark, d, "events").select("event_id", S.decoded_state(text).alias("m"))
    return m.select("event_id", F.size("m").alias("n"), *[F.try_element_at("m", F.lit(c)).alias(c) for c in "xyz"])


@query("SELECT doc_id, LENGTH(text) AS n_chars, SHA256(text) AS hash FROM documents")
def bundle_round_trip(spark, d):
    """Bytes of a bundle as base64 in JSON, and back."""
    json = F.to_json(F.struct("doc_id", F.base64(F.col("text").cast("binary")).alias("png")))
    back = F.from_json(json, "doc_id bigint, png string")
    return _t(spark, d, "documents").select(back.alias("b")).select("b.doc_id", F.length(F.unbase64("b.png").cast("string")).cast("long").alias("n_chars"), F.sha2(F.unbase64("b.png"), 256).alias("hash"))


@query("SELECT conv_id, COUNT(*)::INTEGER AS n_entities, MAX(turn) AS last_turn, SUM(LENGTH(text))::BIGINT AS n_chars FROM conversations GROUP BY 1")
def script_map_round_trip(spark, d):
    """Scripts as JSON trees of their entities, read back. A tree is one document, as wide as its script."""
    c = _t(spark, d, "conversations")
    entity = F.struct("turn", "role", "text")
    kind = f"struct<conv_id:bigint,entities:array<struct<turn:{c.schema['turn'].dataType.simpleString()},role:string,text:string>>>"
    trees = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(entity)).alias("entities")).select(F.to_json(F.struct("conv_id", "entities")).alias("json"))
    back = trees.select(F.from_json("json", kind).alias("t"))
    total = F.aggregate("t.entities", F.lit(0).cast("long"), lambda s, e: s + F.length(e["text"]))
    return back.select("t.conv_id", F.size("t.entities").alias("n_entities"), F.array_max(F.transform("t.entities", lambda e: e["turn"])).alias("last_turn"), total.alias("n_chars"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'e' || user_id END AS entity, CASE WHEN event_id % 3 = 1 THEN event_id END AS n FROM events""")
def checkpoint_files(spark, d):
    """Entities from names of checkpoint files, and their content; other files and broken content give null."""
    k = F.col("event_id")
    path = F.when(k % 3 == 0, F.concat(F.lit("/w/other_"), k.cast("string"), F.lit(".json"))).otherwise(F.concat(F.lit("/w/cp_e"), F.col("user_id").cast("string"), F.lit(".json")))
    content = F.when(k % 3 == 2, "{").otherwise(F.concat(F.lit('{"n": '), k.cast("string"), F.lit("}")))
    entity = F.nullif(F.regexp_extract(path, r"/cp_([^/]+)\.json$", 1), F.lit(""))
    return _t(spark, d, "events").select("event_id", entity.alias("entity"), F.when(entity.isNotNull(), F.from_json(content, "n bigint")["n"]).alias("n"))


@query("""SELECT user_id, '{"n":' || COUNT(*) || ',"best":' || MAX(event_id) || '}' AS report FROM events GROUP BY 1""")
def score_report(spark, d):
    s = _t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("best"))
    return s.select("user_id", F.to_json(F.struct("n", "best")).alias("report"))


@query("""SELECT c_mktsegment AS package, SUBSTR(c_mktsegment || REPEAT(' ', 14), 1, 14) || LPAD(COUNT(*)::VARCHAR, 8, ' ') AS line FROM customer GROUP BY 1""")
def status_table(spark, d):
    n = _t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("package")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("package", F.concat(F.rpad("package", 14, " "), F.lpad(F.col("n").cast("string"), 8, " ")).alias("line"))


# --- entities of scripts --------------------------------------------------------------------------

_ENTITIES = "entities AS (SELECT event_id AS entity, user_id, event_type AS name, event_id % 1000 AS s, event_id % 1000 + event_id % 6 AS e FROM events)"


def _entity_spans(spark, d):
    k = F.col("event_id")
    return _t(spark, d, "events").select(k.alias("entity"), "user_id", F.col("event_type").alias("name"), (k % 1000).alias("s"), (k % 1000 + k % 6).alias("e"))


@query(f"""WITH {_ENTITIES}, marks AS (SELECT user_id, event_id % 1000 AS line, CASE event_id % 4 WHEN 0 THEN 'nse' WHEN 1 THEN 'super_assign' ELSE 'indexing' END AS flag FROM events),
f AS (SELECT entity, STRING_AGG(DISTINCT flag, ',' ORDER BY flag) AS flags FROM entities JOIN marks ON entities.user_id = marks.user_id AND line BETWEEN s AND e GROUP BY 1)
SELECT e.entity, COALESCE(flags, '') AS flags FROM entities e LEFT JOIN f USING (entity)""")
def line_bucket_join(spark, d):
    k = F.col("event_id")
    flag = F.when(k % 4 == 0, "nse").when(k % 4 == 1, "super_assign").otherwise("indexing")
    marks = _t(spark, d, "events").select("user_id", (k % 1000).alias("line"), flag.alias("flag"))
    return J.lines_of_spans(_entity_spans(spark, d).drop("name"), marks, "user_id", "s", "e").select("entity", F.array_join("flags", ",").alias("flags"))


@query(f"""WITH {_ENTITIES}, rows AS (SELECT event_id, user_id, event_id % 991 AS place FROM events), h AS (SELECT event_id, MIN(entity) AS cover FROM rows JOIN entities ON rows.user_id = entities.user_id AND place BETWEEN s AND e GROUP BY 1)
SELECT r.event_id, cover FROM rows r LEFT JOIN h USING (event_id)""")
def covering_entity(spark, d):
    points = _t(spark, d, "events").select("event_id", "user_id", (F.col("event_id") % 991).alias("place"))
    return J.first_cover(points, _entity_spans(spark, d).drop("name"), "user_id", "place", "s", "e", "entity", "entity", 8).select("event_id", "cover")


@query(f"""WITH {_ENTITIES}, b AS (SELECT event_id AS branch, user_id, event_id % 900 AS s, event_id % 900 + 40 AS e FROM events WHERE event_type = 'signup')
SELECT b.branch, COUNT(*) AS n_entities, MIN(entity) AS first_entity FROM b JOIN entities x ON b.user_id = x.user_id AND b.s <= x.s AND x.e <= b.e GROUP BY 1""")
def branch_entities(spark, d):
    k = F.col("event_id")
    b = _t(spark, d, "events").where("event_type = 'signup'").select(k.alias("branch"), "user_id", (k % 900).alias("from"), (k % 900 + 40).alias("to"))
    hit = J.points_in_intervals(_entity_spans(spark, d).drop("name"), b, "user_id", "s", "from", "to", 64).where("e <= to")
    return hit.groupBy("branch").agg(F.count(F.lit(1)).alias("n_entities"), F.min("entity").alias("first_entity"))


@query(f"WITH {_ENTITIES} SELECT user_id, name, ARG_MAX(s, entity) AS s, ARG_MAX(e, entity) AS e FROM entities GROUP BY ALL")
def last_range(spark, d):
    e = _entity_spans(spark, d).withColumn("key", F.struct("user_id", "name"))
    return W.last_ranges(e, "key", "entity", "s", "e").select("key.*", "s", "e")


_NAMES = """r AS (SELECT DISTINCT user_id, event_type || event_id % 3 AS name FROM events WHERE event_id % 2 = 0), c AS (SELECT DISTINCT user_id, event_type || event_id % 3 AS name FROM events WHERE event_id % 5 <> 0),
e AS (SELECT user_id, event_type || event_id % 3 AS name, MIN(event_id) % 4 <> 0 AS translatable FROM events WHERE event_id % 7 < 3 GROUP BY ALL)"""


def _names(spark, d):
    ev = _t(spark, d, "events").select("user_id", F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("name"), "event_id")
    pick = lambda c: ev.where(c).select("user_id", "name").distinct()
    entities = ev.where("event_id % 7 < 3").groupBy("user_id", "name").agg((F.min("event_id") % 4 != 0).alias("translatable"))
    return pick("event_id % 2 = 0"), pick("event_id % 5 <> 0"), entities


@query(f"WITH {_NAMES} SELECT user_id, name FROM r INTERSECT SELECT user_id, name FROM e")
def shared_names(spark, d):
    refs, _, entities = _names(spark, d)
    return refs.join(entities.select("user_id", "name"), ["user_id", "name"], "left_semi")


@query(f"WITH {_NAMES} SELECT user_id, name FROM r EXCEPT SELECT user_id, name FROM c")
def uncaptured_names(spark, d):
    refs, captured, _ = _names(spark, d)
    return refs.join(captured, ["user_id", "name"], "left_anti")


@query(f"WITH {_NAMES} (SELECT user_id, name FROM r UNION SELECT user_id, name FROM e WHERE NOT translatable) INTERSECT SELECT user_id, name FROM c")
def shim_names(spark, d):
    refs, captured, entities = _names(spark, d)
    return J.shim_names(entities, refs, captured, "user_id")


@query(f"""WITH {_NAMES}, s AS (SELECT * FROM ((SELECT user_id, name FROM r UNION SELECT user_id, name FROM e WHERE NOT translatable) INTERSECT SELECT user_id, name FROM c))
SELECT user_id, name FROM c WHERE (user_id, name) NOT IN (SELECT (user_id, name) FROM e) OR (user_id, name) IN (SELECT (user_id, name) FROM s)""")
def sidecar_names(spark, d):
    refs, captured, entities = _names(spark, d)
    return J.sidecar_names(captured, entities, J.shim_names(entities, refs, captured, "user_id"), "user_id")


@query("""WITH m AS (SELECT event_type AS name, MIN(event_id) AS probed FROM events GROUP BY 1) SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'own' WHEN probed % 2 = 0 THEN 'base' ELSE 'stats' END AS package FROM events JOIN m ON event_type = name""")
def metadata_fan_out(spark, d):
    """Each name probed once, its package given to all call sites that have none of their own."""
    ev = _t(spark, d, "events")
    where = F.array(F.lit(".GlobalEnv"), F.when(F.col("probed") % 2 == 0, "package:base").otherwise("package:stats"), F.lit("package:last"))
    probed = ev.groupBy("event_type").agg(F.min("event_id").alias("probed")).withColumn("where", where)
    found = F.regexp_extract(F.filter("where", lambda w: w.startswith("package:"))[0], "^package:(.*)$", 1)
    return ev.join(probed, "event_type").select("event_id", F.coalesce(F.when(F.col("user_id") % 3 == 0, "own"), found).alias("package"))


@query("""WITH b AS (SELECT DISTINCT event_id // 4 AS bundle, user_id FROM events) SELECT user_id, COUNT(*) AS n_bundles FROM b GROUP BY 1""")
def bundle_semi(spark, d):
    """Entities share bundles; each bundle of a script is taken once."""
    b = _t(spark, d, "events").select(F.expr("event_id div 4").alias("bundle"), "user_id")
    return b.dropDuplicates(["bundle", "user_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_bundles"))


@query("""WITH u AS (SELECT c_custkey AS script, c_custkey % 4 <> 0 AS has_input FROM customer), h AS (SELECT o_custkey + 5 AS script, COUNT(*) AS n FROM orders GROUP BY 1)
SELECT COALESCE(u.script, h.script) AS script, h.n IS NOT NULL AS translated, COALESCE(has_input, FALSE) AS has_input FROM u FULL OUTER JOIN h ON u.script = h.script""")
def translation_status(spark, d):
    inputs = _t(spark, d, "customer").select(F.col("c_custkey").alias("script"), (F.col("c_custkey") % 4 != 0).alias("has_input"))
    runs = _t(spark, d, "orders").groupBy((F.col("o_custkey") + 5).alias("script")).agg(F.count(F.lit(1)).alias("n"))
    return inputs.join(runs, "script", "full_outer").select("script", F.col("n").isNotNull().alias("translated"), F.coalesce("has_input", F.lit(False)).alias("has_input"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 4 + 1 END AS line FROM part""")
def symbol_lines(spark, d):
    """Where a source file defines the symbol f; the names of other symbols and calls of it don't count."""
    size = F.col("p_size") % 4
    line = F.when(size == 1, "f <- function(a)").when(size == 2, "f = function(a)").when(size == 3, "f<-function(a)").otherwise("g <- f(1)")
    text = F.concat_ws("\n", F.lit("# f <- function"), F.when(size > 1, "ff <- function(a)"), F.when(size > 2, "x <- f(2)"), line, F.lit("end"))
    return readers.symbol_lines(_t(spark, d, "part").select("p_partkey", text.alias("text")), "text", "f").select("p_partkey", "line")


@query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child, n_nationkey AS ord FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, s_suppkey FROM supplier),
w(node, depth, path) AS (SELECT 'r' || r_regionkey, 0, LPAD(r_regionkey::VARCHAR, 12, '0') FROM region UNION ALL SELECT child, depth + 1, path || '/' || LPAD(ord::VARCHAR, 12, '0') FROM w JOIN e ON parent = node) SELECT * FROM w""")
def tree_preorder(spark, d):
    n, s, r = _t(spark, d, "nation"), _t(spark, d, "supplier"), _t(spark, d, "region")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = n.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"), F.col("n_nationkey").cast("long").alias("ord"))
    edges = edges.union(s.select(name("n", "s_nationkey"), name("s", "s_suppkey"), F.col("s_suppkey").cast("long")))
    return G.preorder(edges, r.select(name("r", "r_regionkey").alias("node"), F.col("r_regionkey").cast("long").alias("ord")))


@query("""WITH x AS (SELECT user_id, event_id, 1 + event_id % 120 AS n_lines FROM events), s AS (SELECT *, SUM(LEAST(n_lines, 80)) OVER (PARTITION BY user_id ORDER BY event_id) AS spent FROM x)
SELECT user_id, event_id, spent::BIGINT AS spent FROM s WHERE spent - LEAST(n_lines, 80) < 200""")
def line_budget(spark, d):
    """Sources of callees in order until 200 lines are spent, 80 of a function at most."""
    x = _t(spark, d, "events").select("user_id", "event_id", (1 + F.col("event_id") % 120).alias("n_lines"))
    return G.budgeted(x, "user_id", ["event_id"], "n_lines", 200, 80).select("user_id", "event_id", "spent")


@query("""WITH l AS (SELECT conv_id, turn, turn % 3 AS k FROM conversations) SELECT conv_id, turn, SUM(CASE k WHEN 0 THEN 2 WHEN 1 THEN -1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS depth FROM l""")
def brace_depth(spark, d):
    line = F.expr("""CASE turn % 3 WHEN 0 THEN 'f <- function(x) { if (x == "}") { # {{' WHEN 1 THEN '} # }' ELSE 'y <- "{"' END""")
    own = _t(spark, d, "conversations").select("conv_id", "turn", S.brace_depth(line).alias("own"))
    return own.select("conv_id", "turn", F.sum("own").over(W.Window.partitionBy("conv_id").orderBy("turn")).alias("depth"))


@query("""SELECT doc_id, (LEN(text) - LEN(REPLACE(text, ' ', '')))::BIGINT AS n_chunks FROM documents WHERE CONTAINS(text, ' ')""")
def code_chunks(spark, d):
    """Fenced chunks of literate documents; each document here has one for each of its blanks."""
    plain = F.translate("text", "`{", "'(")
    docs = _t(spark, d, "documents").select("doc_id", F.replace(plain, F.lit(" "), F.lit("\n```{r x}\ny\n```\n")).alias("text"))
    return readers.code_chunks(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


# --- score tables ---------------------------------------------------------------------------------

@query("""WITH e AS (SELECT event_id AS id, event_type AS name, event_id % 10 <> 3 AS lines, event_id % 2 = 0 AS pre FROM events),
x AS (SELECT event_id AS id, event_id % 3 = 0 AS d, event_id % 4 = 0 AS s, event_id % 5 AS g FROM events WHERE event_id % 7 <> 0),
y AS (SELECT event_id AS id, event_id % 3 = 0 AS d, event_id % 8 = 0 AS s, event_id % 5 AS g, (event_id % 11) / 10.0::DOUBLE AS sd, (event_id % 8 = 0)::INTEGER::DOUBLE AS ss, 0.5::DOUBLE AS sg FROM events WHERE event_id % 10 NOT IN (3, 4)),
j AS (SELECT e.id, pre AS ok, y.id IS NOT NULL OR NOT lines AS r, COALESCE(x.d, FALSE) AS d, COALESCE(x.s, FALSE) AS s, COALESCE(x.g > 0, FALSE) AS g, COALESCE(y.d, FALSE) AS od, COALESCE(y.s, FALSE) AS os, COALESCE(y.g > 0, FALSE) AS og, sd, ss, sg
  FROM e LEFT JOIN x USING (id) LEFT JOIN y USING (id)),
k AS (SELECT *, d::INTEGER + s::INTEGER + g::INTEGER AS n, COALESCE(sd, (d = od)::INTEGER::DOUBLE) AS fd, COALESCE(ss, (s = os)::INTEGER::DOUBLE) AS fs, COALESCE(sg, (g = og)::INTEGER::DOUBLE) AS fg FROM j),
o AS (SELECT *, ok AND r AND (n > 0 OR NOT (od OR os OR og)) AS own FROM k)
SELECT id, ok AS executed_ok, own AS per_entity, ROUND(CASE WHEN own THEN CASE WHEN n > 0 THEN (d::INTEGER * fd + s::INTEGER * fs + g::INTEGER * fg) / n ELSE 1 END ELSE 0 END, 6) AS data_output,
ROUND(CASE WHEN own THEN fs ELSE 0.75 END, 6) AS stdout_output, ROUND(CASE WHEN own THEN (fg + fs) / 2 ELSE 0.5 END, 6) AS side_effects FROM o""")
def score_table(spark, d):
    """Scores of entities after a crash: those before it by their own effects, the rest by the whole run's, whose data count 0 then."""
    ev, k = _t(spark, d, "events"), F.col("event_id")
    side = lambda stdout: [k.alias("id"), (k % 3 == 0).alias("has_data"), (k % stdout == 0).alias("has_stdout"), (k % 5).alias("n_graphics")]
    entities = ev.select(k.alias("id"), F.col("event_type").alias("name"), (k % 10 != 3).alias("lines"), (k % 2 == 0).alias("before_crash"))
    actual = ev.where("event_id % 10 not in (3, 4)").select(*side(8), ((k % 11) / 10.0).alias("data"), (k % 8 == 0).cast("double").alias("stdout"), F.lit(0.5).alias("graphics"))
    variables = spark.createDataFrame([("click", 0.25)], "name string, score double")
    t = R.score_table(entities, ev.where("event_id % 7 <> 0").select(*side(4)), actual, variables, ran=False, mapped=True, data=0.0, stdout=0.75, effects=0.5)
    return t.select("id", "executed_ok", "per_entity", *[_r(F.col(c)).alias(c) for c in ("data_output", "stdout_output", "side_effects")])


@query("SELECT event_type, COUNT(*) AS n, MIN(value) AS least, MAX(value) AS most, ROUND(AVG(value), 6) AS mean, COUNT(*) FILTER (value >= 95) AS n_pass, COUNT(*) FILTER (value IS NULL) AS n_errors FROM events GROUP BY 1")
def score_stats(spark, d):
    v = F.col("value")
    return _t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), _r(F.avg(v)).alias("mean"), F.count_if(v >= 95).alias("n_pass"), F.count_if(v.isNull()).alias("n_errors"))


@query("""SELECT user_id, ROUND(AVG(value), 6) AS score FROM events GROUP BY 1 ORDER BY AVG(value), user_id LIMIT 10""")
def feedback_summary(spark, d):
    """The ten worst: a report."""
    s = _t(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("score"))
    return s.orderBy("score", "user_id").limit(10).withColumn("score", _r(F.col("score")))


@query("SELECT conv_id, STRING_AGG(DISTINCT role, ',' ORDER BY role) AS columns, MAX(n)::BIGINT AS n_rows FROM (SELECT conv_id, role, COUNT(*) AS n FROM conversations GROUP BY ALL) GROUP BY 1")
def data_shape(spark, d):
    n = _t(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))
    shape = n.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("m"))
    return shape.select("conv_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("columns"), F.array_max(F.map_values("m")).alias("n_rows"))


@query("""WITH f AS (SELECT user_id, ROW_NUMBER() OVER (ORDER BY MIN(event_id), user_id) AS place, COUNT(*) OVER () AS n FROM events GROUP BY 1) SELECT user_id, place > GREATEST(1, (n * 0.8)::DOUBLE // 1) AS validation FROM f""")
def train_val_split(spark, d):
    return R.last_fifth(_t(spark, d, "events"), "user_id", "event_id")


@query("""SELECT p_brand, ARG_MIN(p_partkey, (CASE WHEN CONTAINS(code, 'def ' || REPLACE(p_brand, '#', '_') || '(') THEN 0 ELSE 1 END, p_partkey)) AS entity FROM (SELECT *, CASE WHEN p_size % 9 = 0 THEN 'def ' || REPLACE(p_brand, '#', '_') || '(x): pass' ELSE p_name END AS code FROM part) GROUP BY 1""")
def representative_entity(spark, d):
    brand = F.replace("p_brand", F.lit("#"), F.lit("."))
    plain = F.replace("p_brand", F.lit("#"), F.lit("_"))
    code = F.when(F.col("p_size") % 9 == 0, F.concat(F.lit("def "), plain, F.lit("(x): pass"))).otherwise(F.col("p_name"))
    rows = _t(spark, d, "part").select("p_brand", "p_partkey", brand.alias("name"), code.alias("code"))
    return R.representatives(rows, "name", "code", "p_partkey").select("p_brand", F.col("p_partkey").alias("entity"))
