"""Named queries on nested values and on knowledge that carries examples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import examples as X
from ..operators import nested as N
from ..operators.tables import shared_folder
from ..streaming import patterns as P
from .catalog import _r, _t, query

# --- values of consecutive events -----------------------------------------------------------------

_VALUES = """v AS (SELECT event_id, user_id, ('{"a": ' || CASE event_type WHEN 'error' THEN '"none"' WHEN 'signup' THEN '[' || k % 3 || ', {"x": ' || (k % 2 = 0) || '}, 7]' ELSE '[' || k % 3 || ', {"x": ' || (k % 2 = 0) || ', "y": null}]' END
  || ', "b": {"c": ' || k % 2 || '.0, "' || CASE WHEN k % 5 = 0 THEN event_type ELSE 'd' END || '": [' || k // 50 || ', "' || event_type || '"]}, "p": ' || props || '}')::JSON AS j
  FROM (SELECT *, json_extract(props, '$.k')::INTEGER AS k FROM events))"""


def _values(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    flag = F.when(k % 2 == 0, "true").otherwise("false")
    kind = F.col("event_type")
    a = F.when(kind == "error", F.lit('"none"')).when(kind == "signup", F.concat(F.lit("["), k % 3, F.lit(', {"x": '), flag, F.lit("}, 7]"))).otherwise(F.concat(F.lit("["), k % 3, F.lit(', {"x": '), flag, F.lit(', "y": null}]')))
    b = F.concat(F.lit('{"c": '), k % 2, F.lit('.0, "'), F.when(k % 5 == 0, kind).otherwise("d"), F.lit('": ['), F.floor(k / 50), F.lit(', "'), kind, F.lit('"]}'))
    return _t(spark, d, "events").select("event_id", "user_id", F.concat(F.lit('{"a": '), a, F.lit(', "b": '), b, F.lit(', "p": '), "props", F.lit("}")).alias("j"))


@query(f"""WITH {_VALUES}, p AS (SELECT event_id, j AS e, LAG(j) OVER (PARTITION BY user_id ORDER BY event_id) AS a FROM v),
x AS (SELECT p.event_id, t.fullkey AS spot, t.type AS te, t.value AS e FROM p, json_tree(p.e) t WHERE a IS NOT NULL),
y AS (SELECT p.event_id, t.fullkey AS spot, t.type AS ta, t.value AS a FROM p, json_tree(p.a) t WHERE a IS NOT NULL),
n AS (SELECT x.event_id, x.spot, te, ta, e, a, te IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') AS ne, ta IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') AS na FROM x JOIN y ON x.event_id = y.event_id AND x.spot = y.spot),
r AS (SELECT event_id, spot, CASE WHEN te = 'NULL' AND ta = 'NULL' THEN NULL WHEN te = 'NULL' OR ta = 'NULL' THEN 'null'
    WHEN ne AND na THEN CASE WHEN ABS(CASE te WHEN 'BOOLEAN' THEN (e::VARCHAR = 'true')::INTEGER ELSE e::DOUBLE END - CASE ta WHEN 'BOOLEAN' THEN (a::VARCHAR = 'true')::INTEGER ELSE a::DOUBLE END) > 1e-9 + 1e-6 * ABS(CASE ta WHEN 'BOOLEAN' THEN (a::VARCHAR = 'true')::INTEGER ELSE a::DOUBLE END) THEN 'number' END
    WHEN te = 'VARCHAR' AND ta = 'VARCHAR' THEN CASE WHEN e::VARCHAR <> a::VARCHAR THEN 'text' END
    WHEN te = 'ARRAY' AND ta = 'ARRAY' THEN CASE WHEN json_array_length(e) <> json_array_length(a) THEN 'length' END
    WHEN te = 'OBJECT' AND ta = 'OBJECT' THEN CASE WHEN list_sort(json_keys(e)) <> list_sort(json_keys(a)) THEN 'keys' END ELSE 'type' END AS reason FROM n),
f AS (SELECT event_id, MIN(spot) AS spot, ARG_MIN(reason, spot) AS reason FROM r WHERE reason IS NOT NULL GROUP BY 1)
SELECT p.event_id, (f.event_id IS NULL)::INTEGER::DOUBLE AS score, CASE WHEN f.event_id IS NULL THEN 'pass' ELSE 'fail' END AS verdict, CASE WHEN reason IN ('length', 'keys', 'type') THEN 'infra' WHEN reason IS NOT NULL THEN 'value' END AS tag, SUBSTR(spot, 2) AS "at", reason
FROM p LEFT JOIN f USING (event_id) WHERE p.a IS NOT NULL""")
def nested_compare(spark, d):
    """Each event's nested value against that of the user's event before."""
    from pyspark.sql import Window

    before = F.lag("j").over(Window.partitionBy("user_id").orderBy("event_id"))
    pairs = _values(spark, d).withColumn("before", before).where("before is not null")
    return N.nested_compare(pairs.select("event_id", F.parse_json("j").alias("e"), F.parse_json("before").alias("a")), ["event_id"])


@query("""WITH e AS (SELECT user_id AS run, 'v' || event_id % 50 AS name, MAX(json_extract(props, '$.k')::INTEGER) AS k FROM events GROUP BY ALL),
a AS (SELECT run, name, CASE WHEN k % 7 = 0 THEN k + 1 ELSE k END AS k FROM e WHERE k % 11 <> 0), u AS (SELECT run, name FROM e WHERE k % 13 = 0),
s AS (SELECT e.run, e.name, CASE WHEN a.k IS NOT NULL AND ABS(e.k - a.k) <= 1e-9 + 1e-6 * a.k THEN 1.0::DOUBLE ELSE 0 END AS score FROM e LEFT JOIN a USING (run, name) ANTI JOIN u ON e.run = u.run AND e.name = u.name),
n AS (SELECT run, COUNT(*) AS n_scored, AVG(score) AS score FROM s GROUP BY 1), m AS (SELECT run, COUNT(*) AS n_uncomparable FROM u GROUP BY 1)
SELECT r.run, ROUND(COALESCE(score, (m.run IS NULL)::INTEGER), 6)::DOUBLE AS score, CASE WHEN n.run IS NULL THEN CASE WHEN m.run IS NULL THEN 'pass' ELSE 'uncomparable' END WHEN score >= 1 THEN 'pass' ELSE 'fail' END AS verdict,
COALESCE(n_scored, 0) AS n_scored, COALESCE(n_uncomparable, 0) AS n_uncomparable FROM (SELECT DISTINCT run FROM e) r LEFT JOIN n USING (run) LEFT JOIN m ON m.run = r.run""")
def data_scores(spark, d):
    """Scores of runs: variables by user and slot, some missing, changed or uncapturable."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = _t(spark, d, "events").groupBy(F.col("user_id").alias("run"), F.concat(F.lit("v"), F.col("event_id") % 50).alias("name")).agg(F.max(k).alias("k"))
    value = lambda c: F.parse_json(F.concat(F.lit('{"k": ['), c.cast("string"), F.lit(", null]}"))).alias("value")
    actual = rows.where("k % 11 <> 0").select("run", "name", value(F.when(F.col("k") % 7 == 0, F.col("k") + 1).otherwise(F.col("k"))))
    return N.data_scores(rows.select("run", "name", value(F.col("k"))), actual, rows.where("k % 13 = 0"), mode="exact")[1].withColumn("score", _r(F.col("score")))


# --- knowledge with examples ----------------------------------------------------------------------

_FACTS = """f AS (SELECT 'p' || user_id AS pattern, CASE event_type WHEN 'view' THEN 'evidence' WHEN 'signup' THEN 'evidence' WHEN 'click' THEN 'tie' WHEN 'purchase' THEN 'contradiction' ELSE 'noise' END AS kind, event_id AS "at", (event_id // 100)::INTEGER AS run, value - 20 AS delta,
  CASE WHEN event_id % 3 = 0 THEN ' rule ' || event_type || ' ' ELSE '  ' END AS guidance, CASE WHEN event_id % 4 = 1 THEN 'pkg' || event_id % 7 ELSE '' END AS package, 'src' || json_extract_string(props, '$.k') AS source, 'class' || event_id % 3 AS class FROM events),
b AS (SELECT pattern, MIN("at") AS begins FROM f WHERE kind = 'evidence' AND TRIM(guidance) <> '' GROUP BY 1),
c AS (SELECT f.*, begins, kind = 'evidence' AND delta > 0 AS is_real FROM f JOIN b USING (pattern) WHERE "at" >= begins AND kind <> 'noise'),
x AS (SELECT pattern, SUBSTR(SHA256(source), 1, 8) AS hash, delta, "at" FROM c WHERE is_real),
x1 AS (SELECT pattern, hash, MAX(delta) AS score, ARG_MAX("at", (delta, -"at")) AS "at" FROM x GROUP BY ALL),
x3 AS (SELECT pattern, hash, score, ROW_NUMBER() OVER (PARTITION BY pattern ORDER BY score DESC, "at", hash) AS r FROM x1),
y AS (SELECT pattern, COUNT(*) AS n_edits FROM (SELECT pattern, ROW_NUMBER() OVER (PARTITION BY pattern, class ORDER BY delta DESC) AS r FROM c WHERE is_real) WHERE r <= 5 GROUP BY 1)"""


def _facts(df):
    k, kind = F.col("event_id"), F.expr("CASE event_type WHEN 'view' THEN 'evidence' WHEN 'signup' THEN 'evidence' WHEN 'click' THEN 'tie' WHEN 'purchase' THEN 'contradiction' ELSE 'noise' END")
    return df.select(
        F.concat(F.lit("p"), "user_id").alias("pattern"), kind.alias("kind"), k.alias("at"), F.floor(k / 100).cast("int").alias("run"), F.col("ts").cast("date").alias("day"), (F.col("value") - 20).alias("delta"),
        F.when(k % 3 == 0, F.concat(F.lit(" rule "), "event_type", F.lit(" "))).otherwise("  ").alias("guidance"), F.when(k % 4 == 1, F.concat(F.lit("pkg"), k % 7)).otherwise("").alias("package"), F.lit("script").alias("script"),
        F.concat(F.lit("src"), F.get_json_object("props", "$.k")).alias("source"), F.lit("target").alias("target"), F.concat(F.lit("class"), k % 3).alias("class"), F.lit("old").alias("old"), F.lit("new").alias("new"))


@query(f"""WITH {_FACTS}
SELECT c.pattern, MIN(begins) AS created, ARG_MIN(package, "at") FILTER (kind = 'evidence' AND package <> '') AS package, ARG_MIN(TRIM(guidance), "at") FILTER (kind = 'evidence' AND TRIM(guidance) <> '') AS guidance, COUNT(*) FILTER (kind = 'evidence') AS evidence, COUNT(*) FILTER (is_real) AS real_evidence,
  ROUND(COALESCE(SUM(delta) FILTER (is_real), 0), 4) AS gain, COUNT(*) FILTER (kind = 'tie') AS ties, COUNT(*) FILTER (kind = 'contradiction') AS contradictions, MAX(run) FILTER (kind = 'contradiction') AS contradicted_at,
  (SELECT STRING_AGG(hash, ',' ORDER BY r) FROM x3 WHERE x3.pattern = c.pattern AND r <= 3) AS examples, COALESCE((SELECT n_edits FROM y WHERE y.pattern = c.pattern), 0)::INTEGER AS n_edits
FROM c GROUP BY 1""")
def pattern_state(spark, d):
    """The events as a stream of facts, folded batch by batch into keyed state."""
    folder = f"{shared_folder(spark)}/pattern-state-{uuid.uuid4().hex}"
    table = f"{d}/events.parquet"
    # a pattern, as a stream takes no path of a single file
    facts = _facts(spark.readStream.schema(spark.read.parquet(table).schema).option("maxFilesPerTrigger", 4).parquet(f"{table[:-1]}[t]"))
    P.stream(spark, facts, f"{folder}/state", f"{folder}/seen")
    p = P.patterns(spark, f"{folder}/state")
    return p.select(
        "pattern", "created", "package", "guidance", "evidence", "real_evidence", _r(F.col("gain"), 4).alias("gain"), "ties", "contradictions", "contradicted_at",
        F.nullif(F.array_join(F.transform("examples", lambda e: e.hash), ","), F.lit("")).alias("examples"), F.coalesce(F.size("edits"), F.lit(0)).alias("n_edits"))


@query("""WITH p AS (SELECT DISTINCT lang || CASE doc_id % 5 WHEN 0 THEN '' ELSE '-' || doc_id % 5 END AS id, lang AS base FROM documents WHERE lang <> 'es' OR doc_id % 5 > 0),
k AS (SELECT base, COALESCE(MAX(id) FILTER (id = base), MIN(id)) AS canonical FROM p GROUP BY 1 HAVING COUNT(*) > 1),
e AS (SELECT canonical AS pattern, SUBSTR(SHA256(text), 1, 8) AS hash, n_chars % 97 AS score, id <> canonical AS later, id, doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS calls FROM (SELECT *, lang || CASE doc_id % 5 WHEN 0 THEN '' ELSE '-' || doc_id % 5 END AS id FROM documents) JOIN k ON base = lang JOIN p USING (id)),
o AS (SELECT * FROM e QUALIFY ROW_NUMBER() OVER (PARTITION BY pattern, hash ORDER BY score DESC, later, id, doc_id) = 1),
b AS (SELECT * FROM o QUALIFY ROW_NUMBER() OVER (PARTITION BY pattern ORDER BY score DESC, later, id, doc_id) <= 3)
SELECT pattern, hash, score::DOUBLE AS score, calls = 0 AS defines, ROW_NUMBER() OVER (PARTITION BY pattern ORDER BY calls, score DESC, later, id, doc_id)::INTEGER AS place FROM b""")
def consolidate_examples(spark, d):
    """Patterns lang, lang-1, ... as one, with the best examples of all their documents."""
    docs = _t(spark, d, "documents").withColumn("pattern", F.concat("lang", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("-"), F.col("doc_id") % 5))))
    docs = docs.where("lang <> 'es' or doc_id % 5 > 0")
    target = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("def "), "lang", F.lit("(x): pass"))).otherwise("call(x)")
    examples = docs.select("pattern", *X.example_columns(F.col("text"), target), (F.col("n_chars") % 97).cast("double").alias("score"), "source", F.col("doc_id").alias("at")).toDF("pattern", "hash", "source", "target", "score", "script", "at")
    ids = docs.select(F.col("pattern").alias("id")).distinct().withColumn("ties", F.lit(0))
    none = spark.createDataFrame([], "pattern string, class string, old string, new string, gain double, script string, at long")
    said = spark.createDataFrame([], "pattern string, at long, said string")
    return X.consolidated(ids, examples, none, none.select("pattern"), said)["examples"].select("pattern", "hash", "score", "defines", "place")


@query()
def seed_from_results(spark, d):
    """Documents as entities of their source's script, seeded into a library of the customers' patterns; unit tests hold the rules against a loop."""
    from ..operators.seeding import seeded
    from .catalog import _patterns

    k = F.col("doc_id")
    name = F.regexp_extract("text", r"^\W*(\w+)", 1)
    entities = _t(spark, d, "documents").select(
        F.col("source").alias("script"), F.concat(F.lit("e"), k).alias("entity"), name.alias("name"), F.when(k % 9 == 0, "library_import").otherwise(F.concat(F.lit("s"), k % 5)).alias("kind"),
        F.element_at(F.array(*map(F.lit, ("BUILDING", "MACHINERY", "OTHER"))), (k % 3 + 1).cast("int")).alias("package"), "text", F.when(k % 7 == 0, "pass").otherwise(F.concat(F.lit("def "), name, F.lit("(x): return x"))).alias("target"),
        F.when(k % 4 == 0, 0.9).otherwise(1.0).alias("score"), k.alias("at")).withColumnRenamed("text", "source")
    patterns = _patterns(spark, d).withColumn("id", F.concat(F.lower("package"), F.lit(".s"), F.col("id") % 5, F.lit("-"), "id"))
    none = spark.createDataFrame([], "pattern string, hash string, source string, target string, score double, script string, at long")
    return seeded(entities, patterns, none)["touched"]
