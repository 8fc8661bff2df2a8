"""What runs left in their folders: one scan of all files, each read by the rules of its kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import decoded_state

#: Fixed value: pictures under so many bytes are blank pages of a device that was opened and closed.
LEAST_PICTURE = 2000
#: Fixed value: the line with which a run prints that it reads its script.
ECHO = r"(?m)^> source\(\".*\",\s*print\.eval\s*=\s*TRUE\)\s*$"
#: The file of each kind that holds JSON, after the prefix, and what the JSON must be.
JSON_FILES = {"state": "OBJECT", "uncapturable": "ARRAY", "env": "OBJECT", "html": "OBJECT", "network": "ARRAY", "rng": "ARRAY", "warnings": "ARRAY"}


def _text(content: Column) -> Column:
    """UTF-8 with what is no character replaced."""
    return F.make_valid_utf8(content.cast("string"))


def collect_effects(spark: SparkSession, folder: str, before: DataFrame | None = None, prefix: str = "run_") -> DataFrame:
    """One row for each run, a folder below ``folder``, with all that its files show.

    Files named prefix + kind + .json: data (a map of names to JSON texts, values that hold JSON as a text decoded once more), uncapturable,
    env, html (the object's values by key), network, rng and warnings (lists of JSON texts; of network and rng only entries that are lists).
    prefix + plot_*.png: graphics (name, size, sha256), by name, those of LEAST_PICTURE bytes at least. stdout.txt and stderr.txt: texts, bytes that are no UTF-8
    replaced, stdout without the ECHO of the script and blank lines in front. Files below prefix + tempfiles/ count as written files tempfile:name; all others without
    the prefix are written files if ``before`` (run, path, hash) doesn't have them with the same hash: files is a map of paths to sha256.

    Spark lists no files whose names begin with _ or ., and no empty ones. A file that is missing, or isn't what its kind asks for, is empty; ``problems`` (file, reason) says which ones were broken.
    """
    all_files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    rest = F.substring_index("path", f"{base}/", -1)
    files = all_files.select(F.substring_index(rest, "/", 1).alias("run"), F.regexp_extract(rest, "^[^/]*/(.*)$", 1).alias("name"), "content", F.col("length").alias("size")).where("name <> ''")
    kind = F.regexp_extract("name", f"^{prefix}([a-z]+)\\.json$", 1)
    kind = (
        F.when(kind.isin(*JSON_FILES), kind).when(F.col("name").rlike(f"^{prefix}plot_[^/]*\\.png$"), "graphics").when(F.col("name").startswith(f"{prefix}tempfiles/"), "temp")
        .when(F.col("name").startswith(prefix), "other").when(F.col("name").isin("stdout.txt", "stderr.txt"), F.substring_index("name", ".", 1)).otherwise("file")
    )
    files = files.withColumns({"kind": kind, "hash": F.sha2("content", 256)})
    text = F.when(F.col("kind").isin(*JSON_FILES, "stdout", "stderr"), _text(F.col("content")))
    files = files.withColumn("text", text).withColumn("json", F.when(F.col("kind").isin(*JSON_FILES), F.try_parse_json("text")))
    wanted = F.create_map(*[F.lit(x) for pair in JSON_FILES.items() for x in pair])[F.col("kind")]
    # A text without a JSON value parses to a null in it; so does a bare null, which is no object or list either.
    reason = F.when(F.col("kind").isin(*JSON_FILES), F.when(F.col("json").isNull(), "corrupt").when(~F.schema_of_variant("json").startswith(wanted), F.concat(F.lit("no "), F.lower(wanted))))
    files = files.withColumn("reason", reason)
    of = lambda k: (F.col("kind") == k) & F.col("reason").isNull()
    one = lambda k, x: F.max(F.when(of(k), x))
    raw = lambda k: F.first(F.when(of(k), F.col("text")), ignorenulls=True).alias(k)
    by_name = lambda k, x: F.array_sort(F.collect_list(F.when(of(k), x)))
    runs = files.groupBy("run").agg(
        *[raw(k) for k in (*JSON_FILES, "stdout", "stderr")], by_name("graphics", F.when(F.col("size") >= LEAST_PICTURE, F.struct("name", "size", F.col("hash").alias("sha256")))).alias("graphics"),
        F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct(F.col("name").alias("file"), "reason")))).alias("problems"), one("temp", F.lit(1)).alias("any"))
    written = files.where("kind in ('file', 'temp')").select("run", F.when(F.col("kind") == "temp", F.concat(F.lit("tempfile:"), F.substring_index("name", "/", -1))).otherwise(F.col("name")).alias("path"), "hash")
    if before is not None:
        written = written.join(before.select("run", "path", "hash"), ["run", "path", "hash"], "left_anti")
    # Two temporary files of one name: the last by hash counts, as one of them must.
    written = written.groupBy("run", "path").agg(F.max("hash").alias("hash")).groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "hash")))).alias("files"))
    items = lambda k: F.coalesce(F.try_variant_get(F.try_parse_json(k), "$", "array<variant>"), F.array().cast("array<variant>"))
    is_list = lambda v: F.schema_of_variant(v).startswith("ARRAY")
    shown = lambda v: F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.to_json(v))
    objects = lambda k: F.coalesce(F.try_variant_get(F.try_parse_json(k), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    nothing = F.create_map().cast("map<string,string>")
    return runs.join(written, "run", "left").select(
        "run", F.when(F.col("state").isNotNull(), decoded_state(F.col("state"))).otherwise(nothing).alias("data"), F.transform(items("uncapturable"), shown).alias("uncapturable"),
        F.transform_values(objects("env"), lambda k, v: shown(v)).alias("env"), F.transform(F.array_sort(F.map_keys(objects("html"))), lambda k: shown(objects("html")[k])).alias("html"),
        F.transform(F.filter(items("network"), is_list), lambda v: F.to_json(v)).alias("network"), F.transform(F.filter(items("rng"), is_list), lambda v: F.to_json(v)).alias("rng"), F.transform(items("warnings"), shown).alias("warnings"),
        "graphics", F.regexp_replace(F.regexp_replace(F.coalesce("stdout", F.lit("")), ECHO, ""), r"\A\n+", "").alias("stdout"), F.coalesce("stderr", F.lit("")).alias("stderr"), F.coalesce("files", nothing).alias("files"), "problems")
