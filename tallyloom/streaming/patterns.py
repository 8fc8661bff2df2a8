"""Knowledge as keyed state of a stream of facts, with its best examples.

A batch is folded before it meets the state, so a pattern with very many facts costs a partial sum a task. The state is three tables (counts,
examples, edits) in buckets by pattern; a batch reads the newest version of the buckets that it touches and writes those
alone. A batch that is run again, after a failure or a restart, finds the same older versions and writes its own anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.examples import EDIT, best_edits, best_examples, example_columns
from ..operators.tables import written

BUCKETS = 64
FACTS = (
    "pattern string, kind string, at long, run int, day date, delta double, guidance string, package string, script string, "
    "source string, target string, class string, old string, new string"
)
_TABLES = {
    "counts": "pattern string, created long, package struct<at:long,value:string>, guidance string, evidence long, real_evidence long, gain double, ties long, contradictions long, contradicted_at int, reviewed date",
    "examples": "pattern string, hash string, source string, target string, score double, script string, at long",
    "edits": "pattern string, class string, old string, new string, gain double, script string, at long",
}


def fold(facts: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
    """counts, examples and edits of facts (FACTS); ``known``: the patterns that are there before.

    kind is evidence, tie or contradiction. A pattern that isn't known begins, tentative, with its first evidence whose guidance isn't blank (``at``
    orders the facts and is unique in a pattern); its facts before that are lost, as are facts without a pattern.
    Evidence with a gain over 0 is real; if it has source and target it is an example, if it has class, old and new an edit. The
    package is the first that isn't empty; contradicted_at the last run that contradicted, reviewed the last day of any fact.
    """
    filled = lambda *c: F.lit(True) if not c else (F.coalesce(F.col(c[0]), F.lit("")) != "") & filled(*c[1:])
    kind = lambda k: F.col("kind") == k
    says = kind("evidence") & (F.trim(F.coalesce("guidance", F.lit(""))) != "")
    named = facts.where(filled("pattern") & F.col("kind").isin("evidence", "tie", "contradiction"))
    begins = named.groupBy("pattern").agg(F.min(F.when(says, F.col("at"))).alias("begins"))
    begins = begins.join(known.select("pattern", F.lit(True).alias("known")), "pattern", "left").where("known or begins is not null")
    counted = written(named.join(begins, "pattern").where("known or at >= begins"), "facts")
    n = lambda c: F.count(F.when(c, 1))
    real = kind("evidence") & (F.col("delta") > 0)
    counts = counted.groupBy("pattern").agg(
        F.min(F.when(F.col("known").isNull(), F.col("begins"))).alias("created"), F.min(F.when(kind("evidence") & filled("package"), F.struct("at", F.col("package").alias("value")))).alias("package"),
        F.min_by(F.trim("guidance"), F.when(says, F.col("at"))).alias("guidance"), n(kind("evidence")).alias("evidence"), n(real).alias("real_evidence"),
        F.coalesce(F.sum(F.when(real, F.col("delta"))), F.lit(0.0)).alias("gain"), n(kind("tie")).alias("ties"), n(kind("contradiction")).alias("contradictions"),
        F.max(F.when(kind("contradiction"), F.col("run"))).alias("contradicted_at"), F.max("day").alias("reviewed"))
    cut = lambda c: F.substring(c, 1, EDIT).alias(c)
    examples = counted.where(real & filled("source", "target")).select("pattern", *example_columns(F.col("source"), F.col("target")), F.col("delta").alias("score"), "script", "at")
    edits = counted.where(real & filled("class", "old", "new")).select("pattern", "class", cut("old"), cut("new"), F.col("delta").alias("gain"), "script", "at")
    return {"counts": counts, "examples": best_examples(examples), "edits": best_edits(edits)}


def merge(name: str, old: DataFrame, new: DataFrame) -> DataFrame:
    """What the facts of both have given for one of the tables."""
    both = old.unionByName(new)
    if name != "counts":
        return best_examples(both) if name == "examples" else best_edits(both)
    add = [F.sum(c).alias(c) for c in ("evidence", "real_evidence", "gain", "ties", "contradictions")]
    return both.groupBy("pattern").agg(
        F.min("created").alias("created"), F.min("package").alias("package"), F.min_by("guidance", "created").alias("guidance"), *add, F.max("contradicted_at").alias("contradicted_at"), F.max("reviewed").alias("reviewed")
    ).select(*old.columns)


def _bucket():
    return F.pmod(F.xxhash64("pattern"), F.lit(BUCKETS)).cast("int")


def current(spark: SparkSession, state: str, name: str, before: int | None = None, touched: DataFrame | None = None) -> DataFrame:
    """The newest version of each bucket of a table, older than ``before``, of the ``touched`` buckets (bucket) only."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _TABLES[name])
    rows = spark.read.schema(f"{_TABLES[name]}, version int, bucket int").parquet(f"{state}/{name}")
    rows = rows if before is None else rows.where(F.col("version") < before)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    newest = newest if touched is None else newest.join(F.broadcast(touched), "bucket", "left_semi")
    return rows.join(F.broadcast(newest), ["bucket", "version"], "left_semi").drop("bucket", "version")  # BUCKETS rows at most


def apply(spark: SparkSession, facts: DataFrame, state: str, version: int) -> None:
    """Fold a batch into the state as version ``version`` of the buckets that it touches."""
    facts = written(facts, "batch")
    touched = facts.where("pattern <> ''").select(_bucket().alias("bucket")).distinct()
    known = current(spark, state, "counts", version, touched)
    for name, new in fold(facts, known).items():
        merged = merge(name, current(spark, state, name, version, touched), new).withColumn("bucket", _bucket())
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/{name}/version={version}")


def stream(spark: SparkSession, facts: DataFrame, state: str, checkpoint: str) -> None:
    """Fold all of a streaming ``facts`` that the checkpoint hasn't seen into ``state``, batch by batch, and return."""
    query = facts.writeStream.foreachBatch(lambda batch, number: apply(batch.sparkSession, batch, state, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def patterns(spark: SparkSession, state: str) -> DataFrame:
    """The patterns of the state, with their examples (best first) and edits (by class, best first) as lists."""
    counts, examples, edits = (current(spark, state, name) for name in _TABLES)
    ordered = lambda x: F.transform(F.array_sort(F.collect_list(x)), lambda s: s["x"])
    fields = [F.struct(*[c.split()[0] for c in _TABLES[t].split(", ")[1:]]).alias("x") for t in ("examples", "edits")]
    examples = examples.groupBy("pattern").agg(ordered(F.struct((-F.col("score")).alias("a"), "at", fields[0])).alias("examples"))
    edits = edits.groupBy("pattern").agg(ordered(F.struct("class", (-F.col("gain")).alias("a"), "at", fields[1])).alias("edits"))
    return counts.withColumn("package", F.col("package.value")).join(examples, "pattern", "left").join(edits, "pattern", "left")
