"""The evidence fold as a stream: facts come as files, each batch is merged into a keyed state table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fold(facts: DataFrame, key: str = "key") -> DataFrame:
    """Facts (key, kind, delta) as counts of evidence, real evidence, ties and contradictions."""
    n = lambda cond: F.count(F.when(cond, 1))
    kind, delta = F.col("kind"), F.col("delta")
    return facts.groupBy(key).agg(n(kind == "evidence").alias("evidence"), n((kind == "evidence") & (delta > 0)).alias("real_evidence"), n(kind == "tie").alias("ties"), n(kind == "contradiction").alias("contradictions"))


def merge(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """The fold of the facts of both."""
    return a.unionByName(b).groupBy(key).agg(*[F.sum(c).alias(c) for c in ("evidence", "real_evidence", "ties", "contradictions")])


def stream_fold(spark: SparkSession, source: str, schema: str, state: str, checkpoint: str) -> None:
    """Fold all files of ``source`` that the checkpoint hasn't seen into versions of ``state``; a batch that is run again writes its version anew."""

    def batch(facts: DataFrame, number: int) -> None:
        new = fold(facts)
        if number:
            new = merge(new, spark.read.parquet(f"{state}/version={number - 1}"))
        new.write.mode("overwrite").parquet(f"{state}/version={number}")

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by type and tumbling window; events over ``late`` behind the newest are dropped on a stream."""
    w = F.window(F.col("ts").cast("timestamp"), width)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total") if w is not None else events
