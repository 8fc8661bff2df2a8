"""Sinks: append, upsert, content store, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import upsert


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def upsert_parquet(rows: DataFrame, path: str, new_path: str, keys: list[str], order: str) -> None:
    """The table at ``path`` with new rows in place of old ones, as a new table: readers of the old one aren't disturbed."""
    upsert(rows.sparkSession.read.parquet(path), rows, keys, order).write.parquet(new_path)


def write_new_content(df: DataFrame, path: str, text: str, known: DataFrame) -> None:
    """Content that the store at ``path`` doesn't have yet, under its hash."""
    new = df.where(F.trim(text) != "").withColumn("hash", F.sha2(text, 256)).dropDuplicates(["hash"]).join(known.select("hash"), "hash", "left_anti")
    new.write.mode("append").parquet(path)


def pattern_markdown(df: DataFrame) -> DataFrame:
    """Knowledge rows as Markdown texts with front matter."""
    lines = F.concat(F.lit("---\nid: "), "id", F.lit("\npackage: "), "package", F.lit("\nconfidence: "), "confidence", F.lit("\nseed: "), F.col("seed").cast("string"), F.lit("\n---\n\n## Guidance\n"), "guidance", F.lit("\n\n## Evidence\n"), F.array_join(F.transform("evidence", lambda e: F.concat(F.lit("- "), e)), "\n"))
    return df.select("id", lines.alias("text"))


def annotated(lines: DataFrame, marks: DataFrame, group: str) -> DataFrame:
    """Source lines with a mark inserted after each marked line, numbered anew by place."""
    out = lines.select(group, F.col("line").cast("double").alias("place"), "text").unionByName(marks.select(group, (F.col("line") + 0.5).alias("place"), F.concat(F.lit("# @"), "mark").alias("text")))
    return out.orderBy(group, "place")
