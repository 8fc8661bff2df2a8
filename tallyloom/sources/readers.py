"""Readers of scripts, logs, manifests and Markdown stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_scripts(spark: SparkSession, path: str, glob: str = "*.R", recursive: bool = True) -> DataFrame:
    """path and text of whole files."""
    return spark.read.format("text").option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor comments, stripped."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("entry")).where("entry <> '' and not startswith(entry, '#')")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines. Tolerant: lines that don't parse go; strict: they fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_scores(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """A CSV with a header, the last row of each key."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row")).select(key, "row.*")


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("hash"), "length")


def code_chunks(df: DataFrame, text: str = "text", language: str = "r") -> DataFrame:
    """``df`` with one row for each fenced chunk of a language: chunk_no and chunk."""
    found = F.regexp_extract_all(F.col(text), F.lit(rf"(?s)```\{{{language}[^}}]*\}}\s*\n(.*?)```"), F.lit(1))
    return df.select("*", F.posexplode(found).alias("chunk_no", "chunk"))


def html_blocks(df: DataFrame, html: str, tag: str) -> DataFrame:
    """``df`` with one row for each block of a tag: block_no and block, entities of markup resolved."""
    block = F.regexp_extract_all(F.col(html), F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    plain = F.transform(block, lambda b: F.replace(F.replace(F.replace(F.replace(b, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")))
    return df.select("*", F.posexplode(plain).alias("block_no", "block"))


def parse_patterns(df: DataFrame, text: str = "text") -> DataFrame:
    """Markdown with front matter as columns: id, package, confidence (tentative unless known), seed, guidance, evidence lines."""
    field = lambda name: F.regexp_extract(F.col(text), rf"(?m)^{name}:\s*(.*?)\s*$", 1)
    section = lambda name: F.regexp_replace(F.regexp_extract(F.col(text), rf"(?s)## {name}[ \t]*\n(.*?)(?=\n## |\z)", 1), r"^\s+|\s+$", "")
    confidence = F.when(field("confidence").isin("confirmed", "tentative", "contradicted"), field("confidence")).otherwise("tentative")
    evidence = F.regexp_extract_all(section("Evidence"), F.lit(r"(?m)^- (.*)$"), F.lit(1))
    return df.select(field("id").alias("id"), field("package").alias("package"), confidence.alias("confidence"), (field("seed") == "true").alias("seed"), section("Guidance").alias("guidance"), evidence.alias("evidence")).where("id <> ''")


def symbol_lines(df: DataFrame, text: str, symbol: str) -> DataFrame:
    """``df`` with line: the first, from 1, at which its text begins to define a function ``symbol``; null if none does."""
    starts = [f"{symbol}{between}function" for between in (" <- ", "<-", " = ", "=")]
    is_start = lambda x: F.array_contains(F.transform(F.array(*[F.lit(s) for s in starts]), lambda s: x.startswith(s)), True)
    at = F.array_position(F.transform(F.split(text, "\n"), is_start), True)
    return df.withColumn("line", F.nullif(at, F.lit(0)).cast("int"))


def sampled_snapshot(spark: SparkSession, path: str, most: int = 2000, head: int = 4096) -> DataFrame:
    """path and sha256 of the first ``head`` bytes of the first ``most`` files below a folder, by path: a quick look, not a comparison."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2(F.substring("content", 1, head), 256).alias("hash")).orderBy("path").limit(most)


def store_get(ids: DataFrame, flat: DataFrame, nested: DataFrame) -> DataFrame:
    """Rows (id, ...) of ``flat`` for the ids, and those of ``nested`` for ids that it lacks; ids in neither are left out."""
    first = flat.join(ids.select("id").distinct(), "id", "left_semi").withColumn("tier", F.lit(0))
    rest = ids.select("id").distinct().join(flat.select("id"), "id", "left_anti")
    return first.unionByName(nested.join(rest, "id", "left_semi").withColumn("tier", F.lit(1)))
