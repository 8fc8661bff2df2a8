"""Knowledge as a folder of Markdown files: one file a pattern, read and written as columns."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: The levels of confidence, and the fields of both kinds of examples in files.
CONFIDENCE = ("tentative", "confirmed", "contradicted")
EXAMPLE = "r_hash string, r_snippet string, py_snippet string, score double, script_id string"
EDIT = "failure_class string, old_code string, new_code string, score_delta double, script_id string"
EVIDENCE = "script_id string, score double, verification_path string, variable string"
_EVIDENCE_LINE = r"^-\s+(.+?)\s+→\s+score\s+([\d.]+)\s+\(path:\s*([^,]+),\s*variable:\s*(.+?)\)\s*$"
_FRONT = r"(?s)\A---\s*\n(.*?)\n---\s*\n(.*)\z"
_NEWLINE = r"\r\n|\r|\n"


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def parsed(texts: DataFrame) -> DataFrame:
    """Patterns of whole files (path, text), one for each id: of files with one id that of the last path.

    A file without front matter, or with a score that is no number, is skipped. Of fields and sections that repeat the last counts;
    an unknown confidence is tentative, a tie count that is no number 0; lines of evidence that don't fit are left out, those
    of the path ``tie``, an old form, are added to the tie count instead; examples that are no JSON objects are left out.
    """
    df = texts.where(F.col("text").rlike(_FRONT))
    lines = F.filter(F.transform(F.split(F.regexp_extract("text", _FRONT, 1), _NEWLINE), _strip), lambda s: (s != "") & ~s.startswith("#") & s.contains(":"))
    named = F.transform(lines, lambda s: F.struct(_strip(F.substring_index(s, ":", 1)).alias("k"), _strip(F.regexp_extract(s, r"^[^:]*:(.*)$", 1)).alias("v")))
    parts = F.slice(F.split(F.concat(F.lit("\n"), F.regexp_extract("text", _FRONT, 2)), "(?:" + _NEWLINE + ")## "), 2, 1 << 30)
    sections = F.transform(parts, lambda p: F.struct(_strip(F.element_at(F.split(p, _NEWLINE, 2), 1)).alias("k"), F.coalesce(F.try_element_at(F.split(p, _NEWLINE, 2), F.lit(2)), F.lit("")).alias("v")))
    df = df.select("path", named.alias("fields"), sections.alias("sections"))
    last = lambda items, name: F.coalesce(F.try_element_at(F.filter(items, lambda x: x.k == name), F.lit(-1)).v, F.lit(""))
    field, section = (lambda n: last(F.col("fields"), n)), (lambda n: last(F.col("sections"), n))
    rows = lambda n: F.filter(F.transform(F.split(section(n), _NEWLINE), _strip), lambda s: (s != "") & (s != "(none)"))
    bullet = lambda s: F.when(s.startswith("- "), F.substring(s, 3, 1 << 30)).otherwise(s)
    part = lambda s, n: F.regexp_extract(s, _EVIDENCE_LINE, n)
    entry = lambda s: F.struct(part(s, 1).alias("script_id"), part(s, 2).alias("score"), _strip(part(s, 3)).alias("verification_path"), _strip(part(s, 4)).alias("variable"))
    df = df.withColumn("said", F.transform(F.filter(rows("Evidence"), lambda s: s.rlike(_EVIDENCE_LINE)), entry))
    df = df.where(~F.exists("said", lambda e: ~e.score.rlike(r"^(\d+\.?\d*|\.\d+)$")))
    tied = F.size(F.filter("said", lambda e: e.verification_path == "tie"))
    filled = lambda x, schema: F.struct(*[F.coalesce(x[c.split()[0]], F.lit(0.0 if c.endswith("double") else "")).alias(c.split()[0]) for c in schema.split(", ")])
    json = lambda n: F.filter(F.transform(rows(n), bullet), lambda s: F.coalesce(F.schema_of_variant(F.try_parse_json(s)).startswith("OBJECT<"), F.lit(False)))
    example = lambda n, schema: F.transform(json(n), lambda s: filled(F.from_json(s, schema), schema))
    out = df.select(
        "path", field("id").alias("id"), field("package").alias("package"), F.when(field("confidence").isin(*CONFIDENCE), field("confidence")).otherwise("tentative").alias("confidence"), (F.lower(field("seed")) == "true").alias("seed"),
        field("created").alias("created"), field("last_review").alias("last_review"), (F.coalesce(F.when(field("tie_count").rlike(r"^[+-]?\d{1,18}$"), field("tie_count").cast("long")), F.lit(0)) + tied).alias("tie_count"), _strip(section("Guidance")).alias("guidance"),
        F.transform(F.filter("said", lambda e: e.verification_path != "tie"), lambda e: e.withField("score", e.score.cast("double"))).alias("evidence"),
        F.transform(rows("Contradictions"), bullet).alias("contradictions"), example("Translation Examples", EXAMPLE).alias("examples"), example("Edit Examples", EDIT).alias("edits"))
    order = Window.partitionBy("id").orderBy(F.desc("path"))
    return out.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "path")


def formatted(patterns: DataFrame) -> DataFrame:
    """name (the id) and text of the file of each pattern; ``parsed`` reads it back. Dates that are missing are today's."""
    today = F.date_format(F.current_date(), "yyyy-MM-dd")
    date = lambda c: F.coalesce(F.nullif(c, F.lit("")), today)
    head = [("id", F.col("id")), ("package", F.col("package")), ("confidence", F.col("confidence")), ("seed", F.col("seed").cast("string")), ("created", date("created")), ("last_review", date("last_review")), ("tie_count", F.col("tie_count").cast("string"))]
    front = F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit(""))) for k, v in head], F.lit("---"))
    listed = lambda items: F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda s: F.concat(F.lit("- "), s)), "\n")).otherwise("(none)")
    evidence = F.transform("evidence", lambda e: F.format_string("%s → score %.3f (path: %s, variable: %s)", e.script_id, e.score, e.verification_path, e.variable))
    short = lambda items, f: F.transform(items, lambda x: F.to_json(x.withField(f, F.round(x[f], 4))))
    sections = {"Guidance": _strip(F.col("guidance")), "Evidence": listed(evidence), "Contradictions": listed(F.col("contradictions")), "Translation Examples": listed(short("examples", "score")), "Edit Examples": listed(short("edits", "score_delta"))}
    body = [F.concat(F.lit(f"\n## {k}\n"), F.coalesce(v, F.lit(""))) for k, v in sections.items()]
    return patterns.select(F.col("id").alias("name"), F.concat(F.concat_ws("\n", front, F.lit(""), F.concat(F.lit("# "), "id"), *body), F.lit("\n")).alias("text"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The patterns of all .md files below a folder, by Spark's own reader."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return parsed(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def write_store(patterns: DataFrame, path: str) -> None:
    """One file <id>.md for each pattern in a folder that all executors see; files of other patterns stay."""
    patterns.sparkSession.dataSource.register(NamedTexts)
    formatted(patterns).write.format("named_texts").mode("append").option("path", path).option("ending", ".md").save()


class _Files(InputPartition):
    def __init__(self, paths):
        self.paths = paths


class _Written(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class NamedTexts(DataSource):
    """Rows (name, text) as files name + ``ending`` in the folder ``path``; files that are moved to their names when all tasks are done."""

    @classmethod
    def name(cls):
        return "named_texts"

    def schema(self):
        return "name string, text string"

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.ending, self.per = options["path"], options.get("ending", ".md"), int(options.get("files", "100"))

    def partitions(self):
        found = sorted(os.path.join(d, f) for d, _, files in os.walk(self.path) for f in files if f.endswith(self.ending))
        return [_Files(found[i : i + self.per]) for i in range(0, len(found), self.per)]

    def read(self, partition):
        for p in partition.paths:
            with open(p, encoding="utf-8", errors="replace") as f:
                yield os.path.basename(p)[: -len(self.ending)], f.read()


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.path, self.ending, self.job = options["path"], options.get("ending", ".md"), uuid.uuid4().hex

    def write(self, iterator):
        os.makedirs(self.path, exist_ok=True)
        files = []
        for name, text in iterator:
            if not name or "/" in name or name.startswith("."):
                raise ValueError(f"no name of a file: {name!r}")
            waiting = os.path.join(self.path, f".{name}.{uuid.uuid4().hex}")
            with open(waiting, "w", encoding="utf-8") as f:
                f.write(text)
            files.append((waiting, os.path.join(self.path, name + self.ending)))
        return _Written(files)

    def commit(self, messages):
        for m in messages:
            for waiting, final in m.files if m else []:
                os.replace(waiting, final)

    def abort(self, messages):
        for m in messages:
            for waiting, _ in m.files if m else []:
                os.unlink(waiting)
