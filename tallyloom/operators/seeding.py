"""Knowledge from translations that worked: an example for the best pattern of each entity, or a new seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import slug
from .evidence import retrieve
from .examples import SOURCE, best_examples, example_columns
from .tables import written
from .windows import allocated_ids


def is_stub(target: Column) -> Column:
    """Whether a text has no line of code but pass, comments and blank lines left out."""
    bare = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    line = lambda s: (bare(s) != "") & ~bare(s).startswith("#") & (bare(s) != "pass") & ~bare(s).startswith("pass  #")
    return ~F.exists(F.split(F.coalesce(target, F.lit("")), "\n"), line)


def seeded(entities: DataFrame, patterns: DataFrame, examples: DataFrame, least: float = 0.95, k: int = 3) -> dict[str, DataFrame]:
    """What good translations of one batch add to a library.

    ``entities``: script, entity, name, kind, package, source, target, score, at (the order of all). ``patterns``: id, package, guidance, confidence,
    seed, real_evidence. ``examples``: as ``best_examples`` takes them. Imports, scores under ``least``, entities without source and stubs
    are left out. Of entities of one name in a script the definer stands for all, else the first. Each is an example of the first of
    its ``k`` retrieved patterns that has its package, or of a new seed, named after package and name, with a number where the
    name is taken. The batch sees the library as it was: a new seed is retrieved from the next batch on.

    Gives ``touched`` (script, entity, pattern, created), ``seeds`` (patterns to add) and ``examples`` (the best of old and new ones).
    """
    package = F.coalesce("package", F.lit(""))
    good = entities.where((F.col("kind") != "library_import") & (F.col("score") >= least) & (F.coalesce("source", F.lit("")) != "") & ~is_stub(F.col("target")))
    good = good.withColumns({"package": package, "name": F.coalesce(F.nullif("name", F.lit("")), "entity"), "source": F.substring("source", 1, SOURCE)})
    chosen = _one_a_name(good)
    found = retrieve(chosen.select(F.col("at").alias("query"), "package", "kind", F.col("name").alias("text")), patterns, k)
    own = chosen.select(F.col("at").alias("query"), "package").join(found, "query").join(patterns.select("id", F.coalesce("package", F.lit("")).alias("package")), ["id", "package"])
    matched = own.groupBy(F.col("query").alias("at")).agg(F.min_by("id", "rank").alias("pattern"))
    chosen = written(chosen.join(matched, "at", "left"), "seeding")
    raw = F.when(F.col("package") == "", F.col("name")).otherwise(F.concat_ws(".", "package", "name"))
    fresh = chosen.where("pattern is null").withColumn("base", slug(raw)).select("at", "base")
    named = allocated_ids(fresh, patterns.select("id"), "base", ["at"]).select("at", F.col("id").alias("fresh"))
    placed = written(chosen.join(named, "at", "left").withColumns({"created": F.col("pattern").isNull(), "pattern": F.coalesce("pattern", "fresh")}), "seeded")
    shown = F.when(F.col("package") == "", "base R").otherwise(F.col("package"))
    guidance = F.concat(F.lit("Translate R `"), "name", F.lit("` ("), "kind", F.lit(" from "), shown, F.lit(") to Python. See verified example below — prefer it over guessing from the R source alone."))
    new = placed.select("pattern", *example_columns(F.col("source"), F.col("target")), "score", "script", "at")
    return {
        "touched": placed.select("script", "entity", "pattern", "created"),
        "seeds": placed.where("created").select(F.col("pattern").alias("id"), "package", guidance.alias("guidance"), F.lit("tentative").alias("confidence"), F.lit(True).alias("seed"), F.lit(0).alias("real_evidence")),
        "examples": best_examples(examples.select(*new.columns).unionByName(new)),
    }


def _one_a_name(rows: DataFrame) -> DataFrame:
    plain = F.replace(F.replace("name", F.lit("::"), F.lit(".")), F.lit("."), F.lit("_"))
    defines = F.contains("target", F.concat(F.lit("def "), plain, F.lit("(")))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("script", "name").orderBy(defines.desc(), "at"))).where("_n = 1").drop("_n")
