"""Knowledge rows with evidence: retrieval, review rules, consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compare import jaccard, tokens
from ..functions.scalar import recency


def demotion_threshold(seed: Column, real: Column) -> Column:
    """Contradictions that demote: three quarters of the real evidence, 3 at least; without any 5 for seeds and 1 for others."""
    return F.when(real > 0, F.greatest(F.lit(3), F.ceil(0.75 * real).cast("int"))).otherwise(F.when(seed, 5).otherwise(1))


def review(patterns: DataFrame) -> DataFrame:
    """One promotion (tentative with two real pieces of evidence), then at most one demotion, on what the promotion left."""
    promoted = F.when((F.col("confidence") == "tentative") & (F.col("real_evidence") >= 2), "confirmed").otherwise(F.col("confidence"))
    limit = demotion_threshold(F.col("seed"), F.col("real_evidence"))
    step = F.when(F.col("after") == "confirmed", "tentative").when(F.col("after") == "tentative", "contradicted").otherwise(F.col("after"))
    return patterns.withColumn("after", promoted).withColumn("after", F.when(F.col("contradictions") >= limit, step).otherwise(F.col("after")))


def conflicts(patterns: DataFrame) -> DataFrame:
    """Pairs of confirmed patterns of one package and shape whose guidance differs beyond case and white space.

    Guidance is grouped first, so a group of equal patterns gives one representative; each is paired with the least guidance of its
    package and shape (class representatives): a class of n different texts gives n - 1 rows, from which all its pairs follow.
    """
    plain = F.trim(F.regexp_replace(F.lower("guidance"), r"\s+", " "))
    own = patterns.where((F.col("confidence") == "confirmed") & (F.col("shape") != "")).groupBy("package", "shape", plain.alias("said")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    least = F.min(F.struct("said", "id", "n")).over(Window.partitionBy("package", "shape"))
    paired = own.withColumn("first", least).where("said <> first.said")
    return paired.select("package", "shape", F.least("id", "first.id").alias("id_a"), F.greatest("id", "first.id").alias("id_b"), (F.col("n") * F.col("first.n")).alias("n_pairs"))


def demoted_by_conflict(patterns: DataFrame) -> DataFrame:
    """id of each confirmed pattern whose package and shape have other guidance: it becomes tentative."""
    plain = F.trim(F.regexp_replace(F.lower("guidance"), r"\s+", " "))
    own = patterns.where((F.col("confidence") == "confirmed") & (F.col("shape") != "")).select("id", "package", "shape", plain.alias("said"))
    differ = own.groupBy("package", "shape").agg(F.min("said").alias("a"), F.max("said").alias("b")).where("a <> b")
    return own.join(differ.select("package", "shape"), ["package", "shape"], "left_semi").select("id", F.lit("tentative").alias("after"))


def conflict_notes(patterns: DataFrame) -> DataFrame:
    """A tentative pattern without a package for each pair that ``conflicts`` gives, which asks for a review of both."""
    tick = lambda c: F.concat(F.lit("`"), F.col(c).cast("string"), F.lit("`"))
    said = F.concat(F.lit("Conflict detected between "), tick("id_a"), F.lit(" and "), tick("id_b"), F.lit(". Both have been demoted to tentative. Human review required."))
    name = F.concat(F.lit("conflict_"), F.col("id_a").cast("string"), F.lit("_vs_"), F.col("id_b").cast("string"))
    return conflicts(patterns).select(name.alias("id"), F.lit("").alias("package"), F.lit("tentative").alias("confidence"), F.lit(False).alias("seed"), said.alias("guidance"))


def archived(patterns: DataFrame, run: int) -> DataFrame:
    """stale: contradicted 30 runs ago or more; unimproved: no seed, no real evidence, 100 ties and contradictions or more."""
    stale = (F.col("confidence") == "contradicted") & (F.lit(run) - F.col("contradicted_at") >= 30)
    idle = ~F.col("seed") & (F.col("confidence") != "contradicted") & (F.col("real_evidence") == 0) & (F.col("ties") + F.col("contradictions") >= 100)
    return patterns.withColumn("archive", F.when(stale, "stale").when(idle, "unimproved")).where("archive is not null")


def consolidate(patterns: DataFrame) -> DataFrame:
    """Patterns named base-1, base-2, ... and base as one: the base if it exists, else the first by name; ties and evidence added up."""
    base = F.regexp_extract("id", r"^(.+?)-(\d+)$", 1)
    named = patterns.withColumn("base", F.when(base == "", F.col("id")).otherwise(base))
    canonical = F.coalesce(F.max(F.when(F.col("id") == F.col("base"), F.col("id"))), F.min("id"))
    return named.groupBy("base").agg(canonical.alias("canonical"), F.count(F.lit(1)).alias("n_merged"), F.sum("ties").alias("ties"), F.sum("evidence").alias("evidence")).where("n_merged > 1")


def index_by_key(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("package", "shape").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def retrieve(queries: DataFrame, patterns: DataFrame, k: int, no_seeds: bool = False, blocks: int = 64) -> DataFrame:
    """The k best admitted patterns of each query (query, package, kind, text).

    Candidates are the patterns of the query's package, or all if it has none or no pattern at all, admitted or not, is of it.
    Admitted: not contradicted, and a seed, confirmed, or with two real pieces of evidence. Order: patterns of just the query's
    package first (tier 0), then the token overlap of kind and id, then that of text and guidance, then id.

    Only tokens that both sides have, and how many there are, bear on a score. Queries that are alike in these are asked as one, and of
    patterns that are alike the k first by id are candidates, so what meets is classes, which don't grow with copies. Classes
    for all patterns meet them in ``blocks`` by id, each of which hands on its k best.
    """
    good = patterns.where((F.col("confidence") != "contradicted") & (F.col("seed") | (F.col("confidence") == "confirmed") | (F.col("real_evidence") >= 2)))
    good = good.where(~F.col("seed")) if no_seeds else good
    good = good.select("id", F.coalesce("package", F.lit("")).alias("p"), tokens(F.col("id").cast("string")).alias("i"), tokens(F.col("guidance")).alias("g"))
    known = patterns.select(F.coalesce("package", F.lit("")).alias("package"), F.lit(True).alias("known")).distinct().where("package <> ''")
    asked = queries.select("query", F.coalesce("package", F.lit("")).alias("package"), tokens(F.col("kind")).alias("k"), tokens(F.col("text")).alias("t")).join(known, "package", "left")
    reach = F.when(F.col("known"), "own").when(F.col("package") == "", "bare").otherwise("all")
    asked = asked.withColumns({"reach": reach, "package": F.when(F.col("known"), F.col("package")).otherwise("")}).drop("known")
    classed = _shared(_shared(asked, "k", good, "i"), "t", good, "g").drop("k", "t")
    alike = ["p", "i_shared", "i_size", "g_shared", "g_size"]
    good = _shared(_shared(good, "i", asked, "k"), "g", asked, "t").withColumn("_n", F.row_number().over(Window.partitionBy(*alike).orderBy("id"))).where(F.col("_n") <= k).drop("_n", "i", "g")
    by = [c for c in classed.columns if c != "query"]
    classes = classed.select(*by).distinct()
    own = classes.where("reach = 'own'").join(good, F.col("package") == F.col("p"))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    wide = classes.where("reach <> 'own'").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    other = wide.join(good.withColumn("block", block), "block")

    def overlap(x: str, y: str) -> Column:
        both = F.size(F.array_intersect(f"{x}_shared", f"{y}_shared"))
        return F.when(both > 0, both / (F.col(f"{x}_size") + F.col(f"{y}_size") - both)).otherwise(0.0)

    tier = F.when((F.col("reach") != "all") & (F.col("p") == F.col("package")), 0).otherwise(1)
    scored = lambda df: df.withColumns({"tier": tier, "shape": overlap("k", "i"), "overlap": overlap("t", "g")})
    order = ["tier", F.col("shape").desc(), F.col("overlap").desc(), "id"]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    kept = [*by, "id", "tier", "shape", "overlap"]
    best = ranked(scored(own).select(*kept).unionByName(ranked(scored(other), *by, "block").select(*kept)), *by)
    return classed.join(best, by).select("query", "rank", "id", "tier", "shape", "overlap")


def _shared(rows: DataFrame, own: str, others: DataFrame, other: str) -> DataFrame:
    """``rows`` with the tokens of a column that any of the other side's rows has (sorted), and how many tokens the column has; 0 if it shares none."""
    known = others.select(F.explode(other).alias("token")).distinct()
    found = rows.select(own).distinct().select(own, F.explode(own).alias("token")).join(known, "token").groupBy(own).agg(F.array_sort(F.collect_set("token")).alias(f"{own}_shared"))
    joined = rows.join(found, own, "left")
    return joined.withColumns({f"{own}_size": F.when(F.col(f"{own}_shared").isNotNull(), F.size(own)).otherwise(0), f"{own}_shared": F.coalesce(f"{own}_shared", F.array().cast("array<string>"))})


def features(pairs: DataFrame, today: str) -> DataFrame:
    """The eight ranking features of (query, pattern) pairs: query, package, kind and text of the query; id, p (package), guidance and the rest of the pattern.

    Packages match if they are equal and not empty; shape is the token overlap of kind and id, overlap that of text and guidance.
    """
    ev, ct = F.col("evidence"), F.col("contradictions")
    return pairs.select(
        "query", "id", F.coalesce((F.col("package") == F.col("p")) & (F.col("package") != ""), F.lit(False)).cast("int").alias("package_match"),
        jaccard(tokens(F.col("kind")), tokens(F.col("id").cast("string"))).alias("shape"), jaccard(tokens(F.col("text")), tokens(F.col("guidance"))).alias("overlap"),
        (F.col("confidence") == "confirmed").cast("int").alias("confirmed"), ev.alias("evidence"), ct.alias("contradictions"), (ev / (ev + ct + 1)).alias("support"), recency(F.col("reviewed"), today).alias("recency"),
    )


def pruned_examples(patterns: DataFrame, least: float = 0.3) -> DataFrame:
    return patterns.withColumn("examples", F.filter("examples", lambda e: e["score"] >= least))


def recorded(facts: DataFrame, patterns: DataFrame) -> DataFrame:
    """What facts of an edit (pattern, delta, guidance, package, at) add to the patterns: one row for each pattern that has or gets evidence.

    Facts without a pattern are left out. A pattern that isn't known yet begins, tentative and no seed, with its first fact whose guidance isn't
    blank; facts before it are lost. Evidence never counts below 0.
    """
    named = facts.where("pattern <> ''").join(patterns.select(F.col("id").alias("pattern"), F.lit(True).alias("known")), "pattern", "left")
    begins = F.min(F.when(F.trim(F.coalesce("guidance", F.lit(""))) != "", F.col("at"))).over(Window.partitionBy("pattern"))
    counted = named.withColumn("begins", F.when(F.col("known"), F.lit(None)).otherwise(begins)).where("known or at >= begins")
    gain = F.greatest(F.lit(0.0), F.col("delta"))
    return counted.groupBy("pattern").agg(
        F.first("known").isNull().alias("created"), F.count(F.lit(1)).alias("evidence"), F.count(F.when(F.col("delta") > 0, 1)).alias("real_evidence"), F.sum(gain).alias("gain"),
        F.min_by(F.trim("guidance"), F.when(F.trim(F.coalesce("guidance", F.lit(""))) != "", F.col("at"))).alias("guidance"),
    )


def unimproved(patterns: DataFrame, index: DataFrame) -> DataFrame:
    """Patterns of the index that are no seeds, not contradicted and have no real evidence."""
    return patterns.where(~F.col("seed") & (F.col("confidence") != "contradicted") & (F.col("real_evidence") == 0)).join(index.select("id"), "id", "left_semi")


def index_upsert(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index (id, confidence, contradicted_at) with new rows in place of old ones; contradicted_at stays unless the new row has one, 0 at first."""
    new = rows.select("id", F.col("confidence").alias("new"), F.col("contradicted_at").alias("stamp"), F.lit(True).alias("given"))
    both = index.select("id", "confidence", "contradicted_at").join(new, "id", "full_outer")
    return both.select("id", F.when(F.col("given"), F.col("new")).otherwise(F.col("confidence")).alias("confidence"), F.coalesce("stamp", "contradicted_at", F.lit(0)).alias("contradicted_at"))


def seeds_only(patterns: DataFrame, frozen: bool = False) -> DataFrame:
    """The library after a reset: its seeds. A frozen one stays as it is."""
    return patterns if frozen else patterns.where("seed")


def merged_texts(patterns: DataFrame, items: str) -> DataFrame:
    """Contradictions of patterns named base, base-1, ...: each different one once, at its first place by (pattern, place)."""
    base = F.regexp_extract("id", r"^(.+?)-(\d+)$", 1)
    named = patterns.select(F.when(base == "", F.col("id")).otherwise(base).alias("base"), "id", F.posexplode(items).alias("place", "item"))
    once = named.groupBy("base", "item").agg(F.min(F.struct((F.col("id") != F.col("base")).alias("variant"), "id", "place")).alias("at"))
    return once.groupBy("base").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias(items))
