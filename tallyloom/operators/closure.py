"""Sources of functions and of what they call, nearest first, within a budget of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

BUDGET, MOST = 200, 80


def callee_closure(
    queries: DataFrame, reach: DataFrame, definitions: DataFrame, calls: DataFrame, dispatch: DataFrame | None = None, classes: DataFrame | None = None, budget: int = BUDGET, most: int = MOST
) -> DataFrame:
    """query, place (from 0), depth, package, symbol and lines of what each query (query, symbol) takes.

    ``reach``: query, package, ord: where a query looks for symbols, the first package that defines one counts. ``definitions``: package,
    symbol, lines. ``calls``: package, symbol, callee, ord. ``dispatch`` (package, symbol, generic): definitions that choose among methods;
    then generic.default comes after their calls, and the methods generic.x that the query's packages define after it, by name, of the query's
    ``classes`` (query, class) only where these are given.

    Breadth first: callees stand in the order of their callers, then of the calls, then by name. A symbol is taken once, so cycles end; one that no
    package defines is passed over. Each takes its lines, ``most`` at most, and no more than are left of the ``budget``; when
    nothing is left the walk ends. One round for each distance; a round works on the newest symbols of all queries.

    Calls behind ``budget`` lines of calls of the same caller can't be taken: symbols seen before among these have no more lines than
    were spent. So lists of calls are cut before the rounds, and queries that have spent their budget leave them.
    """
    calls = written(_within_budget(calls, definitions, budget, most), "closure-calls")
    by_place = Window.partitionBy("query").orderBy("turn", "symbol")
    front = queries.select("query", "symbol", F.array(F.lit(0).cast("long")).alias("turn"))
    seen = taken = spent = None
    depth = 0
    while True:
        front = front.groupBy("query", "symbol").agg(F.min("turn").alias("turn"))
        front = written(front if seen is None else front.join(seen, ["query", "symbol"], "left_anti"), "closure-front")
        if front.isEmpty():
            break
        seen = front.select("query", "symbol") if seen is None else written(seen.unionByName(front.select("query", "symbol")), "closure-seen")
        places = front.join(reach, "query").join(definitions, ["package", "symbol"])
        places = places.groupBy("query", "symbol").agg(F.min(F.struct("ord", "package", "lines", "turn")).alias("x")).select("query", "symbol", "x.package", "x.lines", "x.turn")
        places = places.join(spent, "query") if spent is not None else places.withColumns({"spent": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})
        own = F.least("lines", F.lit(most))
        total = F.col("spent") + F.sum(own).over(Window.partitionBy("query"))
        left = F.lit(budget) - F.col("spent") - F.sum(own).over(by_place) + own
        kept = places.withColumns({"left": left, "place": F.row_number().over(by_place) + F.col("before") - 1, "total": total}).where("left > 0")
        kept = kept.select("query", F.col("place").cast("long").alias("place"), F.lit(depth).alias("depth"), "package", "symbol", F.least(own, F.col("left")).cast("long").alias("lines"), "total")
        kept = written(kept, "closure-kept")
        taken = kept if taken is None else taken.unionByName(kept)
        going = kept.where(F.col("total") < budget)
        spent = going.groupBy("query").agg(F.max("total").alias("spent"), (F.max("place") + 1).alias("before"))
        caller = going.select("query", "place", "package", "symbol")
        step = lambda df, kind, order: df.select("query", F.col("callee").alias("symbol"), F.array(F.col("place"), F.lit(kind).cast("long"), order).alias("turn"))
        front = step(caller.join(calls, ["package", "symbol"]), 0, F.col("ord").cast("long"))
        if dispatch is not None:
            generic = caller.join(dispatch, ["package", "symbol"])
            front = front.unionByName(step(generic.withColumn("callee", F.concat("generic", F.lit(".default"))), 1, F.lit(0).cast("long")))
            # A method's name is cut at each of its dots, so methods are found by equality.
            cut = F.explode(F.expr("transform(sequence(1, size(split(callee, '[.]')) - 1), i -> substring_index(callee, '.', i))"))
            methods = definitions.select("package", F.col("symbol").alias("callee")).where("callee like '%.%'").withColumn("generic", cut)
            found = generic.drop("package").join(reach.drop("ord"), "query").join(methods, ["package", "generic"]).select("query", "place", "generic", "callee").distinct()
            if classes is not None:
                suffix = F.expr("substring(callee, length(generic) + 2)")
                found = found.withColumn("class", suffix).join(classes, ["query", "class"], "left_semi").drop("class")
            order = F.row_number().over(Window.partitionBy("query", "place").orderBy("callee")).cast("long")
            front = front.unionByName(step(found.withColumn("n", order), 2, F.col("n")))
        depth += 1
    return taken.select("query", "place", "depth", "package", "symbol", "lines") if taken is not None else queries.where("false").select(
        "query", F.lit(0).cast("long").alias("place"), F.lit(0).alias("depth"), F.lit("").alias("package"), "symbol", F.lit(0).cast("long").alias("lines"))


def _within_budget(calls: DataFrame, definitions: DataFrame, budget: int, most: int) -> DataFrame:
    """Calls that less than ``budget`` lines of other callees of their caller's package stand before. Each callee counts once, with the fewest lines that any package has for it."""
    fewest = Window.partitionBy("symbol")
    known = definitions.groupBy("package", "symbol").agg(F.min(F.least("lines", F.lit(most))).alias("_lines")).withColumn("_lines", F.min("_lines").over(fewest)).withColumnRenamed("symbol", "callee")
    once = calls.groupBy("package", "symbol", "callee").agg(F.min("ord").alias("ord")).join(known, ["package", "callee"], "left")
    before = F.sum(F.coalesce("_lines", F.lit(0))).over(Window.partitionBy("package", "symbol").orderBy("ord", "callee").rowsBetween(Window.unboundedPreceding, -1))
    return once.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < budget).select("package", "symbol", "callee", "ord")
