import re
import time

from tallyloom.operators import evidence as E

ASKED = "query long, package string, kind string, text string"
HELD = "id string, package string, guidance string, confidence string, seed boolean, real_evidence int"


def plainly(queries, patterns, k):
    split = lambda s: set(re.split(r"[\s._\-]+", (s or "").lower())) - {""}
    like = lambda a, b: len(split(a) & split(b)) / len(split(a) | split(b)) if split(a) | split(b) else 0.0
    for query, package, kind, text in queries:
        same = [p for p in patterns if package and p[1] == package]
        pool = sorted([(int((p[1] or "") != (package or "")), -like(kind, p[0]), -like(text, p[2]), p[0]) for p in same or patterns if p[3] != "contradicted" and (p[4] or p[3] == "confirmed" or p[5] >= 2)])
        yield from ((query, n + 1, *p) for n, p in enumerate(pool[:k]))


def test_classes_rank_as_rows_do(spark):
    queries = [(n, [None, "", "a", "b", "none", "other"][n % 6], ["s1", "S2 b", "", None][n % 4], ["use x", "use a", "zz", "Use-Use y z", None][n % 5]) for n in range(60)]
    patterns = [(f"{'ab'[n % 2]}.s{n % 3}-{n}", ["a", "b", "", None][n % 4], ["use x", "use a b", None, "q", "y z w"][n % 5], ["confirmed", "tentative", "contradicted"][n % 3], n % 5 == 0, n % 4) for n in range(80)]
    got = E.retrieve(spark.createDataFrame(queries, ASKED), spark.createDataFrame(patterns, HELD), 4).collect()
    assert sorted((r.query, r.rank, r.tier, -r.shape, -r.overlap, r.id) for r in got) == sorted(plainly(queries, patterns, 4))


def test_queries_and_patterns_that_are_alike_meet_once(spark):
    """20,000 queries and 20,000 patterns would be 400 million pairs."""
    begun = time.monotonic()
    queries = spark.range(20000).selectExpr("id as query", "'a' as package", "'s1' as kind", "concat('name', id) as text")
    patterns = spark.range(20000).selectExpr("format_string('a.s%d-%05d', id % 3, id) as id", "'a' as package", "'use x' as guidance", "'confirmed' as confidence", "false as seed", "0 as real_evidence")
    got = E.retrieve(queries, patterns, 3).groupBy("rank", "id").count().collect()
    assert sorted(map(tuple, got)) == [(1, "a.s1-00001", 20000), (2, "a.s1-00004", 20000), (3, "a.s1-00007", 20000)]
    assert time.monotonic() - begun < 60
