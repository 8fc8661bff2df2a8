from pyspark.sql import functions as F

from tallyloom.operators import joins as J


def test_matching_needs_no_python_worker(spark):
    rows = [(1, "r1", "c1", 0.9), (1, "r1", "c2", 0.8), (1, "r2", "c1", 0.9), (1, "r2", "c2", 0.1), (1, "r3", "c1", 1.0), (1, "r3", "c2", None), (2, "r1", "c2", 0.5), (2, "r1", "c1", 0.5)]
    got = J.greedy_match(spark.createDataFrame(rows, "g int, row string, col string, score double"), "g")
    assert "Pandas" not in got._jdf.queryExecution().toString() and got.columns == ["g", "row", "col", "score"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "r3", "c1", 1.0), (1, "r1", "c2", 0.8), (1, "r2", None, 0.0), (2, "r1", "c1", 0.5)]))


def test_requests_are_counted_not_gathered(spark):
    rows = [(1, "a", 0), (1, "a", 0), (1, "a", 1), (1, "b", 0), (1, "c", 1), (2, "a", 0), (3, "a", None), (4, "a", 0), (4, "a", 1), (None, "a", 2)]
    got = J.requests_scores(spark.createDataFrame(rows, "g int, k string, side int"), "g", "k", F.col("side") == 0, F.col("side") == 1)
    assert "collect_set" not in got._jdf.queryExecution().toString()
    assert {r.g: round(r.score, 6) for r in got.collect()} == {1: 0.333333, 2: 0.0, 3: 1.0, 4: 1.0, None: 1.0}
