from pyspark.sql import functions as F

from tallyloom.operators import evidence as E
from tallyloom.operators import graph as G
from tallyloom.operators import joins as J
from tallyloom.operators import scoring as R
from tallyloom.operators import windows as W


def test_presence_is_not_null(spark):
    a, b = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k int, e double"), spark.createDataFrame([(1, None), (2, None)], "k int, a double")
    assert {r.k: r.present for r in J.presence_join(a, b, ["k"]).collect()} == {1: True, 2: True, 3: False}


def test_equal_spans_contain_each_other(spark):
    s = spark.createDataFrame([(1, "a", 0, 9), (1, "b", 2, 9), (1, "c", 0, 9), (2, "d", 0, 1)], "g int, k string, s int, e int")
    assert {(r.outer_key, r.n_inside) for r in J.contained(s, "g", "k", F.col("s"), F.col("e")).collect()} == {("a", 2), ("c", 2)}
    lines = spark.createDataFrame([(1, "a", 1, 5, 3, 0), (1, "b", 1, 6, 2, 9), (1, "c", 1, 4, 3, 0), (1, "d", 3, 1, 3, 2)], "g int, k string, l0 int, c0 int, l1 int, c1 int")
    got = J.contained(lines, "g", "k", J.position(F.col("l0"), F.col("c0")), J.position(F.col("l1"), F.col("c1")), 1 << 17)
    assert {(r.outer_key, r.n_inside) for r in got.collect()} == {("a", 1), ("c", 2)}


def test_points_in_intervals_are_all_found(spark):
    spans = [(1, i, i * 3, i * 3 + i % 11) for i in range(60)]
    points = [(1, p) for p in range(200)]
    got = {(r.p, r.k) for r in J.points_in_intervals(spark.createDataFrame(points, "g int, p int"), spark.createDataFrame(spans, "g int, k int, s int, e int"), "g", "p", "s", "e", 8).collect()}
    assert got == {(p, k) for _, p in points for _, k, s, e in spans if s <= p <= e}


def test_greedy_assignment(spark):
    m = spark.createDataFrame([(1, "r1", "c1", 0.9), (1, "r1", "c2", 0.1), (1, "r2", "c1", 0.95), (1, "r2", "c2", 0.8)], "g int, row string, col string, score double")
    assert {(r.row, r.col) for r in J.greedy_match(m, "g").collect()} == {("r2", "c1"), ("r1", "c2")}
    short = J.greedy_match(m.where("col = 'c1'"), "g")
    assert {(r.row, r.col, r.score) for r in short.collect()} == {("r2", "c1", 0.95), ("r1", None, 0.0)}
    assert [tuple(r) for r in J.covered_score(short, "g").collect()] == [(1, 0.475, 1)]


def test_top_examples_replace_only_by_better_ones(spark):
    rows = [("p", "a", 0.5, 1), ("p", "a", 0.9, 2), ("p", "b", 0.7, 3), ("p", "c", 0.7, 4), ("p", "d", 0.1, 5)]
    got = W.top_examples(spark.createDataFrame(rows, "p string, h string, s double, t int"), ["p"], "h", "s", "t", 3).orderBy("rank").collect()
    assert [(r.h, r.s) for r in got] == [("a", 0.9), ("b", 0.7), ("c", 0.7)]


def test_clip_sees_the_next_range_only(spark):
    rows = [(1, 0, 5, 1), (1, 3, 4, 2), (1, 4, 9, 3)]
    assert [(r.s, r.e) for r in W.clip_ranges(spark.createDataFrame(rows, "g int, s int, e int, t int"), "g", "s", "e", "t").orderBy("s").collect()] == [(0, 2), (3, 3), (4, 9)]


def test_order_is_first_in_first_out_with_cycles_last(spark):
    nodes = spark.createDataFrame([("s", n, i) for i, n in enumerate("abcde")], "g string, node string, ord long")
    edges = spark.createDataFrame([("s", "a", "c"), ("s", "d", "e"), ("s", "e", "d"), ("s", "b", "b")], "g string, node string, needs string")
    assert [r.node for r in G.topological_order(nodes, edges, "g").orderBy("place").collect()] == ["b", "c", "a", "d", "e"]


def test_review_promotes_then_demotes(spark):
    rows = [("tentative", False, 2, 2, 0), ("tentative", False, 2, 2, 3), ("confirmed", False, 0, 0, 1), ("confirmed", True, 0, 0, 4), ("tentative", True, 0, 0, 5), ("confirmed", False, 2, 0, 1), ("confirmed", True, 9, 0, 4), ("tentative", True, 9, 8, 5)]
    df = spark.createDataFrame(rows, "confidence string, seed boolean, evidence int, real_evidence int, contradictions int")
    assert [r.after for r in E.review(df).collect()] == ["confirmed", "tentative", "tentative", "confirmed", "contradicted", "tentative", "confirmed", "confirmed"]


def test_scores_of_nothing(spark):
    assert R.ndcg(spark.createDataFrame([(1, 1.0, 0, 1)], "g int, s double, gain int, t int"), "g", "s", "gain", "t", 3).first()["ndcg"] == 0
    p = R.sign_test(spark.createDataFrame([], "delta double")).first()
    assert (p.n, p.p_value) == (0, 1.0)


def test_fallback_lookup(spark):
    index = spark.createDataFrame([("p", "h1", 1), ("p", "", 2), ("q", "", 3)], "package string, shape string, id int")
    rows = spark.createDataFrame([("p", "h1"), ("p", "zz"), ("q", "h1")], "package string, shape string")
    assert {(r.package, r["shape"], r.id, r.tier) for r in J.lookup_with_fallback(rows, index, ["package", "shape"], "package").collect()} == {("p", "h1", 1, 0), ("p", "zz", 2, 1), ("q", "h1", 3, 1)}
