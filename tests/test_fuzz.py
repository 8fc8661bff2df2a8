import json

from pyspark.sql import functions as F

from tallyloom.operators import fuzz as X

OBSERVED = {1: 5, 2: -2.5, 3: True, 4: "ab", 5: None, 6: [1, 2, 3], 7: [], 8: {"a": [1, 2], "b": ["x"], "c": 3}, 9: "", 10: [[1], [2]], 11: {}}


def test_inputs_by_type(spark):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in OBSERVED.items()] + [(12, "{broken"), (13, None)], "k int, v string")
    cases = lambda n: sorted(map(tuple, X.inputs(df.repartition(n), "k", F.col("v"), samples=30, seed=4).collect()))
    got = cases(1)
    assert got == cases(5)  # whatever the partitions
    fixed = {}
    for k, case, boundary, text in got:
        if boundary:
            fixed.setdefault(k, []).append(json.loads(text))
    numbers = [0, 1, -1, 1e15, -1e15, None]
    assert fixed == {
        1: numbers, 2: numbers, 3: [True, False], 4: ["", "x", "ab"], 5: [None], 6: [[], [1], [None, 1, 2]], 7: [[], [None]], 8: [{"a": [], "b": [], "c": []}, {"a": [1], "b": ["x"], "c": [0]}, {"a": [1, 2, 1, 2], "b": ["x", "x"]}],
        9: ["", "x", ""], 10: [[], [[1]], [None, [1], [2]]], 11: [{}, {}, {}], 12: [None], 13: [None]}
    drawn = {k: [json.loads(t) for k2, _, b, t in got if k2 == k and not b] for k in range(1, 14)}
    assert all(len(v) == 30 for v in drawn.values())
    assert all(isinstance(x, int) and -10 <= x <= 10 for x in drawn[1]) and all(-5 <= x <= 5 for x in drawn[2]) and {x for x in drawn[3]} == {True, False}
    assert all(set(x) <= {"a", "b"} and len(x) <= 5 for x in drawn[4]) and {len(x) for x in drawn[6]} <= {0, 1, 3, 4, 6} and {len(x["a"]) for x in drawn[8]} <= {0, 1, 2, 4} and all(isinstance(x, list) for row in drawn[10] for x in row)
    other = sorted(map(tuple, X.inputs(df, "k", F.col("v"), samples=30, seed=5).collect()))
    assert other != got and [x for x in other if x[2]] == [x for x in got if x[2]]


def test_first_counterexamples(spark):
    df = spark.createDataFrame([(1, 0, "a", "pass"), (1, 2, "c", "fail"), (1, 1, "b", "fail"), (2, 0, "a", "pass")], "k int, case int, input string, verdict string")
    assert [tuple(r) for r in X.first_counterexamples(df, "k").collect()] == [(1, 1, "b")]
