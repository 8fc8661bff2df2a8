import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.compare import ATOL, RTOL
from tallyloom.operators import nested as N


def judge(e, a):
    """A plain version of the rules on parsed JSON: (score, tag, place, reason)."""
    null = lambda v: v is None or isinstance(v, float) and math.isnan(v)
    number = lambda v: isinstance(v, (int, float))
    if null(e) or null(a):
        return (1.0, None, None, None) if null(e) and null(a) else (0.0, "value", "", "null")
    if number(e) and number(a):
        return (1.0, None, None, None) if abs(e - a) <= ATOL + RTOL * abs(a) else (0.0, "value", "", "number")
    if isinstance(e, str) and isinstance(a, str):
        return (1.0, None, None, None) if e == a else (0.0, "value", "", "text")
    if isinstance(e, list) and isinstance(a, list):
        if len(e) != len(a):
            return 0.0, "infra", "", "length"
        parts = [(f"[{i}]", x, y) for i, (x, y) in enumerate(zip(e, a, strict=True))]
    elif isinstance(e, dict) and isinstance(a, dict):
        if e.get(N.CALLABLE) and a.get(N.CALLABLE):
            return callables(e, a)
        if set(e) != set(a):
            return 0.0, "infra", "", "keys"
        parts = [("." + k, e[k], a[k]) for k in sorted(e)]
    else:
        return 0.0, "infra", "", "type"
    for at, x, y in parts:
        _, tag, place, reason = judge(x, y)
        if tag:
            return 0.0, tag, at + place, reason
    return 1.0, None, None, None


def callables(e, a):
    x, y = [f for f in e.get("formals", []) if f != "..."], [f for f in a.get("formals", []) if f not in ("args", "kwargs")]
    s = 0.7 if x == y else 0.7 * len(set(x) & set(y)) / max(len(x), len(y)) if x and y else 0.0
    p, q = e.get("attributes", {}), a.get("attributes", {})
    both = set(p) & set(q)
    s += 0.3 if not p and not q else 0.0 if not p or not q else 0.15 if not both else 0.3 * sum(p[k] == q[k] for k in both) / len(both)
    return (1.0, None, None, None) if s >= 0.95 else (s, "infra" if s >= 0.5 else "value", "", "callable")


def compared(spark, cases):
    df = spark.createDataFrame([(i, json.dumps(e), json.dumps(a)) for i, (e, a) in enumerate(cases)], "i int, x string, y string")
    got = N.nested_compare(df.select("i", F.parse_json("x").alias("e"), F.parse_json("y").alias("a")), ["i"]).orderBy("i").collect()
    assert [r.i for r in got] == list(range(len(cases)))
    return [(round(r.score, 9), r.tag, r.at, r.reason) for r in got]


#: expected, actual, passes, tag
CASES = [
    (None, None, True, None), (1.0, None, False, "value"), (1.0, 1.00000001, True, None), (1.0, 2.0, False, "value"), (True, True, True, None), (True, False, False, "value"), (True, 1, True, None),
    (True, 2, False, "value"), ("foo", "foo", True, None), ("foo", "bar", False, "value"), ([1, 2, 3], [1, 2, 3], True, None), ([1, 2], [1], False, "infra"), ([1, 2], [1, 99], False, "value"),
    ({"a": [1, 2], "b": [3, 4]}, {"b": [3, 4], "a": [1, 2]}, True, None), ({"a": [1]}, {"b": [1]}, False, "infra"), ([1, 2], 3.0, False, "infra"),
]


def test_the_rules_case_by_case(spark):
    got = compared(spark, [(e, a) for e, a, _, _ in CASES])
    assert [(tag is None, tag) for _, tag, _, _ in got] == [(ok, tag) for _, _, ok, tag in CASES]


def test_random_values_against_plain_rules(spark):
    r = random.Random(11)

    def value(depth):
        k = r.randrange(9 if depth else 6)
        if k >= 6:
            return [value(depth - 1) for _ in range(r.randrange(4))] if k < 8 else {c: value(depth - 1) for c in r.sample(["a", "b", "Z", "aa", "é", "b.c"], r.randrange(4))}
        return [None, True, r.randrange(3), r.random(), r.choice(["x", "1", "true", ""]), 10**12][k]

    def changed(v):
        if isinstance(v, list):
            return [changed(x) for x in v] + ([1] if r.random() < 0.05 else [])
        if isinstance(v, dict):
            out = {k: changed(x) for k, x in v.items()}
            return out | {"new": 1} if r.random() < 0.05 else out
        return value(0) if r.random() < 0.1 else v * (1 + 1e-8) if isinstance(v, float) else v

    cases = [(v, changed(v)) for v in (value(4) for _ in range(500))]
    meta = lambda f, a: {N.CALLABLE: True, "formals": f, "attributes": a}
    cases += [(meta(["x", "..."], {}), meta(["x", "kwargs"], {})), (meta(["x", "y"], {"k": 1}), meta(["x", "z"], {"k": 1})), (meta(["x"], {"k": 1}), meta(["z"], {})), ([meta(["x", "y"], {})], [meta(["x"], {})]), (meta([], {"k": [1]}), {"formals": []})]
    want = [judge(*c) for c in cases]
    assert compared(spark, cases) == [(round(s, 9), t, p, q) for s, t, p, q in want]
    assert len({(t, q) for _, t, _, q in want}) >= 8


def data(spark, rows):
    return spark.createDataFrame([(run, name, json.dumps(v)) for run, name, v in rows], "run int, name string, j string").select("run", "name", F.parse_json("j").alias("value"))


def test_scores_of_runs(spark):
    expected = data(spark, [(1, "a", 1.0), (1, "b", [1, 2]), (2, "a", {"x": 1}), (3, "u", 1), (4, "a", 1), (4, "b", "long text here"), (4, "u", 2), (6, "a", [1, 2, 3, 4, 5, 6, 7, 8, 9])])
    actual = data(spark, [(1, "a", 1.0), (1, "b", [1, 2]), (1, "more", 0), (2, "a", {"x": 1, "y": 2}), (3, "u", 1), (4, "a", 1), (5, "only", 1), (6, "a", [1, 2, 3, 4, 5, 6, 7, 8])])
    lost = spark.createDataFrame([(3, "u"), (4, "u")], "run int, name string")
    runs = {m: {r.run: (round(r.score, 6), r.verdict, r.n_scored, r.n_uncomparable) for r in N.data_scores(expected, actual, lost, m)[1].collect()} for m in ("auto", "exact", "embedding")}
    assert runs["exact"] == {1: (1, "pass", 2, 0), 2: (0, "fail", 1, 0), 3: (0, "uncomparable", 0, 1), 4: (0.5, "fail", 2, 1), 5: (1, "pass", 0, 0), 6: (0, "fail", 1, 0)}
    from difflib import SequenceMatcher

    like = SequenceMatcher(None, "[1,2,3,4,5,6,7,8,9]", "[1,2,3,4,5,6,7,8]").ratio()
    assert like >= 0.9 and runs["auto"][6] == (round(like, 6), "pass_via_fallback", 1, 0) and runs["auto"][1] == runs["exact"][1] and runs["auto"][2][1] == "fail" and runs["auto"][2][0] > 0
    assert runs["embedding"][1] == (1, "pass_via_fallback", 2, 0) and runs["embedding"][3] == runs["exact"][3] and runs["embedding"][4][0] == 0.5
    variables = {(v.run, v.name): (v.score, v.tag, v.reason) for v in N.data_scores(expected, actual, lost, "exact")[0].collect()}
    assert variables[4, "b"] == (0, "value", "missing") and variables[2, "a"] == (0, "infra", "keys") and (4, "u") not in variables
    with pytest.raises(ValueError, match="mode"):
        N.data_scores(expected, actual, mode="other")


def test_infinities_and_nan_at_any_depth(spark):
    df = spark.sql("select struct(array(1.5D, double('nan'), double('inf')) as a, map('k', double('-inf')) as m, 'NaN' as s, cast(null as double) as n, array(struct(float('inf') as f)) as r) as v")
    got = df.select(F.to_json(N.finite_value(F.col("v"), df.schema["v"].dataType)).alias("j")).first().j
    assert json.loads(got) == {"a": [1.5, None, "Inf"], "m": {"k": "-Inf"}, "s": "NaN", "n": None, "r": [{"f": "Inf"}]}
    nan = spark.sql("select 1 as i, cast(double('nan') as variant) as e, cast(null as variant) as a")
    assert N.nested_compare(nan, ["i"]).first().verdict == "pass"


def test_failures_are_not_joined_to_their_pairs(spark):
    """A join took the failures for small by their files, and broadcast them through the driver."""
    df = spark.range(50).selectExpr("id", "parse_json(format_string('{\"a\": [%d, 1]}', id % 3)) as e", "parse_json('{\"a\": [0, 1]}') as a")
    got = N.nested_compare(df, ["id"])
    assert "Join" not in got._jdf.queryExecution().toString()
    assert {r.id: (r.verdict, r.at) for r in got.collect()} == {k: ("pass", None) if k % 3 == 0 else ("fail", ".a[0]") for k in range(50)}
