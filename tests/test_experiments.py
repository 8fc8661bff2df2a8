import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import experiments as X


def plain_ranks(deltas):
    order = sorted(deltas, key=abs)
    rank = {}
    for v in {abs(d) for d in deltas}:
        places = [i + 1 for i, d in enumerate(order) if abs(d) == v]
        rank[v] = sum(places) / len(places)
    zeros = sum(rank[0.0] for d in deltas if d == 0) / 2
    plus, minus = sum(rank[abs(d)] for d in deltas if d > 0) + zeros, sum(rank[abs(d)] for d in deltas if d < 0) + zeros
    n = len(deltas)
    ties = sum(c**3 - c for c in (sum(abs(d) == v for d in deltas) for v in rank))
    se = math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    z = (min(plus, minus) - n * (n + 1) / 4) / se if se else None
    return plus, minus, z, 1.0 if z is None else math.erfc(abs(z) / math.sqrt(2))


def test_signed_ranks(spark):
    r = random.Random(4)
    for deltas in ([r.choice([-1.5, -1.0, 0.0, 1.0, 2.0, 2.5]) for _ in range(200)], [r.gauss(0.3, 1) for _ in range(300)], [0.0] * 5, [1.0, 1.0], [-2.0, 1.0]):
        df = spark.createDataFrame([(d,) for d in deltas] + [(float("nan"),), (None,)], "delta double").repartition(5)
        plus, minus, z, p = plain_ranks(deltas)
        got = X.signed_ranks(df).first()
        assert (got["n"], got["r_plus"], got["r_minus"]) == (len(deltas), plus, minus) and got["n_zero"] == deltas.count(0.0)
        assert got["z"] is None if z is None else math.isclose(got["z"], z, abs_tol=1e-12)
        assert X.significance(df)[1] == "wilcoxon" and math.isclose(X.significance(df)[0], p, abs_tol=1e-12)
    assert X.significance(spark.createDataFrame([(1.0,)], "delta double")) == (1.0, "insufficient_data") and X.signed_ranks(df.limit(0)).first()["n"] == 0
    assert X.significance(spark.createDataFrame([(0.0,), (0.0,)], "delta double"), "sign") == (1.0, "sign_test")


def test_reports_are_read_back(spark, tmp_path):
    nan = float("nan")
    a = spark.createDataFrame([("s1", 0.5), ("s2", 0.9), ("s3", nan), ("s4", 0.2), ("s6", 1.0)], "script_id string, score double")
    b = spark.createDataFrame([("s1", 0.7), ("s2", 0.8), ("s3", 0.1), ("s4", 0.2), ("s5", 0.3)], "script_id string, score double")
    folder = str(tmp_path / "run")
    summary = X.ablation_report(a, b, folder, "frozen-vs-learning")
    assert (summary["n_scripts"], summary["n_valid"], summary["n_regressions"], summary["test"]) == (6, 3, 1, "wilcoxon") and math.isclose(summary["mean_delta"], 0.1 / 3)
    assert json.loads(spark.read.text(f"{folder}/summary").first().value) == summary
    rows = spark.read.option("header", True).csv(f"{folder}/per_script")
    assert rows.columns == ["script_id", "score_A", "score_B", "delta"] and {x.script_id: x.delta == "NaN" for x in rows.collect()} == {"s1": False, "s2": False, "s3": True, "s4": False, "s5": True, "s6": True}
    assert [x.script_id for x in spark.read.option("header", True).csv(f"{folder}/regressions").collect()] == ["s2"]


def test_only_successes_are_appended(spark, tmp_path):
    path = str(tmp_path / "curve")
    runs = lambda *rows: spark.createDataFrame(rows, "script_id string, final_score double, error string")
    assert X.append_curve(runs(("a", 0.5, None), ("b", None, "boom")), path, ["script_id", "final_score"]) == {"n_appended": 1, "n_failed": 1}
    assert X.append_curve(runs(("c", 0.7, "")), path, ["script_id", "final_score"]) == {"n_appended": 1, "n_failed": 0}
    found = spark.read.option("header", True).csv(path)  # every file begins with the header
    assert found.columns == ["script_id", "final_score"] and sorted(map(tuple, found.collect())) == [("a", "0.5"), ("c", "0.7")]


def test_weighted_samples(spark):
    rows = [(g, i, float(w)) for g in ("a", "b") for i, w in enumerate([0, 1, 1, 1, 1, 16])] + [(None, 1, 2.0), (None, 2, None)]
    df = spark.createDataFrame(rows, "g string, k int, w double")
    first = [X.weighted_sample(df.repartition(s % 3 + 1), ["g"], "k", "w", n=1, seed=s).where("g = 'a'").first().k for s in range(60)]
    assert 0 not in first and first.count(5) > 35 and len(set(first)) > 2
    got = X.weighted_sample(df, ["g"], "k", "w", n=9, seed=1)
    assert got.groupBy("g").count().orderBy("g").collect() == [(None, 1), ("a", 5), ("b", 5)]
    assert sorted(x.place for x in got.where("g = 'a'").collect()) == [1, 2, 3, 4, 5]
    half = X.weighted_sample(df, ["g"], "k", "w", share=0.5, seed=1)
    assert half.groupBy("g").agg(F.count("k")).orderBy("g").collect() == [(None, 1), ("a", 3), ("b", 3)]
    with pytest.raises(ValueError, match="either"):
        X.weighted_sample(df, ["g"], "k", "w")


def test_means_on_a_half_are_summed_in_order(spark, tmp_path):
    """The values' mean is a half, which their sum of doubles misses in some orders: partial sums of shuffled rows must not decide."""
    import random

    from tallyloom.plans import catalog

    r, rows, misses = random.Random(2), [], 0
    for user in range(300):
        cents = [r.randrange(1, 10000) for _ in range(7)]
        cents.append(-sum(cents) % 800 + 400)  # eight values: the mean is n + 0.5
        values = [c / 100 for c in cents]
        total = 0.0
        for v in values:
            total += v
        misses += total != sum(cents) / 100
        rows += [(user * 16 + 2 * i, user, "t", v) for i, v in enumerate(values)] + [(user * 16 + 1, user, "t", float(user))]
    assert misses > 20
    r.shuffle(rows)
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").repartition(9).write.parquet(str(tmp_path / "events.parquet"))
    even: dict = {}
    for k, user, _, v in sorted(rows):
        if k % 2 == 0:
            even.setdefault(user, []).append(v)
    deltas = []
    for user, values in even.items():
        total = 0.0
        for v in values:
            total += v
        deltas.append(user - float(int(total / 8 + 0.5)))
    got = catalog.QUERIES["signed_rank_test"](spark, str(tmp_path)).first()
    from tallyloom.operators.experiments import signed_ranks

    want = signed_ranks(spark.createDataFrame([(d,) for d in deltas], "delta double")).first()
    assert (got.n, got.n_zero, got.r_plus, got.r_minus, got.ties) == (want.n, want.n_zero, want.r_plus, want.r_minus, want.ties)


def test_odd_events_are_ranked_as_in_sql(spark, tmp_path):
    """Users and types that are null or read alike when joined by a dash, NaN, an event that comes twice, and no event at all."""
    import duckdb

    from tallyloom.plans import catalog

    r, nan = random.Random(1), float("nan")
    plain = [(i, r.randrange(30), r.choice("ab"), r.randrange(1, 9999) / 100) for i in range(2000)]
    nulls = [(5000 + i, r.choice([None, 1, 2]), r.choice([None, "a", "1", "2"]), r.choice([None, 3.5, 77.25, 400.0])) for i in range(300)]
    twice = [(8000 + i % 2, 99, "a", float(10 * i)) for i in range(8)]
    for n, rows in enumerate([plain + nulls, plain + [(6000 + i, 1, "z", nan if i % 2 else 2.0) for i in range(10)], plain + twice, []]):
        folder = tmp_path / str(n)
        spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(str(folder / "events.parquet"))
        con = duckdb.connect(config={"threads": 1})
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
        want = con.execute(catalog.ORACLE_SQL["signed_rank_test"])
        names = [x[0] for x in want.description]
        got = catalog.QUERIES["signed_rank_test"](spark, str(folder))
        assert got.columns == names and tuple(got.first()) == want.fetchone()
