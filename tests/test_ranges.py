import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ranges as X
from tallyloom.operators import windows as W


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_running_values_of_hot_keys(spark, parts):
    r = random.Random(parts)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), i, r.choice([None, 1, 2, 30, -4])) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, i int, v long").repartition(3)
    sums = {x.i: (x.n, x.s) for x in X.running(X.numbered_within(df, ["k"], ["i"], "n", parts), ["k"], ["i"], F.col("v"), "s", "sum", parts).collect()}
    best = {x.i: x.m for x in X.running(df, ["k"], [F.desc("i")], F.col("v"), "m", "max", parts).collect()}
    assert len(sums) == len(best) == 700
    for k in {row[0] for row in rows}:
        own = [row for row in rows if row[0] == k]
        for n, (_, i, _) in enumerate(own):
            seen = [v for _, _, v in own[: n + 1] if v is not None]
            assert sums[i] == (n + 1, sum(seen) if seen else None)
            assert best[i] == max([v for _, _, v in own[n:] if v is not None], default=None)
    assert X.numbered_within(df.limit(0), ["k"], ["i"], "n").count() == 0


def test_one_name_for_all_rows(spark):
    df = spark.range(3000).select(F.lit("x").alias("name"), "id")
    got = {x.id: x.fresh for x in W.fresh_names(df, "name", ["id"]).collect()}
    assert got == {i: "x" if i == 0 else f"x_{i}" for i in range(3000)}
