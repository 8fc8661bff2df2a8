"""Inputs made after observed values: boundary cases first, then samples that depend on seed and key alone."""

from __future__ import annotations

import json
import random
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def boundaries(value) -> list:
    """What often goes wrong with values like this one: extremes, nulls, empty and single ones."""
    if isinstance(value, dict):
        columns = {c: v if isinstance(v, list) else [] for c, v in value.items()}
        return [{c: [] for c in value}, {c: v[:1] or [0] for c, v in columns.items()}, {c: v * 2 for c, v in value.items() if isinstance(v, list)}]
    if isinstance(value, list):
        return [[], [value[0] if value else None], *([[None, *value[:2]]] if value else [])]
    if value is None:
        return [None]
    if isinstance(value, bool):
        return [True, False]
    return ["", "x", value] if isinstance(value, str) else [0, 1, -1, 1e15, -1e15, None]


def sample(value, rng: random.Random):
    """A value of the same type: numbers up to twice as large, texts of the same letters, lists and columns of other lengths."""
    if isinstance(value, dict):
        first = {c: v[0] if isinstance(v, list) and v else 0 for c, v in value.items()}
        n = max((len(v) for v in value.values() if isinstance(v, list)), default=1)
        n = rng.choice([0, 1, n, n * 2])
        return {c: [sample(v, rng) for _ in range(n)] for c, v in first.items()}
    if isinstance(value, list):
        n = rng.choice([0, 1, len(value), len(value) + 1, len(value) * 2])
        return [sample(value[0] if value else 0, rng) for _ in range(n)]
    if value is None:
        return None
    if isinstance(value, bool):
        return rng.random() < 0.5
    if isinstance(value, str):
        letters = value or "x"
        return "".join(rng.choice(letters) for _ in range(rng.randint(max(0, len(value) - 2), len(value) + 3)))
    most = 2 * max(abs(value), 1)
    return rng.randint(-most, most) if isinstance(value, int) else rng.uniform(-most, most)


def inputs(df: DataFrame, key: str, value: Column, samples: int = 20, seed: int = 0) -> DataFrame:
    """Rows (key, case, boundary, input) for each row of ``df``: ``value`` and ``input`` are JSON texts, ``case`` numbers from 0.

    Samples come from a generator seeded by ``seed`` and the key, so a row's cases don't depend on other rows or on partitions. A
    value that is no JSON counts as null.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

    @F.udtf(returnType="case int, boundary boolean, input string")
    class Cases:
        def eval(self, name: str, text: str, n: int, start: int):
            try:
                value = json.loads(text) if text is not None else None
            except ValueError:
                value = None
            fixed = boundaries(value)
            rng = random.Random(f"{start}:{name}")
            for i, made in enumerate([*fixed, *(sample(value, rng) for _ in range(n))]):
                yield i, i < len(fixed), json.dumps(made, ensure_ascii=False)

    rows = df.select(F.col(key), value.alias("_value"))
    return rows.lateralJoin(Cases(F.col(key).cast("string").outer(), F.col("_value").outer(), F.lit(samples), F.lit(seed))).drop("_value")


def first_counterexamples(results: DataFrame, key: str) -> DataFrame:
    """Of each key the failing case (case, input, verdict) with the least number."""
    return results.where("verdict = 'fail'").groupBy(key).agg(F.min(F.struct("case", "input")).alias("x")).select(key, "x.case", "x.input")
