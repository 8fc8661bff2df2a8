"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import lean, ship
from .textnum import hashed_words, mixed

#: Features are numbered by so many bits of their hashes; beginnings of words have so many bytes.
BITS, STEMS = 20, (5, 7)


class Ftrl(NamedTuple):
    """Parameters of the learner. ``most_rows`` bounds the labelled rows that it is fitted on."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 0.5
    epochs: int = 4
    most_rows: int = 16_000


def features(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct features of each text: words, their beginnings, pairs of neighbours and pairs with a word between them."""
    words, starts = hashed_words(texts, lower=True)
    stems = [mixed(hashed_words(texts, True, k)[0] + np.uint64(k)) for k in STEMS]
    keys = [words, mixed(words[:-1] * np.uint64(3) + words[1:]), mixed(words[:-2] * np.uint64(5) + words[2:])]
    out = []
    for i in range(len(texts)):
        a, b = starts[i], starts[i + 1]
        own = np.concatenate([*[s[a:b] for s in stems], keys[0][a:b], keys[1][a : max(a, b - 1)], keys[2][a : max(a, b - 2)]])
        out.append(np.unique((own >> np.uint64(64 - BITS)).astype(np.int32)))
    return out


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, how: Ftrl = Ftrl(), seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and weights of the features that L1 leaves, and the bias. No rows give no weights and bias 0."""
    z, n, bias = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0
    bias_n = 0.0
    random = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    bias = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    for _ in range(how.epochs):
        for i in random.permutation(len(rows)):
            x = rows[i]
            zi, ni = z[x], n[x]
            w = np.where(np.abs(zi) <= how.l1, 0.0, -(zi - np.sign(zi) * how.l1) / ((how.beta + np.sqrt(ni)) / how.alpha + how.l2))
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - labels[i]
            z[x] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / how.alpha * w
            n[x] = ni + g * g
            bias_n += g * g
            bias -= 0.05 * g / (1 + np.sqrt(bias_n))
    w = np.where(np.abs(z) <= how.l1, 0.0, -(z - np.sign(z) * how.l1) / ((how.beta + np.sqrt(n)) / how.alpha + how.l2))
    at = np.flatnonzero(w)
    return at.astype(np.int32), w[at], bias


def bounded(labels: DataFrame, id_col: str, label_col: str, how: Ftrl) -> DataFrame:
    """__id and __label of the rows with a label: all of them, or about ``how.most_rows`` by the hash of the id."""
    rows = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__label"))
    share = how.most_rows / max(1, rows.count())
    return rows if share >= 1 else rows.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def _slices(batches, rows: int = 512):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def train(docs: DataFrame, labels: DataFrame, how: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on the documents that ``labels`` (id, 0/1) marks, on about ``how.most_rows`` of them at most.

    The sample of labels has that bound, so it is broadcast and no text is shuffled; features are
    made where the texts are, one task learns from those of the sample (at most 2**BITS numbers a row), and only the weights that L1 leaves
    come to the driver. Rows without a label or a document are left out; a null text is an empty one.
    """
    ship(docs.sparkSession)
    chosen = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).join(F.broadcast(bounded(labels, id_col, label_col, how)), "__id")

    def run(batches):
        for batch in _slices(batches):
            found = features([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([f.tobytes() for f in found], pa.binary())], names=["h", "y", "x"])

    def learn(batches):
        x, y = [], []
        for batch in batches:
            y += batch.column(1).to_pylist()
            x += [np.frombuffer(b, np.int32) for b in batch.column(2).to_pylist()]
        at, weights, bias = fit_ftrl(x, np.array(y), how)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([bias, *weights.tolist()], pa.float64())], names=["at", "w"])

    rows = chosen.select(F.xxhash64("__id").alias("h"), "__text", "__label").mapInArrow(lean(run), "h long, y double, x binary")
    got = rows.repartition(1).sortWithinPartitions("h", "y", "x").mapInArrow(lean(learn), "at int, w double").toPandas()
    if not len(got):
        return fit_ftrl([], np.empty(0), how)
    at, w = got["at"].to_numpy(np.int32), got["w"].to_numpy(np.float64)
    return at[1:], w[1:], float(w[0])


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 for every whole text.

    Defined cases: a null or empty text has the bias alone; a column named ``score_col`` is
    replaced; repeated rows score alike; an empty table gives no rows.
    """
    ship(df.sparkSession)
    keep = df.drop(score_col)
    schema = keep.withColumn(score_col, F.lit(0.0)).schema
    at, weights, bias = model
    shared = df.sparkSession.sparkContext.broadcast((at, weights))

    def run(batches):
        w = np.zeros(1 << BITS)
        w[shared.value[0]] = shared.value[1]
        for batch in _slices(batches):
            texts = [x or b"" for x in batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()]
            out = [1 / (1 + np.exp(-np.clip(bias + w[f].sum(), -35, 35))) for f in features(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, score_col])

    return keep.mapInArrow(lean(run), schema)


def held_out(id_col: Column, modulus: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % modulus == 2


THRESHOLD = 0.3


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = train(docs, labels.where(~held_out(F.col("doc_id"), 4)))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
