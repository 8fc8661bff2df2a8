"""Quality scores of texts: kernel ridge regression over document statistics by random Fourier features, with isotonic calibration.

Statistics of whole texts are standardised and mapped to cosines of random projections, whose products approximate a
Gaussian kernel. Normal equations are sums over rows, so partitions add them up and only sums travel. Out-of-fold scores are counted
in bins, and pooling adjacent violators over the bins turns scores into probabilities.

Features and weights are rounded to binary fractions so coarse that all their sums are exact: results don't depend on
how rows are split.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import lean, shared_table, ship


class Ridge(NamedTuple):
    """Parameters of the learner. ``most_rows`` bounds the labelled rows that it is fitted on; sums are exact up to 2**24 of them."""

    features: int = 384
    width: float = 5.0
    penalty: float = 1e-3
    folds: int = 4
    bins: int = 512
    prior: float = 1.0
    most_rows: int = 1 << 22
    seed: int = 5


#: Steps of statistics, of features and of weights, as bits behind the binary point.
STAT_BITS, FEATURE_BITS, WEIGHT_BITS = 10, 12, 16
#: Rows of features at once.
ROWS = 2048
_KIND = np.zeros(256, np.uint8)  # 1 lower case, 2 upper case, 3 digits, 4 white space, 5 ordinary punctuation, 6 other ASCII, 7 beyond ASCII
_KIND[:128], _KIND[128:] = 6, 7
for _k, _bytes in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, b" \t\n\r\x0b\x0c"), (5, b".,;:'\"?-()")):
    _KIND[list(_bytes)] = _k
_SYMBOLS = b"#$%&*<>|"
STATISTICS = (
    "log_words", "log_lines", "mean_word", "longest_word", "lower", "upper", "digits", "white", "punctuation", "symbols", "beyond_ascii",
    "distinct_words", "top_word", "repeats_last", "repeated_windows", "repeated_lines", "short_words", "words_with_symbols", "upper_words", "line_words", "ends_sentence", "pipes", "exclaimed",
)


def statistics(text: bytes) -> list[float]:
    """The STATISTICS of a whole text; an empty one has zeros."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n = len(words)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=8) / len(text)
    letters = max(1e-9, kinds[1] + kinds[2] + kinds[7])
    found = Counter(words)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        np.log1p(n), np.log1p(len(lines)), lengths.mean() / 4, np.log1p(lengths.max()), 4 * kinds[1], 4 * kinds[2] / letters, 8 * kinds[3], 4 * kinds[4], 8 * kinds[5], 8 * kinds[6], 4 * kinds[7],
        len(found) / n * 4, max(found.values()) / n * 4, sum(map(bytes.__eq__, words, words[1:])) / n * 4, sum(c for c in windows.values() if c > 1) / n * 4, (len(lines) - len(set(lines))) / len(lines) * 4,
        float((lengths <= 3).mean()) * 4, sum(c for w, c in found.items() if w.translate(None, _SYMBOLS) != w) / n * 4,
        sum(c for w, c in found.items() if w.isupper() and len(w) > 1) / n * 4, np.log1p(n / len(lines)), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines) * 4, text.count(b"|") / n * 8, text.count(b"!") / n * 8,
    ]


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and x, the statistics in steps of 2**-STAT_BITS as 16-bit numbers. A null text is an empty one."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            x = []
            for text in batch.column(1).cast(pa.large_binary()):
                x.append(np.clip(np.rint(np.array(statistics(text.as_py() or b"")) * (1 << STAT_BITS)), -32768, 32767).astype(np.int16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["id", "x"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), rows.select("id", F.lit(b"").alias("x")).schema)


class Model(NamedTuple):
    """What scores need: mean and scale of the statistics, weights of the features, and calibration as two ascending lists."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    value: np.ndarray
    how: Ridge


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, len(STATISTICS)).astype(np.float64) / (1 << STAT_BITS)


def _features(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, how: Ridge) -> np.ndarray:
    """Cosines of random projections, and 1, in steps of 2**-FEATURE_BITS."""
    random = np.random.default_rng(how.seed)
    w = random.standard_normal((x.shape[1], how.features)) / (how.width * np.sqrt(x.shape[1] / 8))
    b = random.uniform(0, 2 * np.pi, how.features)
    z = np.cos(np.clip((x - mean) / scale, -4, 4) @ w + b)
    return np.concatenate([np.rint(z * (1 << FEATURE_BITS)) / (1 << FEATURE_BITS), np.ones((len(x), 1))], axis=1)


def _solve(gram: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge weights from the sums of products of features (and, last, of the label)."""
    a, n = gram[:-1, :-1], gram[-2, -2]
    w = np.linalg.solve(a + penalty * max(n, 1) * np.eye(len(a)), gram[:-1, -1])
    return np.rint(w * (1 << WEIGHT_BITS)) / (1 << WEIGHT_BITS)


def isotonic(positive: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ascending means closest to positive / count in least squares: adjacent violators are pooled."""
    blocks: list[list[float]] = []
    for p, c in zip(positive, count, strict=True):
        blocks.append([p, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p1, c1, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p1, blocks[-1][1] + c1, blocks[-1][2] + k]
    return np.repeat([p / c for p, c, _ in blocks], [k for _, _, k in blocks])


def _add_up(schema: list[str]):
    """Sums of the blobs of each fold in this partition."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = np.frombuffer(blob, np.float64)
                total[fold] = total[fold] + m if fold in total else m
        for fold, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=schema)

    return run


def fit(rows: DataFrame, how: Ridge = Ridge()) -> Model:
    """Fit on rows (id, x, label). Without rows all scores are 0.5.

    More than ``how.most_rows`` rows are cut to about so many by the hash of the id. The sums of a partition are a matrix of
    (``how.features`` + 2) squared for each fold; partitions add theirs up in levels, and the model is solved from the last sum.
    """
    rows = rows.where(F.col("label").isNotNull()).select("id", "x", F.col("label").cast("double").alias("label"))
    n = rows.count()
    d = len(STATISTICS)
    if not n:
        return Model(np.zeros(d), np.ones(d), np.zeros(how.features + 1), np.array([0.0]), np.array([0.5]), how)
    if n > how.most_rows:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(how.most_rows / n * (1 << 20)))
    parts = min(n, how.most_rows) // 20_000 + 1
    rows = shared_table(rows.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(how.seed)), F.lit(how.folds)).cast("int")).repartition(parts, "id"), "model-rows")

    def moments(batches):
        total = np.zeros((3, d))
        for batch in batches:
            x = _matrix(batch.column(0))
            total += np.stack([np.full(d, len(x)), x.sum(axis=0), (x * x).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["fold", "sums"])

    def products(mean: np.ndarray, scale: np.ndarray):
        def run(batches):
            size = how.features + 2
            total = np.zeros((how.folds, size, size))
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    z = np.concatenate([_features(_matrix(part.column(0)), mean, scale, how), part.column(1).to_numpy()[:, None]], axis=1)
                    fold = part.column(2).to_numpy()
                    for f in range(how.folds):
                        total[f] += z[fold == f].T @ z[fold == f]
            yield pa.RecordBatch.from_arrays([pa.array(range(how.folds), pa.int32()), pa.array([m.tobytes() for m in total], pa.binary())], names=["fold", "sums"])

        return run

    def summed(df: DataFrame, count: int) -> dict[int, np.ndarray]:
        while count > 1:
            count = -(-count // 16)
            df = df.repartition(count).mapInArrow(lean(_add_up(["fold", "sums"])), "fold int, sums binary")
        return {r.fold: np.frombuffer(r.sums, np.float64) for r in df.mapInArrow(lean(_add_up(["fold", "sums"])), "fold int, sums binary").collect()}

    m = summed(rows.select("x").repartition(parts).mapInArrow(lean(moments), "fold int, sums binary"), parts)[0].reshape(3, d)
    mean = m[1] / m[0]
    scale = np.sqrt(np.maximum(m[2] / m[0] - mean**2, 0))
    scale = np.where(scale > 1e-3, scale, 1.0)
    size = how.features + 2
    grams = summed(rows.select("x", "label", "fold").repartition(parts).mapInArrow(lean(products(mean, scale)), "fold int, sums binary"), parts)
    folds = np.stack([grams.get(f, np.zeros(size * size)).reshape(size, size) for f in range(how.folds)])
    weights = _solve(folds.sum(axis=0), how.penalty)
    others = np.stack([_solve(folds.sum(axis=0) - g, how.penalty) for g in folds])

    def out_of_fold(batches):
        counts = np.zeros((how.bins, 2))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                z = _features(_matrix(part.column(0)), mean, scale, how)
                y = np.einsum("ij,ij->i", z, others[part.column(2).to_numpy()])
                where = _bin(y, how.bins)
                counts += np.stack([np.bincount(where, part.column(1).to_numpy(), how.bins), np.bincount(where, minlength=how.bins)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["fold", "sums"])

    counts = summed(rows.select("x", "label", "fold").repartition(parts).mapInArrow(lean(out_of_fold), "fold int, sums binary"), parts)[0].reshape(-1, 2)
    seen = np.flatnonzero(counts[:, 1])
    share = counts[:, 0].sum() / counts[:, 1].sum()
    prior = how.prior / len(seen)  # rows of the average label that are spread over the bins
    value = isotonic(counts[seen, 0] + prior * share, counts[seen, 1] + prior)
    return Model(mean, scale, weights, (seen + 0.5) / how.bins * 2 - 0.5, value, how)


def _bin(score: np.ndarray, bins: int) -> np.ndarray:
    """Bins of ridge scores from -0.5 to 1.5; lower and higher ones are in the first and last."""
    return np.clip(((score + 0.5) / 2 * bins).astype(np.int64), 0, bins - 1)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """id and score, the calibrated probability of label 1, of rows (id, x)."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                y = _features(_matrix(part.column(1)), m.mean, m.scale, m.how) @ m.weights
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.interp(y, m.at, m.value), pa.float64())], names=["id", "score"])

    return stats.select("id", "x").mapInArrow(lean(run), stats.select("id", F.lit(0.0).alias("score")).schema)


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", how: Ridge = Ridge()) -> DataFrame:
    """id and score of every row of ``df``, learned from those that ``labels`` (id, 0/1) marks.

    Defined cases: a null or empty text has statistics of zero and the score of those; repeated rows score alike, and count
    again where they are labelled; a row that several labels mark counts for each; labels that are null or without a document are left out; without labels
    all scores are 0.5; an empty table gives no rows. Other columns are not read.
    """
    stats = shared_table(document_statistics(df, id_col, text_col), "model-statistics")
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    model = fit(stats.join(marked, "id"), how)
    return score(stats, model).withColumnRenamed("id", id_col)


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


THRESHOLD = 0.3


def op12_quality_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    out = quality_scores(docs, labels.where(~held_out(F.col("doc_id"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
