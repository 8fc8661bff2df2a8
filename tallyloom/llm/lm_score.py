"""Language-model scores by deleted interpolation of n-gram maximum-likelihood estimates.

The probability of a token after a context is a mixture of its relative frequency after that context,
its relative frequency and a uniform share. The mixture weights depend on how often the context
was seen (buckets by powers of two) and are learned by expectation-maximisation on held-out counts: each
training token is held out in turn, that is, one is deleted from each of its counts.

Counts never leave the executors: rows are dealt to buckets; a bucket asks the parts of the key space
for the counts of its distinct n-grams, with what it adds to them; parts add up and answer in
the same order. A hot n-gram costs one entry a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import input_parts, lean, shared_table, ship
from .textnum import hashed_words, mixed

#: Buckets of context counts: 0, 1, 2-3, 4-7, ...; steps of the logarithms of estimates in the held-out counts.
BUCKETS, STEPS, BINS = 26, 8, 400
ROUNDS = 60
_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_KINDS = "bucket long, part int, blob binary, counts binary, tokens long, distinct long"


class _Bucket:
    """The tokens of some texts, and the distinct keys of their unigrams and bigrams in ascending order."""

    def __init__(self, texts: list[bytes]):
        words, starts = hashed_words(texts, lower=True)
        n = np.diff(starts)
        self.starts = starts[:-1] + np.arange(len(texts))
        self.sizes = n + 1
        tokens = np.empty(len(words) + len(texts), np.uint64)
        at_end = np.zeros(len(tokens), bool)
        at_end[self.starts + n] = True
        tokens[~at_end], tokens[at_end] = words, _END
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.starts] = _START
        one = np.uint64(1)
        single = mixed(tokens) & ~one
        double = mixed(before * np.uint64(0xD1342543DE82EF95) + tokens) | one
        self.keys, where = np.unique(np.concatenate([single, double, np.array([mixed(np.array([_END]))[0] & ~one])]), return_inverse=True)
        self.single, self.double, self.end = where[: len(tokens)], where[len(tokens) : -1], where[-1]

    def added(self, train: np.ndarray) -> np.ndarray:
        """How often each key occurs in the texts that are learned from."""
        of_token = np.repeat(train, self.sizes)
        return np.bincount(np.concatenate([self.single[of_token], self.double[of_token]]), minlength=len(self.keys))

    def counted(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of each token after its context, of its context, and of itself."""
        own = counts[self.single]
        context = np.empty_like(own)
        context[1:] = own[:-1]
        context[self.starts] = counts[self.end]
        return counts[self.double], context, own


def _groups(batches, key: str) -> Iterator[pa.Table]:
    """Rows with the same value of a column that stand together, as tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(values)) + 1), len(values)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and held[0].column(key)[0].as_py() != values[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _texts(table: pa.Table) -> list[bytes]:
    return [x or b"" for x in table.column("text").cast(pa.large_binary()).to_pylist()]


_ASK = pa.schema([("bucket", pa.int64()), ("part", pa.int32()), ("blob", pa.binary()), ("counts", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64())])


def _ask(parts: int):
    def run(batches):
        for table in _groups(batches, "bucket"):
            bucket = _Bucket(_texts(table))
            added = bucket.added(np.array(table.column("train").to_pylist(), bool)).astype(np.uint32)
            edges = np.searchsorted(bucket.keys, np.array([-(-(p << 64) // parts) for p in range(1, parts)], np.uint64)) if parts > 1 else np.empty(0, np.int64)
            edges = [0, *edges, len(bucket.keys)]
            name = table.column("bucket")[0].as_py()
            for p in range(parts):
                a, b = edges[p], edges[p + 1]
                if a < b:
                    yield pa.RecordBatch.from_pylist([{"bucket": name, "part": p, "blob": bucket.keys[a:b].tobytes(), "counts": added[a:b].tobytes()}], _ASK)

    return run


def _answer(batches):
    """For each part: total counts in the order of the questions; and a row with its training tokens and distinct ones."""
    for table in _groups(batches, "part"):
        blobs, counts = table.column("blob").to_pylist(), table.column("counts").to_pylist()
        keys = np.concatenate([np.frombuffer(b, np.uint64) for b in blobs])
        known, where = np.unique(keys, return_inverse=True)
        total = np.bincount(where, weights=np.concatenate([np.frombuffer(c, np.uint32) for c in counts])).astype(np.uint64)
        single = total[(known & np.uint64(1)) == 0]
        part, at = table.column("part")[0].as_py(), 0
        for name, blob in zip(table.column("bucket").to_pylist(), blobs, strict=True):
            n = len(blob) // 8
            own = total[where[at : at + n]]
            yield pa.RecordBatch.from_pylist([{"bucket": name, "part": part, "counts": own.astype(np.uint32 if own.max() < 1 << 32 else np.uint64).tobytes(), "blob": n.to_bytes(8, "little")}], _ASK)
            at += n
        yield pa.RecordBatch.from_pylist([{"part": part, "tokens": int(single.sum()), "distinct": int((single > 0).sum())}], _ASK)


def _with_counts(batches) -> Iterator[tuple[pa.Table, _Bucket, np.ndarray]]:
    """The documents of each bucket with the counts of its keys."""
    for table in _groups(batches, "bucket"):
        is_reply = np.array([p is not None for p in table.column("part").to_pylist()])
        replies = table.filter(pa.array(is_reply)).sort_by("part")
        docs = table.filter(pa.array(~is_reply))
        if docs.num_rows:
            found = []
            for size, c in zip(replies.column("blob").to_pylist(), replies.column("counts").to_pylist(), strict=True):
                wide = len(c) // int.from_bytes(size, "little")
                found.append(np.frombuffer(c, np.uint32 if wide == 4 else np.uint64).astype(np.float64))
            yield docs, _Bucket(_texts(docs)), np.concatenate(found)


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count < 1, 0, np.minimum(BUCKETS - 1, 1 + np.log2(np.maximum(count, 1)).astype(np.int64)))


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for probability zero, else steps of its logarithm."""
    return np.where(p > 0, 1 + np.clip(np.round(-STEPS * np.log2(np.maximum(p, 1e-300))), 0, BINS - 2), 0).astype(np.int64)


def _ratio(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    return np.where(b > 0, a / np.maximum(b, 1), 0.0)


def _held_out_counts(n: float):
    """Rows (cell, count): training tokens by context bucket and the two estimates with the token itself deleted."""

    def run(batches):
        cells: dict[int, int] = {}
        for docs, bucket, counts in _with_counts(batches):
            train = np.repeat(np.array(docs.column("train").to_pylist(), bool), bucket.sizes)
            pair, context, own = (x[train] - 1 for x in bucket.counted(counts))
            cell = (context_bucket(context) * BINS + _bin(_ratio(pair, context))) * BINS + _bin(_ratio(own, n - 1))
            for c, k in zip(*np.unique(cell, return_counts=True), strict=True):
                cells[int(c)] = cells.get(int(c), 0) + int(k)
        yield pa.RecordBatch.from_arrays([pa.array(list(cells), pa.int64()), pa.array(list(cells.values()), pa.int64())], names=["cell", "n"])

    return run


def learn_weights(cells: np.ndarray, counts: np.ndarray, uniform: float) -> np.ndarray:
    """EM: for each bucket of context counts the weights of the bigram, unigram and uniform estimates."""
    bucket, double, single = cells // (BINS * BINS), cells // BINS % BINS, cells % BINS
    p = np.stack([np.where(x > 0, 2.0 ** (-(x - 1) / STEPS), 0.0) for x in (double, single)] + [np.full(len(cells), uniform)])
    weights = np.tile([[0.4], [0.5], [0.1]], BUCKETS)
    for _ in range(ROUNDS):
        share = weights[:, bucket] * p
        share *= counts / share.sum(axis=0)
        new = np.stack([np.bincount(bucket, s, BUCKETS) for s in share])
        seen = new.sum(axis=0) > 0
        weights[:, seen] = new[:, seen] / new[:, seen].sum(axis=0)
    weights[0, 0] = 0.0
    weights[2] = np.maximum(weights[2], 1e-9)
    return weights / weights.sum(axis=0)


def _score(n: float, v: float, weights: np.ndarray, schema_names: list[str]):
    def run(batches):
        for docs, bucket, counts in _with_counts(batches):
            pair, context, own = bucket.counted(counts)
            w = weights[:, context_bucket(context)]
            p = w[0] * _ratio(pair, context) + w[1] * _ratio(own, n) + w[2] / (v + 1)
            if n == 0:
                p = np.ones_like(p)
            sums = lambda x: np.add.reduceat(x, bucket.starts)
            yield from pa.table(
                [docs.column("id"), pa.array(~np.array(docs.column("train").to_pylist(), bool)), pa.array(bucket.sizes), pa.array(sums((own > 0).astype(np.int64))), pa.array(sums(np.log10((own + 1) / (n + v + 1)))), pa.array(sums(np.log10(p)))],
                names=schema_names,
            ).to_batches()

    return run


def lm_scores(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``train`` is true for the rows that are learned from. Tokens are the A-Z lower-cased words between
    ASCII white space and one end. base_score adds up log10((c + 1) / (N + V + 1)); score the model's
    log10 probabilities, contexts being the word before or the beginning of the text.

    Defined cases: a null or empty text has the end alone; a null ``train`` counts as held out; null
    and repeated ids are rows of their own, repeated training rows count again; without training
    rows all scores are 0; an empty table gives no rows. Other columns are not read.
    """
    ship(df.sparkSession)
    buckets, parts = input_parts(df.select(text_col), 3 << 19), input_parts(df.select(text_col), 3 << 20)
    docs = df.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(buckets)).alias("bucket"), F.lit(None).cast("int").alias("part"),
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"),
    )
    # One bucket or part to a task, so that none is larger than meant.
    asked = docs.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(lean(_ask(parts)), _KINDS)
    replies = shared_table(asked.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(lean(_answer), _KINDS), "lm-counts")
    n, v = (float(x or 0) for x in replies.where("bucket is null").agg(F.sum("tokens"), F.sum("distinct")).first())
    answered = replies.where("bucket is not null").select("bucket", "part", F.lit(None).cast(docs.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("train"), "blob", "counts")
    both = docs.withColumns({"blob": F.lit(None).cast("binary"), "counts": F.lit(None).cast("binary")}).union(answered)
    both = both.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    cells = both.mapInArrow(lean(_held_out_counts(n)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = shared_table(cells, "lm-held-out").orderBy("cell").toPandas()  # BUCKETS * BINS * BINS rows at most
    weights = learn_weights(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64), 1 / (v + 1))
    schema = docs.select("id", F.lit(True).alias("held_out"), *[F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_known")], *[F.lit(0.0).alias(c) for c in ("base_score", "score")]).schema
    out = both.mapInArrow(lean(_score(n, v, weights, schema.names)), schema)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lm_scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
