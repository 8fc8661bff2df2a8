"""Training-order materialisation of token sequences as fixed-stride binary shards.

Every text's ids and an end token are cut into sequences of ``length`` ids, the last one padded. Sequences are
numbered in the order of a hash of their document, so numbers depend on the rows alone, not on how Spark
splits them. A keyed Feistel permutation of the numbers, with cycle-walking for counts that are no power
of two, gives each its global slot. Shard s holds slots s * per_shard to (s + 1) * per_shard - 1 in
order, one record each: ``length`` little-endian 16-bit ids and a line feed, so record k of a shard
begins at byte k * stride and a reader can begin at any slot.
"""

from __future__ import annotations

import base64
import uuid
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import freed_shuffles, input_parts, lean, shared_dir, shared_table, ship
from .textnum import mixed

#: The end token and the padding, free in the vocabulary; rounds of the permutation.
END, PAD, ROUNDS = 50256, 50257, 6
#: Ranges of the hash that documents are numbered within; their sizes, a row each, are broadcast.
RANGES = 1 << 16


class Layout(NamedTuple):
    """``waves``: parts of the slots that are shuffled and written one after the other."""

    length: int = 512
    per_shard: int = 16_384
    waves: int = 3
    key: int = 0x5EED

    @property
    def stride(self) -> int:
        return 2 * self.length + 1


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 to n - 1: balanced Feistel rounds on the least even number of bits, walked until inside."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key % (1 << 64)))

    def once(v):
        left, right = v >> half, v & mask
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & mask)
        return (left << half) | right

    out = once(x.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str):
    """The ranks file of a byte-level BPE, read once in each Python worker; special tokens are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sequences(ids: list[int], length: int) -> np.ndarray:
    """Rows of ``length`` 16-bit ids: those of a text, an end token, padding."""
    own = np.array(ids, np.int64)
    if len(own) and own.max() > 0xFFFF:
        raise ValueError("records hold 16-bit ids")
    out = np.full(-(-(len(own) + 1) // length) * length, PAD, "<u2")
    out[: len(own)] = own
    out[len(own)] = END
    return out.reshape(-1, length)


def _cut(path: str, layout: Layout):
    """Sequences of the texts, numbered within each range of the hash; a range's rows come one after the other."""
    names = ["id", "seq", "n_tokens", "range", "number", "record"]
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())

    def run(batches):
        number, last, bpe = 0, None, encoding(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [x or b"" for x in part.column(1).cast(pa.large_binary()).to_pylist()]
                rows: list[list] = [[], [], [], [], [], []]
                for i, (text, own) in enumerate(zip(texts, part.column(2).to_pylist(), strict=True)):
                    if own != last:
                        number, last = 0, own
                    ids = bpe.encode_ordinary(text.decode("utf-8", "replace"))
                    cut = sequences(ids, layout.length)
                    n = len(cut)
                    sizes = np.minimum(layout.length, len(ids) + 1 - np.arange(n) * layout.length)
                    for column, values in zip(rows, ([i] * n, range(n), sizes.tolist(), [own] * n, range(number, number + n), [r.tobytes() for r in cut]), strict=True):
                        column.extend(values)
                    number += n
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[0])), *(pa.array(v, t) for v, t in zip(rows[1:], types, strict=True))], names=names)

    return lean(run)


def _slots(n: int, layout: Layout):
    """Rows with the slot of their number (the last column) in its place."""

    def run(batches):
        for batch in batches:
            slot = feistel(batch.column("number").to_numpy(), n, layout.key) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(slot, pa.int64())], names=[*batch.schema.names[:-1], "slot"])

    return run


def write_shards(df: DataFrame, path: str | None = None, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", layout: Layout = Layout()) -> tuple[str, DataFrame]:
    """Write the shards of a table's texts; returns their folder and the manifest.

    The manifest has one row a sequence: _id, seq, n_tokens (without padding), slot, shard, offset (its
    record's first byte in the shard). Without ``path`` a new folder of the shared one is taken. The same rows
    and layout give the same slots on every cluster, so a read can resume from a slot after the shards were written anew.

    Defined cases: a null or empty text is one sequence with the end token alone; repeated rows and
    null ids have sequences of their own; an empty table gives no shards and an empty manifest. Other columns are not read.
    """
    spark = df.sparkSession
    ship(spark)
    path = path or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    parts = min(RANGES, input_parts(docs))
    hashed = docs.withColumn("order", F.xxhash64("id", "text")).withColumn("range", F.shiftrightunsigned("order", 48).cast("int"))
    dealt = hashed.repartitionById(parts, F.expr(f"cast(range * bigint({parts}) div {RANGES} as int)")).sortWithinPartitions("range", "order", "id")
    cut = shared_table(dealt.select("id", "text", "range").mapInArrow(_cut(tokenizer or byte_bpe_path(), layout), f"id {kind}, seq int, n_tokens int, range int, number long, record binary"), "shards-sequences")
    sizes = cut.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("start"))  # RANGES rows at most
    starts = F.broadcast(shared_table(starts, "shards-starts"))
    total = cut.count()
    numbered = cut.join(starts, "range").withColumn("number", F.col("number") + F.col("start"))
    shards = -(-total // layout.per_shard)
    per_wave = -(-shards // layout.waves)
    for wave, first in enumerate(range(0, shards, max(1, per_wave))):
        rows = numbered.select("record", "number").mapInArrow(_slots(total, layout), "record binary, slot long").withColumn("shard", F.expr(f"slot div {layout.per_shard}"))
        rows = rows.where((F.col("shard") >= first) & (F.col("shard") < first + per_wave))
        # ranges of slots: a shard is a partition of its own
        rows = rows.repartitionById(min(per_wave, shards - first), (F.col("shard") - first).cast("int")).sortWithinPartitions("shard", "slot")
        with freed_shuffles(spark):
            rows.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(f"{path}/wave={wave}")
    manifest = numbered.select("id", "seq", "n_tokens", "number").mapInArrow(_slots(total, layout), f"id {kind}, seq int, n_tokens int, slot long")
    return path, manifest.select(
        F.col("id").alias("_id"), "seq", "n_tokens", "slot", F.expr(f"slot div {layout.per_shard}").alias("shard"), (F.col("slot") % layout.per_shard * layout.stride).alias("offset")
    )


def read_shards(spark, path: str, layout: Layout = Layout(), from_slot: int = 0) -> DataFrame:
    """slot and record (binary, 16-bit ids) from a slot on, in any order; shards before it are not opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    shard = F.regexp_extract("path", r"shard=(\d+)", 1).cast("long")
    files = files.where((shard + 1) * layout.per_shard > from_slot)
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"length div {layout.stride}") - 1)).alias("k")
    rows = files.select(shard.alias("shard"), "content", k)
    return rows.select((F.col("shard") * layout.per_shard + F.col("k")).alias("slot"), F.expr(f"substring(content, cast(k * {layout.stride} + 1 as int), {2 * layout.length})").alias("record")).where(F.col("slot") >= from_slot)


def op9_token_shards(spark, sf_dir: str) -> DataFrame:
    _, manifest = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return manifest.withColumnRenamed("_id", "doc_id")
