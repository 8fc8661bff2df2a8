"""N-gram Jaccard self-join by prefix filters under several global token orders.

A document is the set of its distinct word shingles. Under any order of all tokens that is the same for
every document, two sets of Jaccard similarity t or more share a token among their first
n - ceil(t n) + 1 tokens each. Several orders are used: all put rare tokens first, so shared
passages come last, and break ties by different hashes. The first order's prefixes are an inverted
index; a candidate must also share a prefix token under each of the other orders before it is
verified with the whole sets.

Stages: (1) one scan makes the sets; blobs of tokens go to parts of the token space, which count
documents a token; what is found in two documents or more goes back. (2) Documents of which less
than t of the tokens are shared can't have a partner and are out; equal sets become one node.
(3) Stars: each node is verified against the most typical node of a few of its prefix tokens, then of
all whose nodes are not in one component yet. (4) All prefix tokens whose nodes are not in one component yet give candidates across components:
those of the smaller components against all others, unless what both have in common with one centre
shows that they can't link. No candidate is left out that could join two components, so components are exact; pairs inside a component that is known are never made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import components
from .storage import discard, input_parts, lean, shared_table, ship
from .textnum import hashed_words, mixed, powers

WORDS, PERCENT, ORDERS = 5, 80, 3
#: Tokens and documents that a map task sends off at once; tokens of a row to a part at least, on average; parts at most.
BATCH_TOKENS, BATCH_DOCS, ROW_TOKENS, MOST_PARTS = 1_000_000, 60_000, 64, 1 << 16
#: Rows that are Python objects at once.
ROWS = 256
_LOW = np.uint64((1 << 48) - 1)
_SCHEMA = "part int, batch long, blob binary, ids array<long>, sizes array<int>, prints array<binary>"


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes. A text under k words is one shingle; without words none."""
    words, starts = hashed_words(texts, lower=True)
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    base = 0xD6E8FEB86659FD93
    for i in range(k):
        rolled[: n - i] += words[i:] * np.uint64(pow(base, i + 1, 1 << 64))
    rolled = mixed(rolled)
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            own = words[a:b] * powers(base, int(b - a) + 1)[1:]
            out.append(mixed(np.array([own.sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _send(docs: list[tuple], parts: int, batch: int) -> Iterator[dict]:
    """Rows for the parts (sorted tokens, each with the number of its document) and one for the batch itself."""
    if not docs:
        return
    tokens = np.concatenate([d[1] for d in docs])
    doc = np.repeat(np.arange(len(docs), dtype=np.uint64), [len(d[1]) for d in docs])
    part = ((tokens >> np.uint64(48)) * np.uint64(parts) >> np.uint64(16)).astype(np.uint16)
    packed = (tokens << np.uint64(16)) | doc
    order = np.argsort(part, kind="stable")
    packed, edges = packed[order], np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)):
        yield {"part": int(p), "batch": batch, "blob": np.sort(packed[edges[p] : edges[p + 1]]).tobytes()}
    yield {"part": batch % parts, "batch": batch, "ids": [d[0] for d in docs], "sizes": [len(d[1]) for d in docs], "prints": [d[2] for d in docs]}


def _rows(rows: Iterable[dict], schema: pa.Schema, most: int = 64) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_ARROW = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("blob", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("prints", pa.list_(pa.binary()))])


def _scan(k: int, parts: int):
    most = max(BATCH_TOKENS, ROW_TOKENS * parts)

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def rows():
            nonlocal number
            held, size = [], 0
            for batch in batches:
                ids = batch.column(0).to_pylist()
                texts = [x or b"" for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
                for at in range(0, len(ids), ROWS):
                    for i, s in zip(ids[at : at + ROWS], shingle_sets(texts[at : at + ROWS], k), strict=True):
                        if held and (size + len(s) > most or len(held) >= BATCH_DOCS):
                            yield from _send(held, parts, number)
                            held, size, number = [], 0, number + 1
                        held.append((i, s, hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None))
                        size += len(s)
            yield from _send(held, parts, number)

        yield from _rows(rows(), _ARROW)

    return run


def _grouped(batches, key: int) -> Iterator[list[dict]]:
    """Rows with the same value of a column that stand together."""
    held: list[dict] = []
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            for row in batch.slice(at, ROWS).to_pylist():
                if held and row[key] != held[0][key]:
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def _count(batches):
    """For each part: what a batch has of tokens in two documents or more, with a class of their frequency."""

    def rows():
        for group in _grouped(batches, "part"):
            blobs = [(g["batch"], np.frombuffer(g["blob"], np.uint64)) for g in group if g["blob"] is not None]
            yield from (g | {"blob": None, "classes": None} for g in group if g["blob"] is None)
            if not blobs:
                continue
            known, count = np.unique(np.concatenate([b for _, b in blobs]) >> np.uint64(16), return_counts=True)
            known, count = known[count > 1], count[count > 1]
            if not len(known):
                continue
            classes = np.minimum(255, np.ceil(8 * np.log2(count))).astype(np.uint8)
            for number, b in blobs:
                token = b >> np.uint64(16)
                at = np.minimum(np.searchsorted(known, token), len(known) - 1)
                found = known[at] == token
                if found.any():
                    yield {"part": group[0]["part"], "batch": number, "blob": b[found].tobytes(), "classes": classes[at[found]].tobytes()}

    yield from _rows(rows(), _ARROW.append(pa.field("classes", pa.binary())))


def order_keys(tokens: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """Ranks of tokens under a global order: by frequency class, then by a hash of the order's own."""
    return (classes.astype(np.uint64) << np.uint64(56)) | (mixed(tokens + np.uint64(order * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(8))


def _back(percent: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("print", pa.binary()), ("tokens", pa.binary()), ("classes", pa.binary())])

    def run(batches):
        def rows():
            for group in _grouped(batches, "batch"):
                directory = next(g for g in group if g["ids"] is not None)
                blobs = [g for g in group if g["blob"] is not None]
                packed = np.concatenate([np.frombuffer(g["blob"], np.uint64) for g in blobs]) if blobs else np.empty(0, np.uint64)
                part = np.repeat(np.array([g["part"] for g in blobs], np.uint64), [len(g["blob"]) // 8 for g in blobs])
                classes = np.concatenate([np.frombuffer(g["classes"], np.uint8) for g in blobs]) if blobs else np.empty(0, np.uint8)
                doc = (packed & np.uint64(0xFFFF)).astype(np.uint16)
                tokens = (part << np.uint64(48)) | (packed >> np.uint64(16))
                order = np.argsort(doc, kind="stable")
                tokens, classes = tokens[order], classes[order]
                edges = np.searchsorted(doc[order], np.arange(len(directory["ids"]) + 1))
                seen = set()
                for i, (name, n, mark) in enumerate(zip(directory["ids"], directory["sizes"], directory["prints"], strict=True)):
                    row = {"id": name, "n": n, "print": mark}
                    a, b = edges[i], edges[i + 1]
                    if n and 100 * (b - a) >= percent * n and mark not in seen:
                        seen.add(mark)
                        by = np.argsort(order_keys(tokens[a:b], classes[a:b], 0))
                        row |= {"tokens": tokens[a:b][by].tobytes(), "classes": classes[a:b][by].tobytes()}
                    yield row

        yield from _rows(rows(), schema, 512)

    return run


def _slices(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _postings(percent: int, few: int | None):
    """Prefix tokens of nodes under the first order: all, or the first and last ``few`` shared ones."""
    schema = pa.schema([("token", pa.int64()), ("print", pa.binary()), ("n", pa.int32()), ("u", pa.int32()), ("pos", pa.int32())])

    def run(batches):
        for batch in _slices(batches):
            out = []
            for r in batch.to_pylist():
                tokens = np.frombuffer(r["tokens"], np.int64)
                u = r["n"] - len(tokens)
                own = tokens[: max(0, prefix_length(r["n"], percent) - u)]
                pos = u + np.arange(len(own), dtype=np.int32)
                if few is not None and len(own) > 2 * few:
                    own, pos = (np.concatenate([v[:few], v[-few:]]) for v in (own, pos))
                if not len(own):
                    continue
                same = {k: [r[k]] * len(own) for k in ("print", "n")}
                out.append(pa.RecordBatch.from_pydict(same | {"token": own, "u": [u] * len(own), "pos": pos}, schema))
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return run


def _verify(percent: int, orders: int, all_pairs: bool):
    """Pairs that link; ``all_pairs``: every pair, with its number of common tokens."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("common", pa.int32()), ("linked", pa.bool_())])

    def prefix(tokens, classes, n, order):
        keep = prefix_length(n, percent) - (n - len(tokens))
        keys = order_keys(tokens, classes, order)
        return tokens if keep >= len(tokens) else tokens[np.argpartition(keys, keep - 1)[:keep]] if keep > 0 else tokens[:0]

    def run(batches):
        for batch in _slices(batches):
            out = []
            for r in batch.to_pylist():
                x, y = np.frombuffer(r["tokens"], np.uint64), np.frombuffer(r["tokens_b"], np.uint64)
                cx, cy = np.frombuffer(r["classes"], np.uint8), np.frombuffer(r["classes_b"], np.uint8)
                if all_pairs or all(len(np.intersect1d(prefix(x, cx, r["n"], o), prefix(y, cy, r["n_b"], o), assume_unique=True)) for o in range(1, orders)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked = 100 * common >= percent * (r["n"] + r["n_b"] - common)
                    if linked or all_pairs:
                        out.append({"a": r["a"], "b": r["b"], "common": common, "linked": linked})
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int, orders: int, all_pairs: bool = False) -> DataFrame:
    sets = nodes.select("print", "n", "tokens", "classes")
    first = pairs.join(sets.withColumnRenamed("print", "a"), "a")
    both = first.join(sets.select(F.col("print").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("tokens_b"), F.col("classes").alias("classes_b")), "b")
    return shared_table(both.mapInArrow(lean(_verify(percent, orders, all_pairs)), "a binary, b binary, common int, linked boolean"), "ngram-links")


def _stars(rows: DataFrame) -> DataFrame:
    """Pairs of each node of a posting list and the most typical one of the list, that with the least share of tokens of its own."""
    typical = rows.groupBy("token").agg(F.min(F.struct((F.col("u") / F.col("n")).alias("s"), "print")).alias("t"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return rows.join(typical.select("token", F.col("t.print").alias("b")), "token").select(F.col("print").alias("a"), "b").where("a <> b").distinct()


def _undecided(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Postings of tokens whose nodes are in two components or more, with root and, of the token, major: its largest component."""
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("weight"))
    labels = found.join(sizes, "root").select(F.col("node").alias("print"), F.xxhash64("root").alias("root"), "weight")
    rooted = rows.join(labels, "print", "left").withColumns({"root": F.coalesce("root", F.xxhash64("print")), "weight": F.coalesce("weight", F.lit(1).cast("long"))})
    tokens = rooted.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max(F.struct("weight", "root")).alias("m")).where("r0 <> r1")
    return shared_table(rooted.join(tokens.select("token", F.col("m.root").alias("major")), "token").drop("weight"), "ngram-open")


def ngram_jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """_id, n_shingles and component_id of every row of ``df``.

    Two rows link when 100 * intersection >= ``percent`` * union of their sets of distinct ``words``-word
    shingles (A-Z lower-cased, words between ASCII white space); component_id is the smallest id reachable.

    Defined cases: a null text, or one without words, has an empty set and links with nothing;
    under ``words`` words the whole sequence is one shingle; rows with equal sets link, rows that
    repeat an id stay rows of their own; a null id is no candidate for component_id (a row without
    links then has null); an empty table gives no rows. Other columns are not read.
    """
    ship(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = min(input_parts(docs, 4 << 20), MOST_PARTS)
    sent = docs.mapInArrow(lean(_scan(words, parts)), _SCHEMA)
    counted = sent.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(lean(_count), _SCHEMA + ", classes binary")
    back = counted.repartition(parts, "batch").sortWithinPartitions("batch").mapInArrow(lean(_back(percent)), "id long, n int, print binary, tokens binary, classes binary")
    table = shared_table(back, "ngram-sets")

    kept = table.where("tokens is not null").select("print", "n", "tokens", "classes")
    nodes = shared_table(kept.groupBy("print").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("classes").alias("classes")), "ngram-nodes")
    posted = "token long, print binary, n int, u int, pos int"
    few = nodes.mapInArrow(lean(_postings(percent, 2)), posted)
    measured = _verified(_stars(few), nodes, percent, orders, all_pairs=True)
    links = measured.where("linked").select("a", "b")

    index = shared_table(nodes.mapInArrow(lean(_postings(percent, None)), posted), "ngram-index")
    found = components(links)
    first_open = _undecided(index, found)
    discard(index, found)
    again = _verified(_stars(first_open), nodes, percent, orders, all_pairs=True)
    links = links.union(again.where("linked").select("a", "b"))
    # What each node has in common with its stars' centres; a centre has all of itself.
    near = again.select(F.col("a").alias("print"), F.xxhash64("b").alias("p"), F.col("common").alias("o"))
    own = again.select("b").distinct().join(nodes.select(F.col("print").alias("b"), "n"), "b").select(F.col("b").alias("print"), F.xxhash64("b").alias("p"), F.col("n").alias("o"))
    centres = near.union(own).groupBy("print").agg(F.collect_list(F.struct("p", "o")).alias("centres"))
    found = components(links)
    second_open = _undecided(first_open.select("token", "print", "n", "u", "pos"), found)
    discard(first_open, found)
    open_rows = second_open.join(centres, "print", "left").withColumn("centres", F.coalesce("centres", F.array().cast("array<struct<p:bigint,o:int>>")))
    open_rows = shared_table(open_rows, "ngram-open")
    discard(second_open)
    x, y = open_rows.where("root <> major").alias("x"), open_rows.alias("y")
    # Tokens in common are at most the shared ones of either set; with a common centre, at most those in the
    # centre of either set and those outside it of either set.
    at_centre = "least(c.o, d.o) + greatest(0, least(x.n - x.u - c.o, y.n - y.u - d.o))"
    enough = lambda most: f"100 * ({most}) >= {percent} * (x.n + y.n - ({most}))"
    # Of sets of known sizes, a common token is even among the first n - least + 1 of each.
    least = f"(({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent})"
    cross = (
        x.join(
            y,
            F.expr("x.token = y.token and x.root <> y.root and (y.root = y.major or x.print < y.print)")
            & F.expr(f"x.pos + {least} <= x.n and y.pos + {least} <= y.n")
            & F.expr(enough("least(x.n - x.u, y.n - y.u)"))
            & F.expr(f"not exists(x.centres, c -> exists(y.centres, d -> c.p = d.p and not ({enough(at_centre)})))"),
        )
        .select(F.expr("least(x.print, y.print)").alias("a"), F.expr("greatest(x.print, y.print)").alias("b"))
        .distinct()
    )
    more = _verified(cross, nodes, percent, orders)
    final = components(links.union(more.select("a", "b")))
    discard(nodes, open_rows, measured, again, more)

    least_id = table.groupBy("print").agg(F.min("id").alias("least")).where("print is not null")
    rooted = least_id.join(final.select(F.col("node").alias("print"), "root"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = shared_table(rooted.join(best, "root").select("print", "component_id"), "ngram-components")
    discard(final)
    return (
        table.select("id", "n", "print").join(of_print, "print", "left")
        .select(F.col("id").alias("_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    )


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    out = ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id")
