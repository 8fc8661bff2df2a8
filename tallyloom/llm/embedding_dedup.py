"""Near-duplicate vectors by an inverted multi-index.

Each half of a vector has a codebook of its own; the pair of nearest codewords is its cell in the product
grid. A query visits cells in the order of the sum of its two distances (the multi-sequence order)
until the sum is ``slack`` above its nearest cell's, and pairs are found if either vector visits the other's cell. The slack is the least at which
the target share is found of partners at exactly the threshold, whatever components they differ in, and of the links that a
sample of the table's own vectors has, which are worked out by comparing them with all vectors.
What the visited cells hold is verified with cosines in double precision.

Neighbouring cells of one first codeword are dealt to places of ``chunk`` vectors, a cell with more is dealt to several; a query
is sent once to each place with a cell to visit, so nothing is gathered but one place's vectors, and vectors of cells that a
query doesn't visit are compared only where they share a place. Tasks return counts and a spanning forest of the links, not the links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import components
from .storage import discard, lean, meet, shared_table, ship

THRESHOLD = 0.9


class Index(NamedTuple):
    """``most_rows`` bounds the sample that codebooks and slack are fitted on, ``most_words`` the codewords of a half (their number
    grows with the root of the table up to it); ``chunk`` is the vectors compared at once, ``queries`` those compared with all to measure recall."""

    most_rows: int = 20_000
    most_words: int = 2048
    target_recall: float = 0.97
    chunk: int = 2048
    rounds: int = 8
    queries: int = 256


class Codebooks(NamedTuple):
    first: np.ndarray
    second: np.ndarray
    slack: float

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves of unit vectors to all codewords, less the half's own square."""
        h = x.shape[1] // 2
        return tuple((c * c).sum(1)[None, :] - 2 * np.einsum("ij,kj->ik", np.ascontiguousarray(x[:, s]), c) for c, s in ((self.first, slice(0, h)), (self.second, slice(h, None))))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rounds: int, random: np.random.Generator) -> np.ndarray:
    c = x[random.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def fit(sample: np.ndarray, rows: int, threshold: float, how: Index, seed: int = 5) -> Codebooks:
    """Codebooks of unit vectors, of a size that grows with the root of the table, and the slack of the target recall."""
    random = np.random.default_rng(seed)
    h = sample.shape[1] // 2
    k = int(min(how.most_words, max(1, len(sample) // 8), max(4, 2 ** np.ceil(np.log2(np.sqrt(max(rows, 1)) / 4)))))
    books = Codebooks(_kmeans(sample[:, :h], k, how.rounds, random), _kmeans(sample[:, h:], k, how.rounds, random), 0.0)
    x = sample[random.choice(len(sample), min(len(sample), 4000), replace=False)]
    need = [np.quantile(needed_slack(books, x, y), how.target_recall) for y in partners(x, threshold, random)]
    return books._replace(slack=float(max(need)) + 1e-9)


def needed_slack(books: Codebooks, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The slack at which x[i] and y[i] find each other: the less of what either needs to visit the other's cell."""
    need, at = [], np.arange(len(x))
    for a, b in ((x, y), (y, x)):
        (p, q), (u, v) = books.distances(a), books.distances(b)
        need.append(p[at, u.argmin(1)] + q[at, v.argmin(1)] - p.min(1) - q.min(1))
    return np.minimum(*need)


def partners(x: np.ndarray, threshold: float, random: np.random.Generator) -> Iterator[np.ndarray]:
    """Vectors with cosine ``threshold`` to x[i] that differ in all components, in either half, in runs of eight, or towards another of x."""
    n, d = x.shape
    free = random.standard_normal(x.shape)
    yield _moved(x, free, threshold)
    for part in (slice(0, d // 2), slice(d // 2, d)):
        yield _moved(x, _only(free, part), threshold)
    yield _moved(x, x[random.permutation(n)] - x, threshold)
    run = max(1, min(8, d // 2))
    for at in range(0, d - run + 1, run):
        yield _moved(x, _only(free, slice(at, at + run)), threshold)


def _only(off: np.ndarray, part: slice) -> np.ndarray:
    out = np.zeros_like(off)
    out[:, part] = off[:, part]
    return out


def _moved(x: np.ndarray, off: np.ndarray, threshold: float) -> np.ndarray:
    """x moved along ``off``, either way, until the cosine to where it was is ``threshold``; where nothing gets that far, as far as ``off`` goes."""
    along = (off * x).sum(1, keepdims=True)
    across = np.sqrt(np.maximum((off * off).sum(1, keepdims=True) - along**2, 1e-24))
    tangent = np.sqrt(max(0.0, 1 - threshold**2)) / threshold
    return unit(x + np.where(along > 0, -off, off) * (tangent / (across + tangent * np.abs(along))))


def traversal(books: Codebooks, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The cells that each vector visits, by first codeword: i, the vectors that come to it, and an array (vectors, second codewords) of visits.

    The multi-sequence order goes through pairs of codewords by the sum of their distances. It ends where the sum is ``slack`` above the
    least, so a vector visits exactly the cells up to there; those whose first codeword alone is too far are never looked at.
    """
    p, q = books.distances(x)
    least = q.min(1)
    room = p.min(1) + least + books.slack
    come = p + least[:, None] <= room[:, None]
    for i in np.flatnonzero(come.any(0)):
        at = np.flatnonzero(come[:, i])
        yield int(i), at, p[at, i : i + 1] + q[at] <= room[at, None]


class Places(NamedTuple):
    """Where the vectors of a cell are: the place of each cell with vectors (-1: none), and how many places a large cell has."""

    first: np.ndarray
    many: np.ndarray

    @property
    def number(self) -> int:
        return int((self.first + self.many).max(initial=0))


def placed_cells(counts: np.ndarray, chunk: int) -> Places:
    """Cells with vectors in the order of the grid, as many to a place as fit ``chunk``; a place never has cells of two first codewords."""
    first, many = np.full(counts.shape, -1, np.int64), np.ones(counts.shape, np.int64)
    place = 0
    for i in range(len(counts)):
        held = 0
        for j in np.flatnonzero(counts[i]):
            n = int(counts[i, j])
            if held and held + n > chunk:
                place, held = place + 1, 0
            first[i, j] = place
            held += n
            if n > chunk:
                many[i, j] = -(-n // chunk)
                place, held = place + int(many[i, j]), 0
        place += held > 0
    return Places(first, many)


def _decoded(column, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1).astype(np.float64)


def _prepare(dtype: str):
    """id, dim, print and vec of each row; print and vec are null where it links with nothing. Vectors of one component are their sign."""

    def run(batches):
        for batch in batches:
            blobs, marks, dims = [], [], []
            for v in batch.column(1).to_pylist():
                blob = None
                if v and None not in v:
                    x = np.array(v, dtype)
                    if np.isfinite(x).all() and x.any() and np.isfinite(n := float(np.linalg.norm(x.astype(np.float64)))) and n > 0:
                        blob = (np.sign(x) if len(x) == 1 else x).tobytes()
                blobs.append(blob)
                dims.append(len(v) if v else 0)
                marks.append(None if blob is None else hashlib.blake2b(blob, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(marks, pa.binary()), pa.array(blobs, pa.binary())], names=["id", "dim", "print", "vec"])

    return lean(run)


def _assign(books: Codebooks, dtype: str):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p, q = books.distances(unit(_decoded(batch.column(1), dtype)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.argmin(1), pa.int32()), pa.array(q.argmin(1), pa.int32())], names=[*batch.schema.names, "i", "j"])

    return run


def _deal(books: Codebooks, dtype: str, places):
    """Rows for the places (a broadcast): each vector once to be found (asks false) and once for each place that it visits."""
    names = ["place", "asks", "print", "vec", "m", "i", "j", "visits"]

    def run(batches):
        first, many = places.value
        for batch in batches:
            if not batch.num_rows:
                continue
            prints, vecs, m = batch.column("print").to_pylist(), batch.column("vec").to_pylist(), batch.column("m").to_numpy()
            i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
            mark = np.array([int.from_bytes(p[:8], "little") for p in prints], np.uint64)
            own = first[i, j] + (mark % many[i, j].astype(np.uint64)).astype(np.int64)
            rows = lambda place, asks, at, visits: pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(np.full(len(at), asks)), pa.array([prints[k] for k in at], pa.binary()), pa.array([vecs[k] for k in at], pa.binary()), pa.array(m[at], pa.int64()), pa.array(i[at], pa.int32()), pa.array(j[at], pa.int32()), pa.array(visits, pa.binary())], names=names)
            yield rows(own, False, np.arange(len(i)), [None] * len(i))
            for word, come, visits in traversal(books, unit(_decoded(batch.column("vec"), dtype))):
                filled = np.flatnonzero(first[word] >= 0)
                if not len(filled):
                    continue
                packed = [np.packbits(v).tobytes() for v in visits]
                spots = first[word, filled]
                starts = np.flatnonzero(np.diff(spots, prepend=-1))
                asked = np.logical_or.reduceat(visits[:, filled], starts, axis=1)
                for c, k in enumerate(starts):
                    at = np.flatnonzero(asked[:, c])
                    if len(at):
                        # a large cell shares no place with others after it
                        last = filled[(starts[c + 1] if c + 1 < len(starts) else len(filled)) - 1]
                        for place in range(spots[k], first[word, last] + many[word, last]):
                            yield rows(np.full(len(at), place), True, come[at], [packed[t] for t in at])

    return lean(run)


def _compare(books: Codebooks, dtype: str, threshold: float):
    """Per chunk: rows (a, n) of links counted for a, and (a, b) of a spanning forest of them."""
    names = ["a", "b", "n"]
    k = len(books.second)

    def out(a, b, n):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=names)

    def asked(place: _Place, ask: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Links of some askers with the vectors of their place."""
        x, prints = place.x, place.prints
        y, names_y = unit(_decoded(ask.column("vec"), dtype)), ask.column("print").to_pylist()
        may = np.unpackbits(np.frombuffer(b"".join(ask.column("visits").to_pylist()), np.uint8).reshape(len(y), -1), axis=1)[:, :k].astype(bool)
        marks_y = np.array([int.from_bytes(b[:8], "little") for b in names_y], np.uint64)
        linked = (y @ x.T >= threshold) & may[:, place.j] & (marks_y[:, None] != place.marks[None, :])
        yy, xx = np.nonzero(linked)
        if not len(yy):
            return
        # found from the other side as well: then each side counts its own
        iy, jy = ask.column("i").to_numpy()[yy], ask.column("j").to_numpy()[yy]
        one_way = place.p[xx, iy] + place.q[xx, jy] > place.room[xx]
        np.add.at(place.more, xx[one_way], ask.column("m").to_numpy()[yy[one_way]])
        n = np.zeros(len(y), np.int64)
        np.add.at(n, yy, place.m[xx])
        has = np.flatnonzero(n)
        yield out([names_y[t] for t in has], [None] * len(has), n[has])
        edges_a, edges_b, label = [], [], place.label
        for t, found in zip(has, np.split(xx, np.flatnonzero(np.diff(yy)) + 1), strict=True):
            edges_a.append(names_y[t])
            edges_b.append(prints[found[0]])
            own = np.unique(label[found])
            if len(own) > 1:
                edges_a += [prints[found[0]]] * (len(own) - 1)
                edges_b += [prints[g] for g in own if g != label[found[0]]]
                label[np.isin(label, own)] = own[0]
        yield out(edges_a, edges_b, [0] * len(edges_a))

    def left(place: _Place | None) -> Iterator[pa.RecordBatch]:
        has = np.flatnonzero(place.more) if place else []
        if len(has):
            yield out([place.prints[t] for t in has], [None] * len(has), place.more[has])

    def run(batches):
        """Of each place the vectors come first, then those that ask, who are taken in slices."""
        number, held, place = None, [], None
        for batch in batches:
            keys = list(zip(batch.column("place").to_pylist(), batch.column("asks").to_pylist(), strict=True))
            edges = [0, *(t for t in range(1, len(keys)) if keys[t] != keys[t - 1]), len(keys)]
            for a, b in pairwise(edges if keys else []):
                if keys[a][0] != number:
                    yield from left(place)
                    number, held, place = keys[a][0], [], None
                if not keys[a][1]:
                    held.append(batch.slice(a, b - a))
                    continue
                if held and place is None:
                    place = _place(pa.Table.from_batches(held), books, dtype)
                for s in range(a, b if place else a, 1024):
                    yield from asked(place, batch.slice(s, min(1024, b - s)))
        yield from left(place)

    return run


class _Place(NamedTuple):
    """The vectors of a place, with what links have been counted for them and which of them are known to be connected."""

    x: np.ndarray
    prints: list[bytes]
    m: np.ndarray
    j: np.ndarray
    p: np.ndarray
    q: np.ndarray
    room: np.ndarray
    marks: np.ndarray
    label: np.ndarray
    more: np.ndarray


def _place(held: pa.Table, books: Codebooks, dtype: str) -> _Place:
    x, prints = unit(_decoded(held.column("vec"), dtype)), held.column("print").to_pylist()
    p, q = books.distances(x)
    marks = np.array([int.from_bytes(b[:8], "little") for b in prints], np.uint64)
    return _Place(x, prints, held.column("m").to_numpy(), held.column("j").to_numpy(), p, q, p.min(1) + q.min(1) + books.slack, marks, np.arange(len(x)), np.zeros(len(x), np.int64))


#: Steps of the slack in which recall is measured; squared distances of unit vectors' halves sum to 4 at most.
_STEPS, _MOST = 4096, 8.0


def _measure(books: Codebooks, dtype: str, threshold: float, queries):
    """Rows (step, n): links of the queries (a broadcast) with these vectors by the slack that finds them."""

    def run(batches):
        prints, x = queries.value
        counts = np.zeros(_STEPS + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                y, names = unit(_decoded(part.column(1), dtype)), part.column(0).to_pylist()
                a, b = np.nonzero(x @ y.T >= threshold)
                other = np.array([prints[s] != names[t] for s, t in zip(a, b, strict=True)], bool)
                a, b = a[other], b[other]
                for s in range(0, len(a), 2048):
                    need = needed_slack(books, x[a[s : s + 2048]], y[b[s : s + 2048]])
                    np.add.at(counts, np.clip(np.ceil(need / _MOST * _STEPS), 0, _STEPS).astype(np.int64), 1)
        step = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(step, pa.int32()), pa.array(counts[step], pa.int64())], names=["step", "n"])

    return run


def widened(books: Codebooks, nodes: DataFrame, sample: list[tuple[bytes, bytes]], dtype: str, threshold: float, how: Index) -> tuple[Codebooks, dict]:
    """The slack raised until it finds the target share of the links that the first ``how.queries`` of the sample have in the whole table.

    Also the figures: pairs compared by brute force, their recall, and the slack before and after.
    """
    chosen = sample[: how.queries]
    queries = nodes.sparkSession.sparkContext.broadcast(([p for p, _ in chosen], unit(np.frombuffer(b"".join(v for _, v in chosen), dtype).reshape(len(chosen), -1).astype(np.float64))))
    steps = nodes.select("print", "vec").mapInArrow(lean(_measure(books, dtype, threshold, queries)), "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).toPandas().sort_values("step")
    total, before = int(steps["n"].sum()), books.slack
    if total:
        reached = steps["step"].to_numpy()[np.searchsorted(steps["n"].cumsum().to_numpy(), how.target_recall * total)]
        books = books._replace(slack=max(before, reached * _MOST / _STEPS + 1e-9))
    found = int(steps["n"][steps["step"] * _MOST / _STEPS <= books.slack].sum())
    return books, {"pairs": total, "recall": found / total if total else 1.0, "slack_before": before, "slack": books.slack}


def _links(nodes: DataFrame, dtype: str, threshold: float, how: Index, report: list[dict] | None) -> DataFrame | None:
    """Rows (a, b, n) of links among vectors of one length, two components or more; None where there are under two."""
    spark = nodes.sparkSession
    n = nodes.count()
    share = how.most_rows / max(1, n)
    sample = (nodes if share >= 1 else nodes.where(F.pmod(F.xxhash64("print"), F.lit(1 << 20)) < int(share * (1 << 20)))).select("print", "vec").toPandas().sort_values("print")
    if len(sample) < 2:
        return None
    books = fit(unit(np.frombuffer(b"".join(sample["vec"]), dtype).reshape(len(sample), -1).astype(np.float64)), n, threshold, how)
    books, figures = widened(books, nodes, list(zip(sample["print"], sample["vec"], strict=True)), dtype, threshold, how)
    if report is not None:
        report.append({"vectors": n, "length": books.first.shape[1] + books.second.shape[1], **figures})
    placed = shared_table(nodes.select("print", "vec", "m").mapInArrow(lean(_assign(books, dtype)), "print binary, vec binary, m long, i int, j int"), "embedding-cells")
    counts = np.zeros((len(books.first), len(books.second)), np.int64)
    cells = placed.groupBy("i", "j").agg(F.count(F.lit(1)).alias("c")).toPandas()  # most_words ** 2 rows at most
    counts[cells["i"], cells["j"]] = cells["c"]
    places = placed_cells(counts, how.chunk)
    shared = spark.sparkContext.broadcast((places.first, places.many))
    dealt = placed.mapInArrow(_deal(books, dtype, shared), "place long, asks boolean, print binary, vec binary, m long, i int, j int, visits binary")
    tasks = min(max(places.number, spark.sparkContext.defaultParallelism), 1 << 20)
    found = dealt.repartitionById(tasks, F.expr(f"cast(place % {tasks} as int)")).sortWithinPartitions("place", "asks")
    return shared_table(found.mapInArrow(lean(_compare(books, dtype, threshold)), "a binary, b binary, n long"), "embedding-links")


def embedding_near_dups(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, how: Index = Index(), report: list[dict] | None = None) -> DataFrame:
    """_id, n_links, component_id and kept of every row of ``df``.

    Two rows link if the cosine of their vectors is ``threshold`` or more, in double precision; n_links counts
    the other rows linked directly, component_id is the least id reachable, kept says that it is the row's own. ``report`` gets
    a dictionary for each length of vectors: how many there are, and the recall measured for it against brute force.

    Defined cases: vectors that are null, zero, empty or with null or non-finite components link with nothing;
    vectors of different lengths don't link (an index is made for each length); those of one component link if their signs are
    equal; equal vectors are copies that all link; rows that repeat an id are rows of their own; a null id is no candidate for
    component_id, and a row with one is kept if it links with nothing; an empty table gives no rows. Other columns are not read.
    """
    spark = df.sparkSession
    ship(spark)
    dtype = "f4" if "float" in df.schema[vector_col].dataType.simpleString() else "f8"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    table = shared_table(rows.mapInArrow(_prepare(dtype), "id long, dim int, print binary, vec binary"), "embedding-rows")
    nodes = shared_table(table.where("print is not null").groupBy("dim", "print").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("m"), F.min("id").alias("least")), "embedding-nodes")
    found = spark.createDataFrame([], "a binary, b binary, n long")
    for d in sorted(r.dim for r in nodes.where("dim > 1").select("dim").distinct().collect()):  # one row a length
        more = _links(nodes.where(F.col("dim") == d), dtype, threshold, how, report)
        found = found if more is None else found.unionByName(more)
    linked = found.where("b is null").groupBy(F.col("a").alias("print")).agg(F.sum("n").alias("links"))
    forest = components(found.where("b is not null").select("a", "b"))
    roots = forest.select(F.col("node").alias("print"), "root")
    info = nodes.select("print", "m", "least").join(linked, "print", "left").join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    best = shared_table(info.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("w")), "embedding-roots")
    info = meet(info, best, ["root"], "w", nodes.count())
    info = shared_table(info.select("print", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", "m"), "embedding-components")
    discard(nodes, forest)
    bad = table.where("print is null").select("id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    good = meet(table.where("print is not null").select("id", "print"), info, ["print"], "m", table.count())
    out = good.select("id", "n_links", "component_id").unionByName(bad)
    out = out.select(F.col("id").alias("_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.when(F.col("_id").isNull(), F.col("n_links") == 0).otherwise(F.col("_id").eqNullSafe(F.col("component_id"))))


def measured_recall(df: DataFrame, links: DataFrame, queries: int = 200, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> float:
    """Share of the links of ``queries`` rows, found by comparing them with all rows in blocks, that ``links`` (_id and n_links) has.

    The queries are those with the least hashes of their ids, so their number bounds what is broadcast. 1 where they have no links.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    good = rows.where("id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(v, x -> x <> 0)")
    asked = good.orderBy(F.xxhash64("id"), "id").limit(queries).collect()
    if not asked:
        return 1.0
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(r.v) for r in asked}:
        own = [r for r in asked if len(r.v) == d]
        by_length[d] = np.array([r.id for r in own]), unit(np.array([r.v for r in own], np.float64))
    shared = spark.sparkContext.broadcast(by_length)

    def run(batches):
        count: dict[int, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = [v for v in batch.column(0).slice(at, 2048).to_pylist()]
                for d, (ids, x) in shared.value.items():
                    y = [v for v in part if len(v) == d]
                    if y:
                        for i, n in zip(ids.tolist(), (x @ unit(np.array(y, np.float64)).T >= threshold).sum(1).tolist(), strict=True):
                            count[i] = count.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int64()), pa.array(list(count.values()), pa.int64())], names=["id", "n"])

    exact = good.select("v").mapInArrow(lean(run), "id long, n long").groupBy("id").agg((F.sum("n") - 1).alias("n"))
    both = exact.join(links.select(F.col("_id").alias("id"), "n_links"), "id").agg(F.sum("n").alias("n"), F.sum(F.least("n", "n_links")).alias("found")).first()
    return float(both.found / both.n) if both.n else 1.0


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_near_dups(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("_id", "vec_id")
