"""Removal of repeated strings with suffix arrays built by two-stage sorting.

A text is a sequence of places: its UTF-8 bytes, or its words. Every string of ``least`` places picks the smallest
hash of the ``anchor``-place strings in it (the first of equals). Equal strings pick at the same place, so they
meet in the group of that hash; all strings that picked one place form a segment. Segments of a group that are equal
are repeats as a whole. Where a group has different segments, one of each is laid out, a suffix array of them is
built, and common prefixes of neighbouring suffixes of ``least`` places or more mark the repeated strings.

Only suffixes that begin a string are sorted, and those that the second stage needs to place them. A word is
three codes of a suffix array, numbered by the words that the array holds.

Large groups are split: strings are dealt by the distance to their anchor in steps, and by the content that all
strings of a step have in common, so only strings that may be equal stay together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, input_parts, lean, meet, shared_table, ship
from .textnum import _CODE, hashed_words, mixed, word_edges


class Unit(NamedTuple):
    """What strings are made of. ``across``: they must also start in another document, not just elsewhere."""

    name: str
    least: int
    anchor: int
    step: int
    across: bool

    @property
    def words(self) -> bool:
        return self.name == "words"

    @property
    def width(self) -> int:
        """Codes of a place in a suffix array."""
        return 3 if self.words else 1


BYTES = Unit("bytes", 400, 64, 16, False)
#: Passages of over 50 words.
WORDS = Unit("words", 51, 8, 4, True)
#: Different segments above which a group is split.
LARGE = 512
#: Bytes of texts and places of sequences that are hashed at once, codes that one suffix array holds at least, rows in memory.
CHUNK, BLOCK, ARRAY, ROWS = 1 << 19, 1 << 19, 256 << 10, 256
_B1 = 0x9E3779B97F4A7C15 | 1


def _window_hashes(code: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hashes of all n-place strings by doubling; n is a power of two."""
    h, width = code.copy(), 1
    while width < n:
        h = h[:-width] * np.uint64(pow(base, width, 1 << 64)) + h[width:]
        width *= 2
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all runs of w: prefix minima and suffix minima of blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def segments(places: np.ndarray, sizes: np.ndarray, unit: Unit) -> tuple[np.ndarray | list[bytes], ...]:
    """Segments of sequences of ``least`` places or more, bytes or hashes of words, one after the other in ``places``.

    Gives the sequence's number, first and last start of a string, the anchor's place, its hash and the segment's digest.
    """
    begin = np.cumsum(sizes) - sizes
    code = places if unit.words else _CODE[places]
    anchors = mixed(_window_hashes(code, unit.anchor, _B1))
    bits = np.uint64(max(1, int(len(code)).bit_length()))
    place = np.arange(len(anchors), dtype=np.uint64)
    best = _sliding_min((anchors >> bits << bits) | place, unit.least - unit.anchor + 1)
    pick = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    own = np.repeat(np.arange(len(sizes)), sizes)[: len(pick)]
    inside = np.arange(len(pick)) + unit.least <= (begin + sizes)[own]
    first, last = inside.copy(), inside.copy()
    changes = (pick[1:] != pick[:-1]) | (own[1:] != own[:-1])
    first[1:] &= changes
    last[:-1] &= changes | ~inside[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    digests = _digests(places, lo, hi + unit.least, pick[lo] - lo)
    number = own[lo]
    return number, lo - begin[number], hi - begin[number], pick[lo] - begin[number], anchors[pick[lo]], digests


def _digests(places: np.ndarray, start: np.ndarray, end: np.ndarray, anchor: np.ndarray) -> list[bytes]:
    """BLAKE2b of ranges of places and of where their anchors are: segments with equal ones are copies."""
    raw, width = memoryview(np.ascontiguousarray(places)).cast("B"), places.itemsize
    marks = anchor.astype("<u4").tobytes()
    return [hashlib.blake2b(raw[a * width : b * width], digest_size=16, salt=marks[4 * i : 4 * i + 4]).digest() for i, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True))]


def _needed(is_a: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted suffixes and, after each of type A, its successors up to the first of type B."""
    n = len(is_a)
    b = np.append(np.flatnonzero(~is_a), n - 1)
    to = b[np.searchsorted(b, wanted)]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, wanted, 1)
    np.add.at(edge, to + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def suffix_array(codes: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of a text of codes 0 to 256 (0: a separator) in the order of their first ``depth`` codes or more.

    Two-stage sorting. A suffix smaller than its successor is of type B, a greater one of type A.
    Stage one sorts type B directly. Stage two scans the buckets of first codes upwards: each scanned
    suffix i puts i - 1, if that is of type A, at the next free place of its bucket. With ``wanted`` places
    only these suffixes, and those that they are induced from, take part.
    """
    n = len(codes)
    step = np.sign(np.diff(codes.astype(np.int16), append=np.int16(-1))).astype(np.int8)
    known = np.flatnonzero(step)
    kind = step[known[np.searchsorted(known, np.arange(n))]]
    is_a = kind < 0
    take = np.ones(n, bool) if wanted is None else _needed(is_a, wanted)
    is_a &= take
    narrow = codes.max(initial=0) < 256
    text, scale = codes.astype("u1" if narrow else ">u2").tobytes(), 1 if narrow else 2
    direct = np.flatnonzero(take & ~is_a & (codes > 0)).tolist()
    width = scale * depth
    direct.sort(key=lambda i: text[scale * i : scale * i + width])
    b = np.concatenate([np.flatnonzero(take & (codes == 0)), np.array(direct, np.int64)]).astype(np.int64)
    sizes = np.bincount(codes[take], minlength=257)
    b_sizes = np.bincount(codes[b], minlength=257)
    b_start = np.cumsum(b_sizes) - b_sizes
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []

    def induce(scanned: np.ndarray, bucket: int) -> np.ndarray:
        """Deal the type A predecessors to their buckets; those of this bucket are returned to be scanned next."""
        before = scanned[scanned > 0] - 1
        before = before[is_a[before]]
        first = codes[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        edges = np.flatnonzero(np.diff(first, prepend=-1))
        own = before[:0]
        for s, e in zip(edges, [*edges[1:], len(first)], strict=False):
            if first[s] == bucket:
                own = before[s:e]
            else:
                waiting[first[s]].append(before[s:e])
        return own

    for bucket in np.flatnonzero(sizes):
        part = np.concatenate(waiting[bucket]) if waiting[bucket] else np.empty(0, np.int64)
        while len(part):
            out.append(part)
            part = induce(part, bucket)
        own_b = b[b_start[bucket] : b_start[bucket] + b_sizes[bucket]]
        out.append(own_b)
        part = induce(own_b, bucket)
        assert not len(part)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def common_prefixes(raw: np.ndarray, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Common bytes of suffixes x[i] and y[i], ``most`` at most; both must be as long."""
    out, alive, at = np.zeros(len(x), np.int64), np.arange(len(x)), 0
    while len(alive) and at < most:
        step = min(40, most - at)
        views = np.lib.stride_tricks.as_strided(raw, (len(raw) - step + 1, step), (1, 1))
        differ = views[x[alive] + at] != views[y[alive] + at]
        first = differ.argmax(axis=1)
        whole = ~differ[np.arange(len(alive)), first]
        out[alive] += np.where(whole, step, first)
        alive = alive[whole]
        at += step
    return out


def repeated_starts(pieces: list[bytes], least: int, width: int = 1, owners: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of ``least`` places that also start somewhere else in any of the pieces: runs as (piece, first and last place).

    A place has ``width`` bytes. With ``owners`` (a number for each piece, -1 for one of several owners) a string
    must start in pieces of different owners.
    """
    sizes = np.array([len(p) for p in pieces])
    begin = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    codes = raw.astype(np.uint16) + np.uint16(1)
    codes[begin + sizes] = 0
    starts = (sizes - least * width) // width + 1
    piece = np.repeat(np.arange(len(sizes)), starts)
    place = np.arange(len(piece)) - (np.cumsum(starts) - starts)[piece]
    wanted = begin[piece] + width * place
    order = suffix_array(codes, least * width, wanted)
    number = np.full(len(raw), -1, np.int64)
    number[wanted] = np.arange(len(wanted))
    order = order[number[order] >= 0]
    same = common_prefixes(raw, order[:-1], order[1:], least * width) >= least * width
    first = np.flatnonzero(np.append(True, ~same))
    members = np.diff(np.append(first, len(order)))
    repeated = members > 1
    if owners is not None:
        own = owners[piece[number[order]]]
        low, high = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
        repeated = (low < 0) & (members > 1) | (low != high)
    found = np.zeros(len(wanted), bool)
    found[number[order]] = np.repeat(repeated, members)
    begins, ends = found.copy(), found.copy()
    begins[1:] &= ~found[:-1] | (place[1:] == 0)
    ends[:-1] &= ~found[1:] | (place[1:] == 0)
    return piece[begins], place[begins], place[ends]


def _stretches(texts: list[bytes], unit: Unit) -> Iterator[tuple[int, int, np.ndarray]]:
    """Texts as (number, first place, codes) of BLOCK strings at most: those of a text overlap, so each string is in one."""
    words, starts = hashed_words(texts) if unit.words else (None, None)
    for i, t in enumerate(texts):
        whole = words[starts[i] : starts[i + 1]] if unit.words else np.frombuffer(t, np.uint8)
        for a in range(0, max(0, len(whole) - unit.least + 1), BLOCK):
            yield i, a, whole[a : a + BLOCK + unit.least - 1]


def _scan(unit: Unit):
    names = ["h", "s", "k1", "k2", "lo", "hi", "at"]

    def found(held: list[tuple], k1: np.ndarray, k2: np.ndarray) -> pa.RecordBatch:
        code = np.concatenate([h[2] for h in held])
        number, lo, hi, at, h, s = segments(code, np.array([len(x[2]) for x in held]), unit)
        text, offset = np.array([x[0] for x in held])[number], np.array([x[1] for x in held])[number]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), s, k1[text], k2[text], *((x + offset).astype(np.int32) for x in (lo, hi, at)))], names=names)

    def run(batches):
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a in range(0, batch.num_rows, ROWS):
                texts = [x or b"" for x in batch.column(2).slice(a, ROWS).cast(pa.large_binary()).to_pylist()]
                held, size = [], 0
                for s in _stretches(texts, unit):
                    if held and size + len(s[2]) > BLOCK + unit.least:
                        yield found(held, k1[a : a + ROWS], k2[a : a + ROWS])
                        held, size = [], 0
                    held.append(s)
                    size += len(s[2])
                if held:
                    yield found(held, k1[a : a + ROWS], k2[a : a + ROWS])

    return lean(run)


_PIECE = pa.schema([("key", pa.binary()), ("words", pa.bool_()), ("h", pa.int64()), ("s", pa.binary()), ("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int32()), ("c", pa.int64()), ("across", pa.bool_()), ("piece", pa.binary())])
_PIECE_SQL = "key binary, words boolean, h long, s binary, k1 long, k2 long, lo int, c long, across boolean, piece binary"


def _cut(units: dict[bool, Unit], large: int):
    """Segments of each text as rows (key, bytes); those of large groups in steps with a key of their own. lo is the place of the row's first string."""

    def cut(row: dict) -> Iterator[dict]:
        text = row["raw"] or b""
        edges = None
        for g in row["parts"]:
            unit = units[g["words"]]
            if unit.words:
                edges = edges or word_edges(np.frombuffer(text + b" ", np.uint8))

            def content(a: int, b: int, edges=edges, words=unit.words) -> bytes:
                return b" ".join(text[edges[0][a] : edges[1][b - 1]].split()) if words else text[a:b]

            base = {"words": unit.words, "h": g["h"], "s": g["s"], "k1": row["k1"], "k2": row["k2"], "c": g["c"], "across": g["across"]}
            kind = b"w" if unit.words else b"b"
            if g["d"] <= large:
                yield base | {"key": kind + g["h"].to_bytes(8, "big", signed=True), "lo": g["lo"], "piece": content(g["lo"], g["hi"] + unit.least)}
                continue
            for near in range((g["at"] - g["hi"]) // unit.step * unit.step, g["at"] - g["lo"] + 1, unit.step):
                # strings that start near to near + step - 1 places before the anchor, and what they have in common
                a, b = max(g["lo"], g["at"] - near - unit.step + 1), min(g["hi"], g["at"] - near)
                core = content(g["at"] - near, g["at"] - near - unit.step + 1 + unit.least)
                yield base | {"key": kind + hashlib.blake2b(core + near.to_bytes(4, "big", signed=True), digest_size=16).digest(), "lo": a, "piece": content(a, b + unit.least)}

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for a in range(0, batch.num_rows, ROWS):
                for row in batch.slice(a, ROWS).to_pylist():
                    for piece in cut(row):
                        out.append(piece)
                        size += len(piece["piece"])
                        if size > 4 << 20 or len(out) >= 4000:
                            yield pa.RecordBatch.from_pylist(out, _PIECE)
                            out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, _PIECE)

    return lean(run)


def _numbered(pieces: list[bytes]) -> list[bytes]:
    """Pieces with three bytes for each word, its number among the different ones; no byte is 0."""
    seen: dict[bytes, int] = {}
    split = [p.split() for p in pieces]
    number = np.fromiter((seen.setdefault(w, len(seen)) for p in split for w in p), np.int64, sum(map(len, split)))
    codes = np.stack([number // 65025, number // 255 % 255, number % 255], axis=1).astype(np.uint8) + np.uint8(1)
    ends = np.cumsum([len(p) for p in split])
    return [c.tobytes() for c in np.split(codes, ends[:-1])]


def _sort(units: dict[bool, Unit]):
    """Groups of pieces with one key, several groups to a suffix array; strings repeated, as ranges of places.

    Those of a segment with one copy come with its document (h null), those of others with the segment, from its beginning on.
    """
    fields = ["words", "h", "s", "k1", "k2", "a", "b"]
    types = (pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def solve(rows: list[dict], unit: Unit) -> Iterator[pa.RecordBatch]:
        pieces = [r["piece"] for r in rows]
        owners = None
        if unit.across:
            numbers: dict[tuple, int] = {}
            owners = np.array([-1 if r["across"] else numbers.setdefault((r["k1"], r["k2"]), len(numbers)) for r in rows])
        found = repeated_starts(_numbered(pieces) if unit.words else pieces, unit.least, unit.width, owners)
        out = []
        for i, a, b in zip(*(x.tolist() for x in found), strict=True):
            r = rows[i]
            if r["c"] == 1 or unit.across and not r["across"]:  # else the segment is a repeat as a whole
                names = (None, None) if r["c"] == 1 else (r["h"], r["s"])
                out.append((unit.words, *names, r["k1"], r["k2"], r["lo"] + a, r["lo"] + b))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=fields)

    def run(batches):
        held: list[dict] = []
        group: list[dict] = []
        size = 0

        def close() -> int:
            nonlocal group, held
            more = 0
            if len(group) > 1:
                held += group
                more = sum(len(g["piece"]) for g in group)
            group = []
            return more

        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                for row in batch.slice(a, ROWS).to_pylist():
                    if group and row["key"] != group[0]["key"]:
                        size += close()
                        if held and (size >= ARRAY or held[0]["words"] != row["words"]):
                            yield from solve(held, units[held[0]["words"]])
                            held, size = [], 0
                    group.append(row)
        size += close()
        if held:
            yield from solve(held, units[held[0]["words"]])

    return lean(run)


def covered_runs(starts: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Maximal runs [a, b) of places that strings starting in the given ranges cover; runs that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + least)
        else:
            out.append([a, b + least])
    return [(a, b) for a, b in out]


def _remove(removed: tuple[Unit, ...], counted: Unit | None, keep_text: bool):
    def spans(text: bytes, row: dict) -> list[tuple[int, int]]:
        found = []
        for unit in removed:
            for a, b in covered_runs([(x["a"], x["b"]) for x in row[unit.name] or []], unit.least):
                if unit.words:
                    start, end = word_edges(np.frombuffer(text + b" ", np.uint8))
                    a, b = int(start[a]), int(end[b - 1])
                found.append((a, b))
        return covered_runs(found, 0)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [x or b"" for x in part.column("raw").cast(pa.large_binary()).to_pylist()]
                rows = part.select([u for u in ("bytes", "words") if u in part.schema.names]).to_pylist()
                found = [spans(t, r) for t, r in zip(texts, rows, strict=True)]
                left = []
                for t, r in zip(texts, found, strict=True):
                    edges = [0, *(x for s in r for x in s), len(t)]
                    left.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                cols = {
                    "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array([len(t) - len(k) for t, k in zip(texts, left, strict=True)], pa.int64()),
                    "n_spans": pa.array([len(r) for r in found], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in left]),
                }
                if counted:
                    cols["n_passage_words"] = pa.array([sum(b - a for a, b in covered_runs([(x["a"], x["b"]) for x in r[counted.name] or []], counted.least)) for r in rows], pa.int64())
                if keep_text:
                    cols["kept_text"] = pa.array([k.decode("utf-8", "ignore").encode() for k in left], pa.binary())
                own = [n for n in part.schema.names if n.startswith("_c")]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in own), *cols.values()], names=[*own, *cols])

    return lean(run)


class _Found(NamedTuple):
    """Segments of one unit that share an anchor with others, their kinds (equal ones are one), and the kinds of anchors that have several."""

    segments: DataFrame
    kinds: DataFrame
    mixed: DataFrame


def _kinds(docs: DataFrame, unit: Unit) -> _Found:
    found = shared_table(docs.select("k1", "k2", "raw").mapInArrow(_scan(unit), "h long, s binary, k1 long, k2 long, lo int, hi int, at int"), "suffix-segments")
    common = shared_table(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-common")
    shared = shared_table(meet(found, common, ["h"], "n", found.count()), "suffix-shared")
    discard(found, common)
    row = F.struct("k1", "k2", "lo", "hi", "at")
    kinds = shared.groupBy("h", "s").agg(F.count(F.lit(1)).alias("c"), F.min(row).alias("x"), F.max(F.struct("k1", "k2")).alias("y"))
    kinds = shared_table(kinds.select("h", "s", "c", (F.struct("x.k1", "x.k2") != F.col("y")).alias("across"), "x.*"), "suffix-kinds")
    heads = shared_table(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("d")).where("d > 1").withColumn("w", F.col("d")), "suffix-heads")
    return _Found(shared, kinds, meet(kinds, heads, ["h"], "w", kinds.count()).withColumn("words", F.lit(unit.words)))


def _starts(found: _Found, marks: DataFrame, unit: Unit) -> DataFrame:
    """Rows (k1, k2, a, b): strings that start from a to b in a document are repeated."""
    own = marks.where(F.col("words") == F.lit(unit.words))
    several = found.kinds.where("c > 1 and across" if unit.across else "c > 1")
    whole = several.select("h", "s", F.lit(0).alias("a"), (F.col("hi") - F.col("lo")).alias("b"), "c")
    if unit.across:  # marks of segments with copies in one document: places from the segment's beginning
        inner = own.where("h is not null").join(found.kinds.select("h", "s", "lo", "c"), ["h", "s"])
        whole = whole.unionByName(inner.select("h", "s", (F.col("a") - F.col("lo")).alias("a"), (F.col("b") - F.col("lo")).alias("b"), "c"))
    copies = shared_table(whole.groupBy("h", "s").agg(F.collect_set(F.struct("a", "b")).alias("r"), F.max("c").alias("c")), "suffix-copies")
    everywhere = meet(found.segments, copies, ["h", "s"], "c", found.segments.count())
    everywhere = everywhere.select("k1", "k2", "lo", F.explode("r").alias("r")).select("k1", "k2", (F.col("lo") + F.col("r.a")).alias("a"), (F.col("lo") + F.col("r.b")).alias("b"))
    return own.where("h is null").select("k1", "k2", "a", "b").unionByName(everywhere).withColumn("unit", F.lit(unit.name))


def suffix_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed: tuple[Unit, ...] = (BYTES,), counted: Unit | None = None,
    keep_text: bool = False, keep_cols: list[str] | None = None, large: int = LARGE,
) -> DataFrame:
    """Per row: ``keep_cols`` (the id column unless given), n_bytes, n_removed, n_spans, kept_sha256, n_passage_words if ``counted`` is given, and kept_text if asked for.

    Removed is each UTF-8 byte covered by a string of a ``removed`` unit that also starts anywhere else in the
    table, in the same text or another (with ``across``, in another one); strings never cross texts, overlaps count, and all are
    judged on the input. Of strings of words the bytes from the first word's first to the last word's last go; words are
    equal byte by byte, white space between them doesn't count. n_passage_words: words covered by strings of ``counted``.
    kept_text drops bytes of characters that a cut has split.

    Defined cases: a null text is empty; texts under ``least`` places stay whole; repeated rows are
    copies of each other, so they lose everything from ``least`` bytes on (with ``across``, rows of the same id and
    text are one document); null ids are allowed and stay rows of their own; an empty table gives no rows. Other
    columns are not read, clashing names are no matter.
    """
    ship(df.sparkSession)
    keep_cols = [id_col] if keep_cols is None else keep_cols
    names = {c: f"_c{i}" for i, c in enumerate(keep_cols)}
    units = {u.words: u for u in (*removed, *([counted] if counted else []))}
    text = F.col(text_col).cast("binary")
    # The pair of keys is the row's identity in all joins; rows that share it have the same id and text.
    docs = df.select(F.xxhash64(F.col(id_col).cast("string")).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("raw"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    found = {u: _kinds(docs, u) for u in units.values()}

    wanted = None
    for f in found.values():
        wanted = f.mixed if wanted is None else wanted.unionByName(f.mixed)
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("words", "h", "s", "lo", "hi", "at", "d", "c", "across")).alias("parts"))
    parts = input_parts(df.select(text_col))
    pieces = docs.select("k1", "k2", "raw").join(wanted.hint("shuffle_hash"), ["k1", "k2"]).mapInArrow(_cut(units, large), _PIECE_SQL)
    marks = pieces.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_sort(units), "words boolean, h long, s binary, k1 long, k2 long, a int, b int")
    marks = shared_table(marks, "suffix-marks")
    starts = None
    for u, f in found.items():
        one = _starts(f, marks, u)
        starts = one if starts is None else starts.unionByName(one)
    spans = [F.collect_set(F.when(F.col("unit") == u.name, F.struct("a", "b"))).alias(u.name) for u in units.values()]
    starts = shared_table(starts.groupBy("k1", "k2").agg(*spans), "suffix-starts")
    discard(*(t for f in found.values() for t in (f.segments, f.kinds)))
    joined = docs.join(starts.hint("shuffle_hash"), ["k1", "k2"], "left").select(*names.values(), "raw", *[u.name for u in units.values()])
    long = lambda n: F.lit(0).cast("long").alias(n)
    schema = docs.select(*names.values(), long("n_bytes"), long("n_removed"), long("n_spans"), F.lit("").alias("kept_sha256"), *([long("n_passage_words")] if counted else []), *([F.lit(b"").alias("kept_text")] if keep_text else [])).schema
    out = joined.mapInArrow(_remove(removed, counted, keep_text), schema)
    out = out.withColumn("kept_text", F.col("kept_text").cast("string")) if keep_text else out
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], *schema.names[len(names) :])


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_passage_words: passages of over 50 words that other documents have as well, also those under 400 bytes."""
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), counted=WORDS)
