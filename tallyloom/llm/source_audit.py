"""How far the sources of a language diverge from each other and from the language, by terms.

Partitions count terms in radix tries over UTF-8 bytes, whose leaves hold a counter for each source. A trie's walk is in
byte order, so the leaves of all partitions are dealt to ranges of terms; each range merges them into tries again and keeps the terms
that enough documents have. A walk of the merged tries gives the sums of all pairs of sources and the best terms of each.
"""

from __future__ import annotations

import gc
import os.path
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import input_parts, lean, shared_table, ship

#: Bytes of terms, A-Z as a-z; all other bytes as blanks.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split at once, bytes of texts that are counted before tries take the counts, leaves of a partition's
#: tries and of a merged one, leaves that are merged at once, sources that are compared with as many others at once.
CHUNK, HELD, LEAVES, MERGED, ROWS, BLOCK = 1 << 20, 16 << 20, 200_000, 4096, 1 << 16, 256
#: Shares of terms are counted in billionths.
UNIT = 1_000_000_000


class Trie:
    """A radix trie. A node is [label, children by first byte or None, leaf or None]; a leaf is [documents, {source: count}]."""

    def __init__(self):
        self.root = [b"", {}, None]
        self.leaves = 0

    def leaf(self, term: bytes) -> list:
        """The leaf of a term, which is made if it isn't there."""
        node, at = self.root, 0
        while at < len(term):
            children = node[1]
            if children is None:
                children = node[1] = {}
            child = children.get(term[at])
            if child is None:
                node = children[term[at]] = [term[at:], None, None]
                break
            label = child[0]
            if not term.startswith(label, at):
                k = next((i for i, (x, y) in enumerate(zip(label, term[at:], strict=False)) if x != y), len(term) - at)
                child[0] = label[k:]
                child = children[term[at]] = [label[:k], {label[k]: child}, None]
                label = child[0]
            node, at = child, at + len(label)
        if node[2] is None:
            node[2] = [0, {}]
            self.leaves += 1
        return node[2]

    def walk(self) -> Iterator[tuple[bytes, list]]:
        """Terms and leaves in the order of bytes."""
        stack = [(b"", self.root)]
        while stack:
            before, (label, children, leaf) = stack.pop()
            term = before + label
            if leaf is not None:
                yield term, leaf
            if children:
                stack.extend((term, children[b]) for b in sorted(children, reverse=True))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of those of about CHUNK bytes."""
    text, at = text.translate(_TERM_BYTES), 0
    while len(text) - at > CHUNK:
        end = text.rfind(b" ", at, at + CHUNK)
        end = end if end > at else text.find(b" ", at + CHUNK)
        if end < 0:
            break
        yield text[at:end].split()
        at = end
    yield text[at:].split()


_LEAF = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("documents", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_LEAF_SQL = "lang string, term binary, documents long, sources array<string>, counts array<long>"


def _count(batches):
    """The leaves of tries of the rows (lang, source, text)."""
    gc.disable()  # tries have no cycles, and looking for some among millions of nodes takes as long as counting
    try:
        yield from _leaves(batches)
    finally:
        gc.enable()


def _leaves(batches):
    tries: dict[str, Trie] = {}

    def flush():
        for lang in sorted(tries):
            rows = []
            for term, (documents, counts) in tries[lang].walk():
                rows.append((lang, term, documents, list(counts), list(counts.values())))
                if len(rows) == MERGED:
                    yield _batch(rows, _LEAF)
                    rows = []
            if rows:
                yield _batch(rows, _LEAF)
        tries.clear()

    counts: dict[tuple, Counter] = defaultdict(Counter)
    documents: dict[str, Counter] = defaultdict(Counter)
    held = 0

    def take():
        for lang, of_lang in documents.items():
            trie = tries.setdefault(lang, Trie())
            leaves = {term: trie.leaf(term) for term in of_lang}
            for term, n in of_lang.items():
                leaves[term][0] += n
            for source in [s for at, s in counts if at == lang]:
                for term, n in counts.pop((lang, source)).items():
                    own = leaves[term][1]
                    own[source] = own.get(source, 0) + n
        documents.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), strict=True):
            text = text.as_py()
            found, distinct = counts[lang, source], documents[lang]
            own: set[bytes] = set()
            for words in terms(text):
                found.update(words)
                own.update(words)
            distinct.update(own)
            held += len(text)
            if held >= HELD:
                take()
                held = 0
                if sum(t.leaves for t in tries.values()) >= LEAVES:
                    yield from flush()
    take()
    yield from flush()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


#: A merged trie as its walk: bytes that a term shares with the one before, and the rest. The counters of all leaves follow each other.
_TRIE = pa.schema([
    ("lang", pa.string()), ("shared", pa.list_(pa.int32())), ("rest", pa.list_(pa.binary())), ("names", pa.list_(pa.string())), ("sums", pa.list_(pa.int64())),
    ("leaf", pa.list_(pa.int32())), ("source", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())),
])
_TRIE_SQL = "lang string, shared array<int>, rest array<binary>, names array<string>, sums array<long>, leaf array<int>, source array<int>, n array<long>"


def _walk(lang: str, kept: list[bytes], leaf: np.ndarray, source: np.ndarray, n: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Terms in ascending order with their counters as a stored trie."""
    shared, rest = [], []
    for before, term in pairwise([b"", *kept]):
        k = len(os.path.commonprefix([before, term]))
        shared.append(k)
        rest.append(term[k:])
    own, source = np.unique(source, return_inverse=True)
    sums = np.zeros(len(own), np.int64)
    np.add.at(sums, source, n)
    return _batch([(lang, shared, rest, [names[i] for i in own], sums, leaf, source, n)], _TRIE)


def _merge(min_documents: int):
    """The walks of many tries, sorted into one, as tries of MERGED leaves at most that enough documents have.

    Leaves of one term follow each other. A term's last leaf may be in the next batch, so the last term is kept back until it has come.
    """

    def merged(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        first = _firsts(table)
        run = np.cumsum(first) - 1
        documents = np.bincount(run, weights=table.column("documents").to_numpy()).astype(np.int64)
        number = np.where(documents >= min_documents, np.cumsum(documents >= min_documents) - 1, -1)
        rows = np.flatnonzero(number[run] >= 0)
        if not len(rows):
            return
        kept = table.take(pa.array(rows))
        heads = kept.filter(pa.array(first[rows]))
        terms, langs = heads.column("term").to_pylist(), heads.column("lang").to_pylist()
        sources = kept.column("sources").combine_chunks()
        coded = sources.flatten().dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        sizes = kept.column("sources").combine_chunks().value_lengths().to_numpy()
        leaf = np.repeat(number[run][rows], sizes)
        cell, where = np.unique(leaf * len(names) + code, return_inverse=True)
        n = np.zeros(len(cell), np.int64)
        np.add.at(n, where, kept.column("counts").combine_chunks().flatten().to_numpy())
        leaf, code = np.divmod(cell, max(1, len(names)))
        edges = [i for i in range(len(langs)) if not i or langs[i] != langs[i - 1]] + [len(langs)]
        for a, b in pairwise(edges):
            for at in range(a, b, MERGED):
                end = min(b, at + MERGED)
                lo, hi = np.searchsorted(leaf, [at, end])
                yield _walk(langs[at], terms[at:end], (leaf[lo:hi] - at).astype(np.int32), code[lo:hi].astype(np.int32), n[lo:hi], names)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROWS:
                table = pa.Table.from_batches(held)
                cut = int(np.flatnonzero(_firsts(table))[-1])
                if cut:
                    yield from merged(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    rows = table.num_rows - cut
        if rows:
            yield from merged(pa.Table.from_batches(held))

    return run


def _firsts(table: pa.Table) -> np.ndarray:
    """Which rows are the first of their language and term."""
    out = np.ones(table.num_rows, bool)
    for c in ("lang", "term"):
        column = table.column(c).combine_chunks()
        out[1:] &= pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    out[1:] = ~out[1:]
    return out


def shares(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)) by long division, exact while the divisor is under 2**53."""
    divisor = total + 2 * terms
    assert divisor < 1 << 53
    out, rest = np.zeros_like(count), count + 2
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, divisor)
        out = out * 1000 + whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
_FOUND_SQL = "lang string, source string, part string, item string, value long"


def _traverse(best: int, block: int):
    """For each merged trie: what it adds to each pair of sources (once, the smaller first), and the best terms of each source."""

    def solve(row: dict) -> Iterator[pa.RecordBatch]:
        words, before = [], b""
        for k, rest in zip(row["shared"], row["rest"], strict=True):
            before = before[:k] + rest
            words.append(before)
        names, totals, v = [t["source"] for t in row["totals"]], [t["n"] for t in row["totals"]], row["terms"]
        place = {s: i for i, s in enumerate(names)}
        leaf, n = np.array(row["leaf"], np.int64), np.array(row["n"], np.int64)
        source = np.array([place[s] for s in row["names"]], np.int64)[np.array(row["source"], np.int64)]
        whole = np.zeros(len(words), np.int64)
        np.add.at(whole, leaf, n)
        q = shares(whole, sum(totals), v)

        def columns(a: int) -> tuple[np.ndarray, np.ndarray]:
            count = np.zeros((len(words), min(block, len(names) - a)), np.int64)
            own = (source >= a) & (source < a + block)
            count[leaf[own], source[own] - a] = n[own]
            return count, np.stack([shares(count[:, i], totals[a + i], v) for i in range(count.shape[1])], axis=1)

        for a in range(0, len(names), block):
            count, p = columns(a)
            out = []
            for i in range(p.shape[1]):
                ahead = np.flatnonzero((count[:, i] > 0) & (p[:, i] > q))
                f = divergence(p[ahead, i], q[ahead])
                order = np.argsort(-f, kind="stable")[:best]
                out += [(row["lang"], names[a + i], "term", words[ahead[j]].decode(), int(f[j])) for j in order]
            if out:
                yield _batch(out, _FOUND)
            for b in range(a, len(names), block):
                other = p if a == b else columns(b)[1]
                for i in range(p.shape[1]):
                    first = i + 1 if a == b else 0
                    sums = divergence(p[:, i : i + 1], other[:, first:]).sum(axis=0)
                    if len(sums):
                        yield _batch([(row["lang"], names[a + i], "pair", names[b + first + j], int(x)) for j, x in enumerate(sums)], _FOUND)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from solve(batch.slice(i, 1).to_pylist()[0])

    return run


def source_divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_documents: int = 10, best: int = 10, block: int = BLOCK) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of every source of every language.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; a language keeps those that ``min_documents`` of
    its rows have. The share of a kept term in a source or language is p = 1 + floor(10**9 * (count + 2) / (N + 2V)), N the count of all its V
    kept terms; two shares diverge by floor((p - q)**2 / (p + q)). Part ``pair``: item is each other source, value the sum
    over the kept terms. Part ``term``: item is each term that the source has and uses more than the language, value its divergence, the
    first ``best`` ranks. Ranks go by value downwards, then by item's bytes upwards. All arithmetic is in whole numbers.

    Defined cases: a null text, language or source is ''; a source without terms, or in a language that keeps none, still has
    all its pairs; a language with one source has no pair; repeated rows are documents of their own; an empty table gives no rows. Other columns are not read.
    """
    ship(df.sparkSession)
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = df.select(read(lang_col).alias("lang"), read(source_col).alias("source"), read(text_col).alias("text"))
    leaves = shared_table(docs.mapInArrow(lean(_count), _LEAF_SQL), "audit-leaves")
    ranges = leaves.repartitionByRange(input_parts(leaves, 8 << 20), "lang", "term").sortWithinPartitions("lang", "term")
    tries = shared_table(ranges.mapInArrow(lean(_merge(min_documents)), _TRIE_SQL), "audit-tries")

    sums = tries.select("lang", F.explode(F.arrays_zip("names", "sums")).alias("x")).groupBy("lang", F.col("x.names").alias("source")).agg(F.sum("x.sums").alias("n"))
    kept = tries.groupBy("lang").agg(F.sum(F.size("rest")).alias("terms"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
    # The rows of a language are its sources; its result has a row for each pair of them.
    totals = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("totals"))
    totals = shared_table(totals.join(kept, "lang", "left"), "audit-totals")

    slices = tries.count() // 64 + 1
    dealt = tries.withColumn("slice", F.pmod(F.xxhash64("rest"), F.lit(slices)))
    known = totals.where("terms is not null").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    found = shared_table(dealt.join(known.hint("shuffle_hash"), ["lang", "slice"]).drop("slice").mapInArrow(lean(_traverse(best, block)), _FOUND_SQL), "audit-found")

    halves = found.where("part = 'pair'").select("lang", "source", "item", "value")
    none = totals.select("lang", F.explode("totals.source").alias("source"), "totals").select("lang", "source", F.explode("totals.source").alias("item"), F.lit(0).cast("long").alias("value"))
    pairs = halves.unionByName(halves.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).unionByName(none.where("source <> item"))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    ranked = pairs.unionByName(found.where("part = 'term'"), allowMissingColumns=True)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return ranked.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= best)).select("lang", "source", "part", "item", "value", "rank")


def op11_source_audit(spark, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * v.v) AS p
  FROM s JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = s.lang AND n.source = s.source
    LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 2)) // ((SELECT sum(n) FROM n WHERE n.lang = p.lang) + 2 * (SELECT v FROM v WHERE v.lang = p.lang)) AS q FROM p GROUP BY 1, 2),
f AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT a.lang, a.source AS a, b.source AS b, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3) x
    ON x.lang = a.lang AND x.a = a.source AND x.b = b.source),
g AS (
  SELECT lang, source, 'pair' AS part, item, value FROM f
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, ((p.p - l.q) * (p.p - l.q)) // (p.p + l.q) FROM p JOIN l USING (lang, term) WHERE p.c > 0 AND p.p > l.q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM g)
WHERE part = 'pair' OR rank <= 10
"""
