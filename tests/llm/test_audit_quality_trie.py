"""Source audit, quality model and prefix trie against brute force, on odd tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import prefix_trie, quality_model, source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audited(rows, least, best):
    docs, count, groups = collections.Counter(), collections.Counter(), set()
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        groups.add((lang, source))
        found = TERM.findall(text.translate(LOWER))
        docs.update({(lang, t) for t in found})
        count.update((lang, source, t) for t in found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for (x, t), n in docs.items() if x == lang and n >= least), key=str.encode)
        sources = sorted((s for x, s in groups if x == lang), key=str.encode)
        n = {s: [count[lang, s, t] for t in kept] for s in sources}
        share = lambda c: [1 + 10**9 * (x + 2) // (sum(c) + 2 * len(kept)) for x in c]  # noqa: E731, B023
        p = {s: share(c) for s, c in n.items()}
        q = share([sum(x) for x in zip(*n.values(), strict=True)]) if kept else []
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(b, sum(map(far, p[s], p[b]))) for b in sources if b != s]
            terms = [(t, far(x, y)) for t, x, y, c in zip(kept, p[s], q, n[s], strict=True) if c and x > y]
            for part, items, most in (("pair", pairs, None), ("term", terms, best)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def audit_rows():
    r = random.Random(2)
    words = ["alpha", "Alphabet", "alp", "beta", "Ä", "ärger", "日本", "日", "x1y", "be-ta", "É", "z", "ﬀ", "\U0001f600"]
    rows = [("en" if i % 3 else "de", f"s{i % 5}", " ".join(r.choice(words[: 3 + i % 12]) for _ in range(r.randrange(40)))) for i in range(160)]
    rows += [(None, None, None), (None, "s1", "alpha"), ("en", "silent", ""), ("en", "silent", None), ("fr", "only", "beta beta"), ("fr", "two", "12 34")]
    return rows + [("en", "s1", "Ties ties ties")] * 12 + [("en", "long", "mot " * 3000 + "Wort" * 500)] * 11


def test_audit(spark, audit_rows):
    df = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(audit_rows)], "doc_id long, lang string, source string, text string, term string, rank int").repartition(5)
    for least, best, block in ((10, 10, 256), (3, 4, 2), (1, 3, 3)):
        got = source_audit.source_divergence(df, min_documents=least, best=best, block=block)
        assert sorted(map(tuple, got.collect())) == audited(audit_rows, least, best)
    assert source_audit.source_divergence(df.limit(0)).count() == 0


def test_audit_in_small_tries(monkeypatch, audit_rows):
    for name, value in (("CHUNK", 16), ("HELD", 200), ("LEAVES", 6), ("MERGED", 3), ("ROWS", 5)):
        monkeypatch.setattr(source_audit, name, value)
    table = pa.table({"lang": [r[0] or "" for r in audit_rows], "source": [r[1] or "" for r in audit_rows], "text": [r[2] or "" for r in audit_rows]})
    leaves = pa.Table.from_batches(source_audit._count(table.to_batches(max_chunksize=7))).sort_by([("lang", "ascending"), ("term", "ascending")])
    found = collections.Counter()
    for batch in source_audit._merge(2)(leaves.to_batches(max_chunksize=2)):
        row = batch.to_pylist()[0]
        assert len(row["rest"]) <= 3
        terms, before = [], b""
        for k, rest in zip(row["shared"], row["rest"], strict=True):
            before = before[:k] + rest
            terms.append(before.decode())
        for leaf, source, n in zip(row["leaf"], row["source"], row["n"], strict=True):
            assert (row["lang"], row["names"][source], terms[leaf]) not in found
            found[row["lang"], row["names"][source], terms[leaf]] += n
    docs, count = collections.Counter(), collections.Counter()
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in audit_rows):
        terms = TERM.findall(text.translate(LOWER))
        docs.update({(lang, t) for t in terms})
        count.update((lang, source, t) for t in terms)
    assert found == {k: n for k, n in count.items() if docs[k[0], k[2]] >= 2}


def test_trie_splits_labels():
    trie = source_audit.Trie()
    for t in (b"romane", b"romanus", b"romulus", b"rom", b"", b"romane"):
        trie.leaf(t)[0] += 1
    assert [(t, leaf[0]) for t, leaf in trie.walk()] == [(b"", 1), (b"rom", 1), (b"romane", 2), (b"romanus", 1), (b"romulus", 1)] and trie.leaves == 5
    assert len(trie.root[1]) == 1


def test_shares_are_exact():
    for total, terms in ((7, 3), (10**13, 10**7), (2**52, 1000)):
        counts = np.array([0, 1, total // 3, total], np.int64)
        assert source_audit.shares(counts, total, terms).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 2 * terms) for c in counts]


def trie_nodes(sequences):
    """Brute force: {conv: [(role, text), ...]} to the rows of the contract."""
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, seq in sorted(sequences.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(
        ((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], sha(ends[p])) for p, m in members.items()), key=str)


def sequences(rows, span=100, most=6, change=True):
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    if not change:
        return own
    h = {c: zlib.crc32(str(c).encode()) % most for c in own}
    base = lambda c: c - (abs(c) % span) * (1 if c >= 0 else -1)
    return {c: own.get(base(c), [])[: h[c]] + own[c][h[c] :] for c in own}


@pytest.fixture(scope="module")
def talk_rows():
    r = random.Random(7)
    rows = []
    for c in [*range(40), *range(100, 130), *range(205, 215), -3, -100, -250]:
        for t in range(r.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["Hi", "Hi", "ja, bitte é", None, "", "x" * 40])))
    rows += [(7, None, "user", "first"), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (7, 0, "user", "other tie"), (None, 0, "user", "lost")]
    rows += [(c, t, "user", f"turn {t}") for c in (301, 302, 303, 99999, 70000) for t in range(40)]
    rows += [(304, t, "user", f"turn {t}" if t < 30 else f"other {t}") for t in range(60)] + [(305, t, "user", f"turn {t}" if t < 13 else "own") for t in range(50)]
    return rows + [(c, 0, "user", "the same") for c in range(400, 460)]


@pytest.mark.parametrize("limit, chunk", [(256, 64), (3, 4), (1, 3), (20, 10)])
def test_trie_of_conversations(spark, talk_rows, limit, chunk):
    df = spark.createDataFrame([(*r, 1, "k") for r in talk_rows], "conv_id long, turn int, role string, text string, pos int, key string").repartition(6)
    turns = prefix_trie.turn_rows(df)
    got = prefix_trie.prefix_trie(turns.select("conv").distinct(), turns, limit, chunk)
    assert sorted(map(tuple, got.collect()), key=str) == trie_nodes(sequences(talk_rows, change=False))
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns), limit, chunk)
    want = trie_nodes(sequences(talk_rows))
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert [d for _, d in got.dtypes] == ["bigint"] * 7 + ["string"]


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.turn_rows(spark.createDataFrame([], schema)))).count() == 0
    rows = [(c, 0, "user", "hi") for c in range(501, 530)]  # no conversation 500, so many have no turn left
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.turn_rows(spark.createDataFrame(rows, schema))))
    assert sorted(map(tuple, got.collect()), key=str) == trie_nodes(sequences(rows))
    silent = [(c, 0, "user", "hi") for c in range(501, 530) if zlib.crc32(str(c).encode()) % 6]
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.turn_rows(spark.createDataFrame(silent, schema))))
    assert [tuple(r)[:4] for r in got.collect()] == [(silent[0][0], 0, None, len(silent))]


def test_isotonic_is_the_closest_ascending_sequence():
    r = random.Random(5)
    for _ in range(30):
        n = r.randint(1, 9)
        c = [r.randint(1, 5) for _ in range(n)]
        p = [r.uniform(0, x) for x in c]
        # min-max formula
        mean = lambda a, b: sum(p[a : b + 1]) / sum(c[a : b + 1])  # noqa: E731, B023
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(quality_model.isotonic(np.array(p), np.array(c, float)), want)


def test_features_approximate_a_gaussian_kernel():
    how = quality_model.Ridge(features=8192)
    d = len(quality_model.STATISTICS)
    x = np.random.default_rng(1).normal(size=(40, d))
    z = quality_model._features(x, np.zeros(d), np.ones(d), how)[:, :-1]
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = np.exp(-far / (2 * how.width**2 * d / 8))
    assert np.abs(z @ z.T * 2 / how.features - want).max() < 0.06


def test_normal_equations_of_partitions_equal_those_of_all_rows(spark):
    r = np.random.default_rng(3)
    d = len(quality_model.STATISTICS)
    x = r.integers(-3000, 3000, (600, d)).astype(np.int16)
    y = (x[:, 0] + x[:, 1] > 500).astype(int)
    how = quality_model.Ridge(features=64)
    rows = [(i, x[i].tobytes(), int(y[i])) for i in range(600)]
    fitted = [quality_model.fit(spark.createDataFrame(rows, "id long, x binary, label int").repartition(k), how) for k in (1, 7)]
    whole = x / 1024
    mean = whole.mean(axis=0)
    scale = whole.std(axis=0)
    z = quality_model._features(whole, fitted[0].mean, fitted[0].scale, how)
    w = np.linalg.solve(z.T @ z + how.penalty * 600 * np.eye(65), z.T @ y)
    assert np.allclose(fitted[0].mean, mean) and np.allclose(fitted[0].scale, scale)
    assert np.allclose(fitted[0].weights, w, atol=2**-15)
    assert all(np.array_equal(a, b) for a, b in zip(fitted[0][:5], fitted[1][:5], strict=True))


def test_quality_model_on_odd_tables(spark):
    r = random.Random(3)
    good = lambda: " ".join(r.choice(["the", "river", "of", "winter", "seems", "quiet", "stone,", "garden."]) for _ in range(60))
    bad = lambda: "BUY!! " * 30 + "".join(r.choice("$%&*#") for _ in range(90))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(1000, None), (1001, ""), (1002, " \n"), (None, good()), (1003, good() * 2000), (5, good())]
    docs = spark.createDataFrame([(*x, 1.0, "y") for x in rows], "doc_id long, text string, score double, label string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)] + [(None, 1), (7, None), (9999, 0)], "doc_id long, label int")
    got = quality_model.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    held = {x.doc_id: x.score for x in got if x.doc_id is not None and x.doc_id < 300 and x.doc_id % 2 and x.doc_id != 5}
    assert all((s > 0.5) == (i % 3 > 0) for i, s in held.items())
    long = good() * 2000
    assert quality_model.statistics(long.encode()) != quality_model.statistics((long + " $").encode())  # whole texts, to their ends
    assert {x.score for x in quality_model.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_model.quality_scores(docs.limit(0), labels).count() == 0


def test_quality_model_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_model.op12_quality_model(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    bad, good = (got.where(F.col("quality") == q).agg(F.count(F.lit(1)), F.sum("predicted")).first() for q in (0, 1))
    assert good[1] / good[0] >= 0.95 and bad[1] / bad[0] <= 0.35
