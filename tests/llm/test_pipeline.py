import collections
import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = WORD.findall(t.translate(LOWER))
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_stages_take_effect(spark, sf_dir, tmp_path):
    """Each stage on all that its predecessor kept, against brute force where it decides on documents."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mixture", "tokens"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        assert name == "tokens" or docs.columns == columns
    good = {r.doc_id: shingles(r.text) for r in kept["quality"]}
    assert all(len(WORD.findall(r.text)) >= 50 for r in kept["quality"])
    root = {i: i for i in good}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    ids = sorted(good)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = good[i], good[j]
            if a and 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    assert sorted(r.doc_id for r in kept["near_duplicates"]) == sorted({find(i) for i in ids})
    before = {r.doc_id: r.text.encode() for r in kept["near_duplicates"]}
    count = collections.Counter(h for t in before.values() for h in (hash(t[i : i + 400]) for i in range(len(t) - 399)))
    owners = collections.defaultdict(set)
    spots = {i: [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for i, t in before.items()}
    passage = lambda i, k: hash(tuple(before[i][a:b] for a, b in spots[i][k : k + 51]))
    for i in before:
        for k in range(len(spots[i]) - 50):
            owners[passage(i, k)].add(i)
    by_words = 0
    for r in kept["repeated_passages"]:
        t = before[r.doc_id]
        gone = [False] * len(t)
        for i in range(len(t) - 399):
            if count[hash(t[i : i + 400])] > 1:
                gone[i : i + 400] = [True] * 400
        for k in range(len(spots[r.doc_id]) - 50):
            if len(owners[passage(r.doc_id, k)]) > 1:
                a, b = spots[r.doc_id][k][0], spots[r.doc_id][k + 50][1]
                by_words += not all(gone[a:b])
                gone[a:b] = [True] * (b - a)
        assert r.text == bytes(x for x, g in zip(t, gone) if not g).decode("utf-8", "ignore")
    assert by_words
    times = collections.Counter(r.doc_id for r in kept["mixture"])
    assert set(times) <= set(before) and max(times.values()) <= 2
    assert len(kept["tokens"]) == len(kept["mixture"]) and all(len(r.token_ids) == 4 * r.n_tokens for r in kept["tokens"])


def test_repeated_ids_leave_one_row(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text), (3, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert collections.Counter(r.doc_id for r in got) == {1: 1, 3: 1, None: 1}
    assert corpus_pipeline.repeated_passages(spark, docs, "").agg(F.count(F.lit(1))).first()[0] == 5


def test_stages_on_odd_tables(spark):
    """Empty tables, nulls in every column, repeated rows and extra columns with clashing names."""
    r = random.Random(3)
    prose = " ".join(r.choice(["the", "river", "and", "hills", "of", "winter", "stone"]) + ("" if i % 3 else "abcdefgh"[i % 8]) for i in range(90))
    kind = "doc_id long, text string, lang string, source string, n_chars long, n_words long, __row string, taken int, kept boolean"
    rows = [(1, prose, "en", "s", 1), (1, prose, "en", "s", 1), (None, prose + " x", None, None, None), (2, None, "en", "s", 0), (3, "", None, "t", None), (4, " \n", "en", None, 2)]
    odd = spark.createDataFrame([(*r, 5, "r", 7, False) for r in rows], kind)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    want = {"quality": 3, "near_duplicates": 4, "repeated_passages": 6, "tokens": 6}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, "")
        assert name == "tokens" or out.columns == columns
        assert name not in want or out.count() == want[name], name
        assert stage(spark, odd.limit(0), "").count() == 0
    mixed = corpus_pipeline.mixture(spark, odd, "").collect()
    assert {r.doc_id for r in mixed} <= {1, None, 2, 3, 4} and max(collections.Counter(str(r) for r in mixed).values()) <= 4
