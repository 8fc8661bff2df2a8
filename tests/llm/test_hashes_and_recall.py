"""Texts that polynomial hashes take for equal, very long texts, and vectors that differ in few components."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import shingles, suffix_dedup_by_force, texts

import corpus_pipeline
from tallyloom.llm import bpe, embedding_dedup, lm_score, ngram_join, suffix_dedup, textnum, toxicity


def thue_morse(n, letters="ab"):
    out = "".join(letters[bin(i).count("1") % 2] for i in range(n))
    return out, out.translate(str.maketrans(letters, letters[::-1]))


def test_patterns_and_their_complements_have_different_hashes():
    for n in (8, 16, 64, 128, 1024, 4096):
        words, _ = textnum.hashed_words([x.encode() for x in thue_morse(n)])
        assert len(set(words.tolist())) == 2
    r = random.Random(1)
    many = list({"".join(r.choice("abé") for _ in range(r.randint(1, 90))).encode() for _ in range(20_000)})
    words, starts = textnum.hashed_words(many)
    assert len(set(words.tolist())) == len(many) and starts[-1] == len(many)
    upper, _ = textnum.hashed_words([b"ABC " * 3 + b"x" * 70, b"abc " + b"X" * 70], True)
    assert len(set(upper.tolist())) == 2


def test_repeats_of_patterns(spark):
    r = random.Random(3)
    shared = "".join(r.choice("xyzw ") for _ in range(600))
    data = [(i, "m" * 75 + p + "n" * 75 + shared, "a") for i, p in enumerate(thue_morse(256))]
    words = [f"w{i}" for i in range(40)]
    data += [(10 + i, " ".join([p, *words, "q", *words]), "a") for i, p in enumerate(thue_morse(1024))]
    got = suffix_dedup.suffix_dedup(texts(spark, data), counted=suffix_dedup.WORDS).collect()
    assert collections.Counter(tuple(x) for x in got) == suffix_dedup_by_force(data, 400, 51)
    assert {x.doc_id: x.n_removed for x in got if x.doc_id < 2} == {0: 675, 1: 675}


def test_links_of_patterns(spark):
    data = [(i, f"one two {p} three four", "a") for i, p in enumerate(thue_morse(1024))]
    got = ngram_join.ngram_jaccard_join(texts(spark, data)).collect()
    assert sorted(tuple(x) for x in got) == [(0, 1, 0), (1, 1, 1)]


def test_scores_of_patterns(spark):
    a, b = thue_morse(1024)
    got = lm_score.lm_scores(texts(spark, [(1, a + " x", "a"), (2, a, "a"), (3, b, "a")]), F.col("doc_id") < 3).collect()
    assert {x.doc_id: x.n_known for x in got} == {1: 3, 2: 2, 3: 1}


@pytest.fixture(scope="module")
def long_rows():
    """Texts beyond CHUNK bytes and beyond a batch's tokens: of many words, of one word, and a copy with some words changed."""
    r = random.Random(6)
    word = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    words = [r.choice(word) for _ in range(120_000)]
    near = [w if i % 400 else "other" for i, w in enumerate(words)]
    assert len(" ".join(words)) > textnum.CHUNK
    return [(1, " ".join(words), "a"), (2, " ".join(near), "a"), (3, "z" * (textnum.CHUNK + 9), "b"), (4, " ".join(words[:3000]), "b"), (5, "\n".join(words), "b")]


def test_very_long_texts_in_joins(spark, long_rows):
    sets = {i: shingles(t) for i, t, _ in long_rows}
    got = {r[0]: (r[1], r[2]) for r in ngram_join.ngram_jaccard_join(texts(spark, long_rows)).collect()}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert linked(1, 2) and linked(1, 5) and not linked(1, 4)
    assert got == {1: (len(sets[1]), 1), 2: (len(sets[2]), 1), 3: (1, 3), 4: (len(sets[4]), 4), 5: (len(sets[5]), 1)}


def test_very_long_texts_in_tokens_and_shards(spark, long_rows):
    from tokenizers import Tokenizer

    path = bpe.word_bpe_path()
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.bpe_digests(texts(spark, long_rows), path).collect()}
    for i, t, _ in long_rows:
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_very_long_texts_in_scores(spark, long_rows):
    got = {r.doc_id: r for r in lm_score.lm_scores(texts(spark, long_rows), F.col("doc_id") != 2).collect()}
    c = collections.Counter(w for i, t, _ in long_rows if i != 2 for w in [*t.split(), "\n"])
    n, v = sum(c.values()), len(c)
    for i, t, _ in long_rows:
        own = [*t.split(), "\n"]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    found = toxicity.features([t.encode() for _, t, _ in long_rows])
    apart = [np.unique(np.concatenate([toxicity.features([" ".join(w[k : k + 3]).encode()])[0] for w in [long_rows[3][1].split()] for k in range(len(w) - 2)]))]
    assert np.array_equal(found[3], apart[0]) and set(found[3]) <= set(found[0])


def test_very_long_texts_in_the_pipeline(spark, long_rows):
    r = random.Random(9)
    prose = ["the", "of", "and", "to", *["".join(r.choice("bcdfgaeiou") for _ in range(r.randint(2, 8))) for _ in range(3000)]]
    long = " ".join(r.choice(prose[:4]) if i % 3 == 0 else r.choice(prose) for i in range(110_000))
    docs = spark.createDataFrame([(1, long, "en", "a", len(long)), (2, long + " end", "en", "b", len(long) + 4), (3, long_rows[2][1], "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    one = corpus_pipeline.quality(spark, docs, "")
    assert {x.doc_id for x in one.collect()} == {1, 2}
    two = corpus_pipeline.near_duplicates(spark, one, "").collect()
    assert [(x.doc_id, x.text == long) for x in two] == [(1, True)]


@pytest.mark.parametrize("part", [slice(0, 64), slice(0, 32), slice(20, 28)])
def test_recall_where_partners_differ_in_some_components(spark, part):
    r = np.random.default_rng(zlib.crc32(str(part).encode()))
    x = embedding_dedup.unit(r.standard_normal((2500, 64)))
    off = np.zeros_like(x)
    off[:, part] = r.standard_normal(off[:, part].shape)
    y = embedding_dedup._moved(x, off, 0.903)
    assert np.allclose((x * y).sum(1), 0.903, atol=1e-6)
    both = np.concatenate([x, y])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    report = []
    found = embedding_dedup.embedding_near_dups(df, how=embedding_dedup.Index(most_rows=2000, chunk=256), report=report)
    links = (both @ both.T >= 0.9).sum() - len(both)
    assert found.agg(F.sum("n_links")).first()[0] >= 0.95 * links
    assert report[0]["recall"] >= 0.97 and report[0]["pairs"] > 100 and report[0]["vectors"] == 5000
