"""The training-data operators against brute force on small tables with nulls, ties, repeated rows and clashing columns."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import bpe, chat, embedding_dedup, graphs, lm_score, mixing, ngram_join, quality, suffix_dedup, textnum, token_shards, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(spark, rows, extra=""):
    """doc_id, text, source and columns whose names clash with ones that operators make."""
    full = [(i, t, s, 1, "x", 2.0) for i, t, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, source string, size int, n string, score double")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    make = lambda n: " ".join("".join(r.choice("abcdeéG") for _ in range(r.randint(1, 6))) for _ in range(n))
    base = make(120).split()
    near = []
    for i in range(25):
        t = list(base)
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = r.choice(base + ["new%d" % i])
        near.append((i, " ".join(t), "a"))
    return [*near, (100, None, None), (101, "", "b"), (102, " \n\t", "b"), (103, "one two", "c"), (104, "one two", "c"), (104, "one two", "c"), (None, "ONE two", "c"), (None, make(80), None), (105, make(300), "a"), (106, make(60) + "\nx y\nx y\n", "b"), (107, "Zz " * 400, "d")]


def test_mixture(spark, rows):
    out = mixing.mix_sources(texts(spark, rows)).collect()
    assert len(out) == len(rows)
    size = lambda t: len(WORD.findall(t or ""))
    total = collections.Counter()
    for _, t, s in rows:
        total[s] += size(t)
    order = sorted([s for s in total if s is not None]) + [None]
    weight = dict(zip(order, [3, 1, 2] * 3))
    target, free, rest = {}, set(order), 1.5 * sum(total.values())
    while True:
        share = rest / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            rest -= target[s]
        free -= over
    target |= {s: share * weight[s] for s in free}
    by_source = collections.Counter()
    source = collections.defaultdict(list)
    for i, t, s in rows:
        source[i].append((s, size(t)))
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and r.taken % max(1, r["size"]) == 0
        s = next(s for s, n in source[r["_id"]] if n == r["size"] and total[s] == r.source_size)
        assert abs(r.target - target[s]) < 1e-6
        by_source[s] += r.taken
    again = mixing.mix_sources(texts(spark, rows)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert sum(r.copies for r in out) == mixing.repeat_rows(texts(spark, rows)).count()
    assert mixing.mix_sources(texts(spark, [])).count() == 0


def test_mixture_is_near_its_targets(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(i, f"s{i % 7}", r.randint(1, 200)) for i in range(7000)], "doc_id long, source string, w int")
    got = mixing.mix_sources(df, size=F.col("w").cast("long")).join(df.withColumnRenamed("doc_id", "_id"), "_id").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(x.t - x.g) <= 110 for x in got)


def test_quality(spark, rows):
    got = quality.quality_rules(texts(spark, rows)).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules").collect()
    assert len(got) == len(rows)
    for r in got:
        t = r.text or ""
        w = WORD.findall(t)
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert r.kept == (not r.base_failed and not r.failed_rules)
    assert quality.quality_rules(texts(spark, [])).count() == 0


def test_quality_keeps_prose_and_rejects_junk(spark):
    r = random.Random(3)
    prose = " ".join(r.choice(["the", "river", "and", "hills", "of", "winter", "seem", "quiet", "stone", "garden"]) + ("" if i % 3 else "abcdefgh"[i % 8]) for i in range(90))
    junk = " ".join(f"word{i}&&&" for i in range(90))
    got = {r.doc_id: r.kept for r in quality.quality_rules(texts(spark, [(1, prose, "a"), (2, junk, "a"), (3, None, "a")])).collect()}
    assert got[1] is True and got[2] is False and got[3] is False


def test_quality_of_a_very_long_text_and_clashing_columns(spark):
    r = random.Random(3)
    long = "\n".join(" ".join(r.choice(["the", "river", "and", "hills", "of"]) + str(r.randrange(3000)) for _ in range(40)) for _ in range(1500))
    df = spark.createDataFrame([(1, long, "mine"), (2, long, None)], "doc_id long, text string, __words string")
    got = quality.quality_rules(df).collect()
    assert [x.n_words for x in got] == [60_000] * 2 and sorted(str(x["__words"]) for x in got) == ["None", "mine"]


def test_words_end_at_all_white_space(spark):
    text = "a\rb\x0bc\x0cd\te\nf g\x85h\xa0i"
    assert mixing.mix_sources(texts(spark, [(1, text, "a")])).first()["size"] == 7
    assert quality.quality_rules(texts(spark, [(1, text, "a")])).first()["n_words"] == 7
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT 1::BIGINT AS doc_id, 'a' AS source, ?::VARCHAR AS text", [text])
    assert con.execute("SELECT size FROM (" + mixing.OP1_SQL + ")").fetchone() == (7,)
    assert con.execute("SELECT n_words FROM (" + quality.OP2_SQL + ")").fetchone() == (7,)

def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_ngram_join(spark, rows):
    sets = [(i, shingles(t)) for i, t, _ in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(x)] = find(y)
    least = collections.defaultdict(list)
    for x, (i, _) in enumerate(sets):
        least[find(x)].append(i)
    want = collections.Counter((i, len(s), min([j for j in least[find(x)] if j is not None], default=None)) for x, (i, s) in enumerate(sets))
    got = collections.Counter(tuple(r) for r in ngram_join.ngram_jaccard_join(texts(spark, rows)).collect())
    assert got == want
    assert ngram_join.ngram_jaccard_join(texts(spark, [])).count() == 0


def covered(places, least):
    """Flags of what strings that start at the given places cover."""
    out = [False] * (max(places, default=-1) + least)
    for p in places:
        out[p : p + least] = [True] * least
    return out


def suffix_dedup_by_force(data, least, words):
    """(id, bytes, removed, spans, sha256, words in passages) of each row."""
    raw = [(t or "").encode() for _, t, _ in data]
    count = collections.Counter(b[i : i + least] for b in raw for i in range(len(b) - least + 1))
    owners = collections.defaultdict(set)
    split = [b.split() for b in raw]
    for (i, _, _), b, w in zip(data, raw, split):
        for k in range(len(w) - words + 1):
            owners[tuple(w[k : k + words])].add((i, b))
    out = collections.Counter()
    for (i, _, _), b, w in zip(data, raw, split):
        gone = covered([k for k in range(len(b) - least + 1) if count[b[k : k + least]] > 1], least)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = b"".join(b[k : k + 1] for k, g in enumerate(gone) if not g) + b[len(gone) :]
        passages = sum(covered([k for k in range(len(w) - words + 1) if len(owners[tuple(w[k : k + words])]) > 1], words))
        out[i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), passages] += 1
    return out


@pytest.mark.parametrize("large", [suffix_dedup.LARGE, 1])
def test_suffix_dedup(spark, rows, large):
    passage = " ".join(f"w{i}" for i in range(51))
    data = [*rows, (200, "a" * 900, "a"), (201, "b" + "a" * 450 + "c", "a"), (210, "x " + passage + " y", "a"), (211, passage.replace(" ", "\n\t") + " z", "a"), (212, passage[:-1] + "!", "a"), (213, passage.upper() + " " + passage.upper(), "a")]
    got = suffix_dedup.suffix_dedup(texts(spark, data), counted=suffix_dedup.WORDS, large=large).collect()
    assert collections.Counter(tuple(r) for r in got) == suffix_dedup_by_force(data, 400, 51)
    assert {r.doc_id: r.n_passage_words for r in got if r.doc_id in range(210, 214)} == {210: 51, 211: 51, 212: 0, 213: 0}
    assert suffix_dedup.suffix_dedup(texts(spark, []), counted=suffix_dedup.WORDS).count() == 0


def test_suffix_dedup_of_long_texts(spark):
    r = random.Random(8)
    word = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9))) for _ in range(5000)]
    long = " ".join(r.choice(word) for _ in range(110_000))
    assert len(long) > suffix_dedup.BLOCK
    data = [(1, long, "a"), (2, "q " + long[520_000:521_500], "a"), (3, long[3:600] + long[100_000:100_399], "a"), (4, "z" * 530_000, "a")]
    got = suffix_dedup.suffix_dedup(texts(spark, data), counted=suffix_dedup.WORDS).collect()
    assert collections.Counter(tuple(r) for r in got) == suffix_dedup_by_force(data, 400, 51)


def test_removal_of_words(spark):
    passage = " ".join(f"w{i}" for i in range(51))
    data = [(1, "start " + passage + "  end", "a"), (2, passage, "a"), (3, "short", "a"), (4, None, "a")]
    got = suffix_dedup.suffix_dedup(texts(spark, data), removed=(suffix_dedup.BYTES, suffix_dedup.WORDS), keep_text=True).collect()
    assert {r.doc_id: (r.kept_text, r.n_spans) for r in got} == {1: ("start   end", 1), 2: ("", 1), 3: ("short", 0), 4: ("", 0)}


def test_suffix_arrays():
    r = random.Random(2)
    for trial in range(60):
        letters, least, width = r.choice([b"ab", b"abc", bytes(range(256))]), r.choice([3, 8, 9, 16, 50]), 1 + trial % 2
        pieces = [bytes(r.choice(letters) for _ in range(width * r.randint(least, 120))) for _ in range(r.randint(1, 6))] + [b"a" * 100] * (trial % 3)
        owners = np.array([r.choice([-1, 0, 1]) for _ in pieces]) if trial % 4 == 0 else None
        starts = [(p, i) for p, x in enumerate(pieces) for i in range(len(x) // width - least + 1)]
        string = lambda p, i: pieces[p][width * i : width * (i + least)]
        seen = collections.defaultdict(list)
        for p, i in starts:
            seen[string(p, i)].append(0 if owners is None else int(owners[p]))
        several = lambda o: len(o) > 1 and (owners is None or min(o) < 0 or len(set(o)) > 1)
        want = {(p, i) for p, i in starts if several(seen[string(p, i)])}
        got = [(int(p), i) for p, a, b in zip(*suffix_dedup.repeated_starts(pieces, least, width, owners)) for i in range(a, b + 1)]
        assert len(got) == len(set(got)) and set(got) == want


TRICKY = ["", "  ", "  a", "It's we'll 'S x'T 123 a1b2!!??...", "İSTANBUL Σίσυφος ΣΑΣ", "é ́e á", "<|endoftext|>x y<|startoftext|> <|endoftext|>", "日本語テキスト 😀👍🏽 ​ 　z", "a\x00b \x1c\x1d c \x85 d\xa0e", "ﬁ Å ǅ K ſ ß ẞ", "thwhqx zzxxqq"]


def test_bpe_is_the_library(spark, rows):
    from tokenizers import Tokenizer

    path = bpe.word_bpe_path()
    library = Tokenizer.from_file(path)
    r = random.Random(1)
    data = [*rows, *[(300 + i, t, "t") for i, t in enumerate(TRICKY)], *[(400 + i, "".join(r.choice("aAéÉßΣ'’ \n\t\xa0!?9٣x😀́<|>tT") for _ in range(r.randint(1, 60))), "t") for i in range(300)]]
    want = collections.Counter()
    for i, t, _ in data:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    df = texts(spark, data)
    assert collections.Counter(tuple(x) for x in bpe.bpe_digests(df, path).collect()) == want
    whole = bpe.bpe_decode(bpe.bpe_encode(df, path), path).select("doc_id", F.expr("length(token_ids) div 4"), F.sha2("token_ids", 256), F.sha2("decoded", 256))
    assert collections.Counter(tuple(x) for x in whole.collect()) == want
    assert bpe.bpe_digests(texts(spark, []), path).count() == 0


def test_lm_scores(spark, rows, monkeypatch):
    kept = {}
    learn = lm_score.learn_weights
    monkeypatch.setattr(lm_score, "learn_weights", lambda *a: kept.setdefault("w", learn(*a)))
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = lm_score.lm_scores(texts(spark, rows), train).collect()
    token = lambda t: [*WORD.findall((t or "").translate(LOWER)), "\n"]
    learned = [token(t) for i, t, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for t in learned for w in t)
    pair = collections.Counter(p for t in learned for p in zip(["^", *t], t))
    before = collections.Counter(p for t in learned for p in ["^", *t[:-1]])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t, _ in rows:
        own, s = token(t), 0.0
        for a, b in zip(["^", *own], own):
            w = kept["w"][:, int(lm_score.context_bucket(np.array([before[a]]))[0])]
            s += math.log10(w[0] * (pair[a, b] / before[a] if before[a] else 0) + w[1] * c[b] / n + w[2] / (v + 1))
        want.append((str(i), len(own), sum(c[w] > 0 for w in own), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), 6), round(s, 6)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)
    none = lm_score.lm_scores(texts(spark, rows[:3]), F.lit(False)).collect()
    assert all(r.score == 0 and r.held_out for r in none)
    assert lm_score.lm_scores(texts(spark, []), train).count() == 0


def test_lm_beats_its_base_on_held_out_texts(spark, sf_dir):
    got = lm_score.op6_lm_score(spark, sf_dir).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


REPLY = {"add": {"a": ("integer", True), "b": ("number", False)}, "say": {"text": ("string", True)}}


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, "x", 0, "add", '{"b": 2.5, "a": 1}', []), (1, "y", 1, "add", '{"a": "1", "c": 0}', ["x"]), (1, "z", 2, "nope", "{}", ["y", "gone"]), (2, "p", 0, "say", '{"text":"é\\n"}', ["q"]), (2, "q", 1, "say", "broken", []),
         (3, "c", 0, "say", '{"text":"a"}', ["d"]), (3, "d", 1, "say", '{"text":"b"}', ["c"]), (3, "d", 5, "say", '{"text":"later"}', []), (None, "n", 0, "say", '{"text":"t"}', [])],
        "conv long, call string, at int, name string, arguments string, needs array<string>",
    )
    results = spark.createDataFrame([(1, "x", "3"), (1, "y", None), (9, "x", "alone"), (2, "q", "b"), (2, "q", "a")], "conv long, call string, content string")
    rows = chat.link_tool_calls(calls, results, REPLY).collect()
    assert [(r.status, r.json) for r in rows if (r.conv, r.call, r.at) == (2, "q", None)] == [("repeated", '{"arguments":null,"content":"b","id":"q","name":null}')]
    got = {(r.conv, r.call, r.at): r for r in rows}
    assert len(rows) == len(got) == 11
    assert got[1, "x", 0].json == '{"arguments":{"a":1,"b":2.5},"content":"3","id":"x","name":"add"}' and got[1, "x", 0].problems == []
    assert got[1, "y", 1].problems == ["a: not integer", "c: unknown"] and got[1, "y", 1].status == "linked"
    assert got[1, "z", 2].problems == ["unknown tool"] and got[1, "z", 2].status == "no result"
    assert got[2, "q", 1].problems == ["not an object"] and json.loads(got[2, "q", 1].json) == {"arguments": "broken", "content": "a", "id": "q", "name": "say"}
    assert (got[2, "q", 1].level, got[2, "p", 0].level) == (0, 1) and json.loads(got[2, "p", 0].json)["arguments"] == {"text": "é\n"}
    assert got[3, "c", 0].status == "cycle" and got[3, "d", 1].status == "cycle" and got[3, "d", 5].status == "repeated"
    assert got[9, "x", None].status == "no call" and got[None, "n", 0].status == "no result"
    assert chat.link_tool_calls(calls.limit(0), results.limit(0), REPLY).count() == 0


def test_toxicity_learns_words_and_ignores_the_rest(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    data, labels = [], []
    for i in range(600):
        t = [r.choice(words) for _ in range(60)]
        if i % 5 == 0:
            t[r.randrange(60)] = r.choice(["vile", "rotten"])
        data.append((i, " ".join(t), "s"))
        labels.append((i, int(i % 5 == 0)))
    docs = texts(spark, [*data, (None, None, None), (700, "", "s"), (1, data[1][1], "s")])
    marks = spark.createDataFrame([*labels[:400], (900, 1), (3, None)], "doc_id long, label int")
    got = {(x.doc_id, x.text): x.score for x in toxicity.score(docs, toxicity.train(docs, marks)).collect()}
    held = [(got[i, t] >= toxicity.THRESHOLD) == (i % 5 == 0) for i, t, _ in data[400:]]
    assert sum(held) / len(held) > 0.95 and 0 <= got[None, None] == got[700, ""] < toxicity.THRESHOLD
    empty = toxicity.train(docs, marks.limit(0))
    assert {x.score for x in toxicity.score(docs, empty).collect()} == {0.5}


def test_levels_of_tool_calls(spark):
    """Chains, trees, cycles, what hangs on them, and calls with several needs, against depth-first search; repeated rows stay."""
    r = random.Random(4)
    needs = {}
    for conv in range(12):
        for k in range(12):
            if conv < 4:
                own = [f"c{k - 1}"] if k and r.random() < 0.9 else []
            elif conv < 8:
                own = [f"c{r.randrange(12)}"]
            else:
                own = [f"c{r.randrange(14)}" for _ in range(r.randrange(3))]
            needs[conv, f"c{k}"] = own

    def level(node, path=()):
        if node in path:
            return None
        below = [level((node[0], n), (*path, node)) for n in needs[node] if (node[0], n) in needs]
        return None if None in below else 1 + max(below, default=-1)

    rows = [(c, k, int(k[1:]), "say", '{"text":"a"}', n) for (c, k), n in needs.items()]
    calls = spark.createDataFrame([*rows, rows[0], rows[0]], "conv long, call string, at int, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([(0, "c0", "x")] * 3, "conv long, call string, content string")
    got = chat.link_tool_calls(calls, results, REPLY).collect()
    assert collections.Counter(x.status for x in got)["repeated"] == 4 and len(got) == len(rows) + 4
    found = {(x.conv, x.call): None if x.status == "cycle" else x.level for x in got if x.status != "repeated"}
    assert found == {n: level(n) for n in needs}


def plain_ftrl(rows, labels, how, seed=7):
    """FTRL-proximal, coordinate by coordinate."""
    z, n, order = collections.defaultdict(float), collections.defaultdict(float), np.random.default_rng(seed)
    share = sum(labels) / len(labels)
    bias, bias_n = math.log(max(share, 1e-3) / max(1 - share, 1e-3)), 0.0

    def weight(k):
        if abs(z[k]) <= how.l1:
            return 0.0
        return -(z[k] - math.copysign(how.l1, z[k])) / ((how.beta + math.sqrt(n[k])) / how.alpha + how.l2)

    for _ in range(how.epochs):
        for i in order.permutation(len(rows)):
            w = {k: weight(k) for k in rows[i].tolist()}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - labels[i]
            for k in w:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / how.alpha * w[k]
                n[k] += g * g
            bias_n += g * g
            bias -= 0.05 * g / (1 + math.sqrt(bias_n))
    return {k: v for k in z if (v := weight(k))}, bias


def test_ftrl_against_its_definition():
    r = random.Random(5)
    text = lambda i: " ".join(r.choice("abcdefghijklmnop") * 3 for _ in range(r.randint(0, 30))) + (" vile" if i % 3 == 0 else "")
    docs = [text(i).encode() for i in range(120)]
    labels = np.array([float(i % 3 == 0) for i in range(120)])
    how = toxicity.Ftrl(l1=0.5)
    at, w, bias = toxicity.fit_ftrl(toxicity.features(docs), labels, how)
    want, want_bias = plain_ftrl(toxicity.features(docs), labels, how)
    assert set(at.tolist()) == set(want) and abs(bias - want_bias) < 1e-9
    assert all(abs(want[k] - x) < 1e-9 for k, x in zip(at.tolist(), w))


def test_toxicity_is_the_definition_on_tables(spark):
    r = random.Random(6)
    data = [(i, " ".join(r.choice("abcdefg") * 2 for _ in range(20)) + " vile" * (i % 4 == 0), "s") for i in range(200)]
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 200, 2)], "doc_id long, label int")
    order = spark.createDataFrame([(i, t) for i, t, _ in data if i % 2 == 0], "doc_id long, text string").select("text", F.xxhash64("doc_id").alias("h"), (F.col("doc_id") % 4 == 0).cast("double").alias("y")).orderBy("h").collect()
    want, bias = plain_ftrl(toxicity.features([x.text.encode() for x in order]), [x.y for x in order], toxicity.Ftrl())
    for x in toxicity.score(texts(spark, data), toxicity.train(texts(spark, data), marks)).collect():
        s = bias + sum(want.get(k, 0.0) for k in toxicity.features([x.text.encode()])[0].tolist())
        assert abs(x.score - 1 / (1 + math.exp(-s))) < 1e-9


def plain_em(cells, uniform):
    """Deleted interpolation's EM, one held-out token class after the other; cells are (bucket, bigram estimate, unigram estimate, count)."""
    weights = {b: [0.4, 0.5, 0.1] for b in range(lm_score.BUCKETS)}
    for _ in range(lm_score.ROUNDS):
        new = {b: [0.0] * 3 for b in weights}
        for b, p2, p1, c in cells:
            part = [w * p for w, p in zip(weights[b], (p2, p1, uniform))]
            for k in range(3):
                new[b][k] += c * part[k] / sum(part)
        weights = {b: [x / sum(new[b]) for x in new[b]] if sum(new[b]) else weights[b] for b in weights}
    return weights


def test_em_against_its_definition():
    r = random.Random(9)
    cells = sorted({(r.randrange(6) * lm_score.BINS + r.choice([0, *range(1, 60)])) * lm_score.BINS + r.choice([0, *range(20, 90)]) for _ in range(300)})
    counts = [r.randint(1, 50) for _ in cells]
    estimate = lambda x: 2.0 ** (-(x - 1) / lm_score.STEPS) if x else 0.0
    plain = plain_em([(c // lm_score.BINS**2, estimate(c // lm_score.BINS % lm_score.BINS), estimate(c % lm_score.BINS), n) for c, n in zip(cells, counts)], 1e-4)
    got = lm_score.learn_weights(np.array(cells), np.array(counts, float), 1e-4)
    for b in range(1, 6):
        assert max(abs(x - y) for x, y in zip(got[:, b], plain[b])) < 1e-6


def test_shards(spark, rows):
    for n in (1, 2, 3, 17, 1000):
        assert sorted(token_shards.feistel(np.arange(n), n, 9).tolist()) == list(range(n))
    layout = token_shards.Layout(length=16, per_shard=10, waves=2)
    path, manifest = token_shards.write_shards(texts(spark, rows), layout=layout)
    records = {r.slot: np.frombuffer(r.record, "<u2") for r in token_shards.read_shards(spark, path, layout).collect()}
    manifest = manifest.collect()
    assert sorted(records) == sorted(r.slot for r in manifest) == list(range(len(records)))
    encoding = token_shards.encoding(token_shards.byte_bpe_path())
    want = collections.Counter()
    for i, t, _ in rows:
        ids = [*encoding.encode_ordinary(t or ""), token_shards.END]
        want.update((i, s, tuple(ids[s * 16 : s * 16 + 16])) for s in range(-(-len(ids) // 16)))
    assert collections.Counter((r["_id"], r.seq, tuple(records[r.slot][: r.n_tokens].tolist())) for r in manifest) == want
    assert {r.slot for r in token_shards.read_shards(spark, path, layout, from_slot=25).collect()} == set(range(25, len(records)))
    assert token_shards.write_shards(texts(spark, []), layout=layout)[1].count() == 0


def test_slots_depend_on_the_rows_alone(spark, rows):
    layout = token_shards.Layout(length=16, per_shard=10, waves=2)
    df = texts(spark, rows)
    a, b = (sorted(map(str, token_shards.write_shards(x, layout=layout)[1].collect())) for x in (df.repartition(1), df.repartition(7)))
    assert a == b


def test_embeddings(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((40, 16))
    vectors = [(i, v.tolist()) for i, v in enumerate(base)]
    vectors += [(100 + i, (base[i % 10] + 0.12 * r.standard_normal(16)).tolist()) for i in range(60)]
    vectors += [(5, base[5].tolist()), (300, None), (301, [0.0] * 16), (302, [float("nan"), *base[1][1:].tolist()]), (303, [None, *base[1][1:].tolist()]), (304, [1.0]), (305, [2.0]), (306, [-3.0]), (307, [1.0, 0.0]), (308, [2.0, 0.1]), (309, [0.0, 1.0]), (310, []), (None, base[0].tolist()), (None, (-base[3]).tolist())]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, n_links int, kept int")
    good = [k for k, (i, v) in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v)]
    near = np.array([[len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9 for b in (vectors[k][1] for k in good)] for a in (vectors[k][1] for k in good)])
    reach = near.copy()
    for _ in range(8):
        reach = reach @ reach
    want = collections.Counter()
    for k, (i, _) in enumerate(vectors):
        if k in good:
            g = good.index(k)
            least = min([vectors[good[h]][0] for h in np.flatnonzero(reach[g]) if vectors[good[h]][0] is not None], default=None)
            n = int(near[g].sum()) - 1
        else:
            least, n = i, 0
        want[i, n, least, n == 0 if i is None else i == least] += 1
    assert collections.Counter(tuple(r) for r in embedding_dedup.embedding_near_dups(df).collect()) == want
    assert embedding_dedup.embedding_near_dups(df.limit(0)).count() == 0


def test_places_of_cells():
    r = np.random.default_rng(3)
    counts = r.integers(0, 30, (12, 12)) * (r.random((12, 12)) < 0.5)
    counts[4, 5], counts[7] = 950, 0
    places = embedding_dedup.placed_cells(counts, 100)
    held = collections.Counter()
    for i, j in zip(*np.nonzero(counts)):
        for part in range(places.many[i, j]):
            held[i, places.first[i, j] + part] += counts[i, j] / places.many[i, j]
    assert max(held.values()) <= 100 and len({p for _, p in held}) == len(held) and sum(held.values()) == counts.sum()
    assert (places.first < 0).sum() == (counts == 0).sum() and places.number == 1 + max(p for _, p in held)


def test_embedding_recall(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((1500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = r.standard_normal((1500, 32))
    off -= (off * base).sum(1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    x = np.concatenate([base, 0.905 * base + math.sqrt(1 - 0.905**2) * off])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = embedding_dedup.embedding_near_dups(df, how=embedding_dedup.Index(most_rows=1000, chunk=64))
    got = found.agg(F.sum("n_links")).first()[0]
    assert embedding_dedup.measured_recall(df, found) >= 0.9
    links = (x @ x.T >= 0.9).sum() - len(x)
    assert 0.9 * links <= got <= links


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 340)] + [(1, 1), (None, 2)]
    got = {x.node: x.root for x in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    assert got == {v: find(v) for v in root}


def test_word_hashes_depend_on_the_word_alone():
    a, s = textnum.hashed_words([b"x yy  zz", b"", b"\tyy x"], True)
    assert s.tolist() == [0, 3, 3, 5] and a[0] == a[4] and a[1] == a[3] and len(set(a.tolist())) == 3
