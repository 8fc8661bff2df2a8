import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import compare as C
from tallyloom.functions import ratio as R
from tallyloom.plans import effects


def texts(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        letters = r.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz   e", "é𝄞ab "])
        word = lambda most: "".join(r.choice(letters) for _ in range(r.randint(0, most)))  # noqa: B023, E731
        a = word(r.choice([5, 60, 199, 300, 900]))
        b = list(a) if r.random() < 0.4 else list(word(r.choice([9, 60, 201, 250, 700])))
        for _ in range(r.randint(0, 5)):
            at = r.randint(0, len(b))
            b[at : at + r.randint(0, 4)] = list(word(5) + "XY")
        yield a, "".join(b)


@pytest.mark.parametrize("most", [12_000_000, 50])
@pytest.mark.parametrize("long", [0, 160])
def test_ratios_equal_difflib(monkeypatch, most, long):
    monkeypatch.setattr(R, "MOST_PAIRS", most)
    monkeypatch.setattr(R, "LONG", long)
    for a, b in texts(3, 150):
        want = SequenceMatcher(None, a, b).ratio()
        assert R.text_ratio(a, b) == R.list_ratio(list(a), list(b)) == want <= R.most(a, b)


def test_long_texts_are_matched_without_a_step_for_each_element(monkeypatch):
    """difflib never runs for them: it takes about five times as long."""
    monkeypatch.setattr("difflib.SequenceMatcher.find_longest_match", lambda *_: 1 / 0)
    r = random.Random(5)
    a, b = (" ".join("".join(r.choice("etaoinshrdlu" * 9 + "ABCDEFGHIJKLMNOPQ") for _ in range(6)) for _ in range(800)) for _ in range(2))
    assert 0 < R.text_ratio(a, b) < 1


def test_best_of_three_forms(spark):
    rows = [(a, b) for a, b in texts(4, 60) if a and b and a != b]
    df = spark.createDataFrame(rows, "a string, b string")
    forms = [(C.normalise_printed(F.col(c)), C.sorted_tokens(C.normalise_printed(F.col(c)))) for c in "ab"]
    got = C.text_similarity(df, "a", "b").select("a", "b", "similarity", *[f.alias(n) for n, f in zip(["na", "sa", "nb", "sb"], [*forms[0], *forms[1]], strict=True)]).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.similarity == max(SequenceMatcher(None, p, q).ratio() for p, q in [(x.a, x.b), (x.na, x.nb), (x.sa, x.sb)])


@pytest.mark.parametrize("grams", [(3, 1), (1,)])
@pytest.mark.parametrize("limits", [(1 << 17, 1 << 20, 32), (400, 3000, 2)])
def test_many_pairs_at_once_equal_difflib(monkeypatch, grams, limits):
    for name, value in zip(["GRAMS", "CHARACTERS", "AT_ONCE", "STEPS"], [grams, *limits], strict=True):
        monkeypatch.setattr(R, name, value)
    start = "the same words of both " * 90
    odd = [("", ""), ("", "a"), ("a", ""), ("\ud800x", "x\ud800"), ("\0a", "a\0"), ("a" * 199, "a" * 150), ("a" * 300, "a" * 301), (start + "x", start + "y")]
    rows = odd + list(texts(6, 150))
    a, b = ([r[n] for r in rows] for n in (0, 1))
    want = np.array([SequenceMatcher(None, p, q).ratio() for p, q in rows])
    assert (R.text_ratios(a, b, np.zeros(len(rows))) == want).all()
    assert (R.text_ratios(a, b, np.full(len(rows), 0.4)) == np.maximum(want, 0.4)).all()


def test_ordinary_texts_are_not_matched_one_by_one(monkeypatch):
    rows = list(texts(7, 80))
    want = [SequenceMatcher(None, a, b).ratio() for a, b in rows]
    monkeypatch.setattr(R, "matches", lambda *_: 1 / 0)
    assert R.text_ratios([a for a, _ in rows], [b for _, b in rows], np.zeros(len(rows))).tolist() == want


def test_pairs_of_single_characters_are_not_held(monkeypatch):
    """Ordinary texts share many pairs of characters and few of two in a row; what has more than fit at once would go to ``matches``."""
    r = random.Random(8)
    words = ["".join(r.choice("etaoinshrdlu" * 9 + "bcfgkmpqvwxyzABCDEFGHIJKLMNOPQ") for _ in range(r.randint(1, 9))) for _ in range(900)]
    a, b = (" ".join(r.choice(words) for _ in range(1200)) for _ in range(2))
    rows = [(a, b), (b, a)]
    want = [SequenceMatcher(None, p, q).ratio() for p, q in rows]
    monkeypatch.setattr(R, "AT_ONCE", 2_000)
    monkeypatch.setattr(R, "matches", lambda *_: 1 / 0)
    assert R.text_ratios([p for p, _ in rows], [q for _, q in rows], np.zeros(len(rows))).tolist() == want


def test_printed_texts_are_joined_once(spark, tmp_path):
    rows = [(1, 0, "same"), (1, 1, "same"), (1, 2, "some"), (1, 3, None), (1, 4, None), (2, 0, "")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    df = effects.stdout_compare(spark, str(tmp_path))
    assert {x.turn: (x.similarity, x.verdict) for x in df.collect()} == {0: (1.0, "pass"), 1: (0.75, "fail"), 2: (0.0, "fail"), 3: (1.0, "pass")}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
