import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import compare as C
from tallyloom.functions import scalar as S
from tallyloom.operators import evidence as E
from tallyloom.operators import graph as G
from tallyloom.operators import joins as J
from tallyloom.operators import scoring as R
from tallyloom.operators import windows as W
from tallyloom.plans import effects
from tallyloom.sources import readers


def test_fresh_ids_skip_those_in_use(spark):
    r = random.Random(1)
    rows = [(i, r.choice("abc")) for i in range(60)]
    taken = {x for b in "abd" for x in ([b] if r.random() < 0.5 else []) + [f"{b}-{r.randrange(1, 40)}" for _ in range(15)]}
    got = {x.n: x.id for x in W.allocated_ids(spark.createDataFrame(rows, "n int, base string"), spark.createDataFrame([(t,) for t in taken], "id string"), "base", ["n"]).collect()}
    used, want = set(taken), {}
    for n, base in rows:
        name, k = base, 0
        while name in used:
            k += 1
            name = f"{base}-{k}"
        used.add(name)
        want[n] = name
    assert got == want


def test_places_of_all_rows(spark):
    rows = [(i, (i * 7) % 13) for i in range(500)]
    got = {x.i: x.p for x in R.numbered(spark.createDataFrame(rows, "i int, v int"), [F.desc("v"), "i"], "p", 7).collect()}
    assert got == {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert R.numbered(spark.createDataFrame([], "i int"), ["i"], "p").count() == 0


def test_whole_printed_texts_are_compared(spark, tmp_path):
    start = " ".join(f"word{i}" for i in range(60))
    rows = [(1, 0, "user", start + " x" * 50), (1, 1, "assistant", start + " other"), (1, 2, "user", start + " other")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {x.turn: x for x in effects.stdout_compare(spark, str(tmp_path)).collect()}
    sort = lambda t: " ".join(sorted(t.split()))
    best = max(SequenceMatcher(None, a, b).ratio() for a, b in ((rows[0][3], rows[1][3]), (sort(rows[0][3]), sort(rows[1][3]))))
    assert got[0].similarity == round(best, 6) and got[0].verdict == "fail" and got[1].similarity == 1 and got[1].verdict == "pass"


def test_walk_of_a_tree(spark):
    edges = spark.createDataFrame([("a", "c", 2), ("a", "b", 10), ("c", "d", 1)], "parent string, child string, ord long")
    roots = spark.createDataFrame([("a", 1)], "node string, ord long")
    assert [x.node for x in G.preorder(edges, roots).orderBy("path").collect()] == ["a", "c", "d", "b"]
    with pytest.raises(ValueError, match="below itself"):
        G.preorder(edges.union(spark.createDataFrame([("d", "a", 1)], edges.schema)), roots)


def test_captured_state(spark):
    v = lambda t: spark.createDataFrame([(t,)], "t string").select(S.decoded_state(F.col("t")).alias("m")).first()["m"]
    assert v('{"a": NaN, "b": [1, -Infinity], "c": "[1]", "d": "text", "e": "\\"x\\""}') == {"a": "null", "b": '[1,"-Inf"]', "c": "[1]", "d": '"text"', "e": '"x"'}
    assert v("broken") == {} and v(None) == {} and v("[1]") == {}


def test_braces_outside_of_strings_and_comments(spark):
    lines = {"f <- function() {": 1, "} # }": -1, 'x <- "{{"': 0, "if (a) { b } else {": 1, "": 0}
    got = {x.l: x.d for x in spark.createDataFrame([(t,) for t in lines], "l string").withColumn("d", S.brace_depth(F.col("l"))).collect()}
    assert got == lines


def test_retrieval_decides_on_the_index_before_admission(spark):
    rows = [("p.k.one", "p", "contradicted", False, 0, "x"), ("q.k.two", "q", "confirmed", False, 0, "name x"), ("q.z.three", "q", "confirmed", False, 0, "name"), ("general", "", "tentative", True, 0, "y"), ("weak", "", "tentative", False, 1, "name")]
    patterns = spark.createDataFrame(rows, "id string, package string, confidence string, seed boolean, real_evidence int, guidance string")
    queries = spark.createDataFrame([(1, "p", "k", "name"), (2, "q", "k", "name"), (3, "other", "z", "name"), (4, None, "none", "name")], "query int, package string, kind string, text string")
    got = {}
    for r in E.retrieve(queries, patterns, 3, blocks=2).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r.id, r.tier))
    assert got == {2: [("q.k.two", 0), ("q.z.three", 0)], 3: [("q.z.three", 1), ("q.k.two", 1), ("general", 1)], 4: [("general", 0), ("q.z.three", 1), ("q.k.two", 1)]}
    assert E.retrieve(queries, patterns, 3, no_seeds=True).where("id = 'general'").isEmpty()


def test_files_of_one_side_only(spark):
    side = lambda rows: spark.createDataFrame(rows, "g int, path string, hash string")
    got = {r.g: r.score for r in J.files_score(side([(1, "a", "x"), (1, "b", "y"), (2, "a", None)]), side([(1, "a", "x"), (3, "a", "x")]), "g").collect()}
    assert got == {1: 0.5, 2: 1.0, 3: 0.0}


def test_snapshot_of_heads(spark, tmp_path):
    (tmp_path / "a").write_text("x" * 5000 + "a")
    (tmp_path / "b").write_text("x" * 5000 + "b")
    rows = readers.sampled_snapshot(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and rows[0]["hash"] == rows[1]["hash"] and readers.sampled_snapshot(spark, str(tmp_path), most=1).count() == 1


def test_first_lines_that_differ(spark):
    lines = lambda rows: spark.createDataFrame(rows, "g int, line int, text string")
    a = lines([(1, i, "x") for i in range(6)] + [(2, 0, "x"), (2, 1, "y")])
    b = lines([(1, i, "x" if i == 2 else "y") for i in range(6)] + [(2, 0, "z")])
    assert [(r.line, r.more, r.note) for r in W.first_differences(a, b, "g").orderBy("g", "line").collect()] == [(0, True, None), (1, True, None), (3, True, None), (None, False, "uneven")]


def test_verdict_tags(spark):
    df = spark.createDataFrame([("a <verdict>Pass</verdict>",), ("none",), ("<verdict>later</verdict>",)], "t string")
    assert [r.v for r in df.select(C.judged(F.col("t")).alias("v")).collect()] == ["pass", "uncomparable", "uncomparable"]
