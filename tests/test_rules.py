"""Rules with values worked out by hand: trees of pages, tables after a crash, features, first differences."""

from pyspark.sql import functions as F

from tallyloom.functions.markup import dom_tokens
from tallyloom.operators import evidence as E
from tallyloom.operators import scoring as R
from tallyloom.operators import windows as W


def test_contents_of_pages():
    page = "<!DOCTYPE html><html><head><title>t</title><style>x</style></head>\n<body class='k'><p class='b a' id=\"i\"> one  two </p><input type='text'/></body></html>"
    assert dom_tokens(page) == ["<p .a.b #i>", "T:one two", "</p>", "<input [type=text]>", "</input>"]
    assert dom_tokens("<p>a<br>b</p><i>c</i>") == ["<p>", "T:a", "<br>", "T:b", "</br>", "<i>", "T:c", "</i>", "</p>"]  # </p> closes br
    assert dom_tokens("<html><head><meta charset='u'></head><body><b>x</b></body></html>") == []  # all of it within head
    assert dom_tokens("<html><b>x</b></html>") == ["<b>", "T:x", "</b>"] and dom_tokens("<b>x</b><html></html>") == ["<b>", "T:x", "</b>", "<html>", "</html>"]
    assert dom_tokens("") == [] and dom_tokens("</p>x") == ["T:x"] and dom_tokens("<p class=''>") == ["<p .>", "</p>"]
    assert len(dom_tokens("<i>" * 5000)) == 10_000


def test_tables_of_runs(spark):
    entities = spark.createDataFrame([(1, "click", True, True), (2, "click", True, False), (3, "other", True, False)], "id int, name string, lines boolean, before_crash boolean")
    side = spark.createDataFrame([(1, True, False, 0)], "id int, has_data boolean, has_stdout boolean, n_graphics int")
    actual = side.withColumns({"data": F.lit(0.6), "stdout": F.lit(1.0), "graphics": F.lit(1.0)})
    variables = spark.createDataFrame([("click", 0.25)], "name string, score double")
    table = lambda ran: {r.id: (r.executed_ok, r.data_output) for r in R.score_table(entities, side, actual, variables, ran, False, 0.9, 0.5, 0.5).collect()}
    assert table(True) == {1: (True, 0.6), 2: (True, 0.25), 3: (True, 0.9)}
    assert table(False) == {1: (True, 0.6), 2: (False, 0.0), 3: (False, 0.0)}


def test_features_of_patterns(spark):
    rows = [(1, "base", "call_x", "use base", "base-call", "base", "Use base now", "confirmed", 3, 1, "2024-01-01"), (2, "", "call", "a", "call", "", "b", "tentative", 0, 0, None), (3, None, "c", "a", "d", None, "a", "tentative", 0, 2, "2022-01-01")]
    df = spark.createDataFrame(rows, "query int, package string, kind string, text string, id string, p string, guidance string, confidence string, evidence int, contradictions int, reviewed string")
    got = {r["query"]: tuple(r)[2:] for r in E.features(df, "2024-01-01").collect()}
    assert got == {1: (1, 1 / 3, 2 / 3, 1, 3, 1, 0.6, 1.0), 2: (0, 1.0, 0.0, 0, 0, 0, 0.0, 0.0), 3: (0, 0.0, 1.0, 0, 0, 2, 0.0, 0.0)}


def test_first_differences_and_notes(spark):
    lines = lambda *groups: spark.createDataFrame([(g, i, t) for g, texts in groups for i, t in enumerate(texts)], "g string, line int, text string")
    a = lines(("same", "ab"), ("three", "abc"), ("two", "abc"), ("five", "abcde"), ("uneven", "ab"), ("gone", "a"))
    b = lines(("same", "ab"), ("three", "xyz"), ("two", "axy"), ("five", "vwxyz"), ("uneven", "abc"), ("new", "a"))
    got = {(r.g, r.line, r.more, r.note) for r in W.first_differences(a, b, "g").collect()}
    want = {("three", i, True, None) for i in range(3)} | {("five", i, True, None) for i in range(3)} | {("two", i, False, None) for i in (1, 2)}
    assert got == want | {("uneven", None, False, "uneven"), ("gone", None, False, "no_actual"), ("new", None, False, "no_expected")}


def test_likeness_of_callables(spark):
    from tallyloom.functions import compare as C

    rows = [(["x", "..."], ["x", "args", "kwargs"], 1.0, None), (["x", "args"], ["x"], 0.65, "infra"), (["x"], ["x", "..."], 0.65, "infra"), (["a", "b", "c"], ["x"], 0.3, "value"), ([], ["x"], 0.3, "value"), (["..."], [], 1.0, None)]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, a array<string>, b array<string>")
    none = F.create_map().cast("map<string,string>")
    like = F.round(C.formals_score(F.col("a"), F.col("b"), none, none), 9)
    got = df.select(C.callable_score(like).alias("s"), C.callable_tag(like).alias("t")).orderBy("i").collect()
    assert [(r.s, r.t) for r in got] == [r[2:] for r in rows]


def test_notes_of_conflicts(spark):
    rows = [("a", "p", "s", "Use  A", "confirmed"), ("b", "p", "s", "use b", "confirmed"), ("c", "p", "s", "use a", "confirmed"), ("d", "p", "t", "use d", "confirmed"), ("e", "p", "s", "use e", "tentative")]
    got = E.conflict_notes(spark.createDataFrame(rows, "id string, package string, shape string, guidance string, confidence string")).collect()
    assert [(r.id, r.package, r.confidence, r.seed) for r in got] == [("conflict_a_vs_b", "", "tentative", False)] and "`a` and `b`" in got[0].guidance
