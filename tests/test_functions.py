from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import compare as C
from tallyloom.functions import scalar as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize(
    ("e", "a", "want"),
    [(None, None, "pass"), (1.0, None, "null_mismatch"), (1.0, 1.00000001, "pass"), (1.0, 2.0, "value"), (NAN, None, "pass"), (INF, INF, "pass"), (INF, -INF, "value"), (0.0, 1e-10, "pass")],
)
def test_pair_verdict(spark, e, a, want):
    df = spark.createDataFrame([(e, a)], "e double, a double")
    assert df.select(C.verdict(F.col("e"), F.col("a"), F.lit(True)).alias("v")).first()["v"] == want
    assert df.select(C.verdict(F.col("e"), F.col("a"), F.lit(None).cast("boolean")).alias("v")).first()["v"] == "missing"


def test_tolerance_is_relative_to_the_actual_side(spark):
    assert not value(spark, C.within(F.lit(0.0), F.lit(1e-8)))
    assert value(spark, C.within(F.lit(1000.0), F.lit(1000.0009)))
    assert value(spark, C.close(F.lit(1e-10), F.lit(0.0)))


@pytest.mark.parametrize(("a", "b", "want"), [([1, 2], [1], "infra"), ([1, 2], [1, 99], "value"), ([1, 2, 3], [1, 2, 3], "pass"), ([], [], "pass")])
def test_lists(spark, a, b, want):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<double>, b array<double>")
    assert df.select(C.list_verdict(F.col("a"), F.col("b")).alias("v")).first()["v"] == want


@pytest.mark.parametrize(("a", "b", "want"), [(0, 0, 1.0), (1, 1, 0.8), (0, 1, 0.0), (1, 0, 0.0)])
def test_exit(spark, a, b, want):
    assert value(spark, C.exit_score(F.lit(a), F.lit(b))) == want


def test_normalised_text(spark):
    assert value(spark, C.normalise_printed(F.lit('[1] TRUE  "a"\n[2] FALSE'))) == "True a False"
    assert value(spark, C.sorted_tokens(F.lit("b  a c"))) == "a b c"
    assert tuple(value(spark, C.request_key(F.lit("GET"), F.lit("HTTPS://Host/Path//?q=1")))) == ("GET", "https://host/path")
    assert tuple(value(spark, C.request_key(F.lit("GET"), F.lit("a/b;p=1#x")))) == ("GET", "://a/b")


def test_similarity_is_the_best_ratio(spark):
    rows = [("abc def", "abc def"), ("", "x"), ("a b c", "c b a"), ("hello world", "hello there"), (None, None)]
    got = {(r.a, r.b): r.similarity for r in C.text_similarity(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()}
    assert got["abc def", "abc def"] == 1 and got["", "x"] == 0 and got["a b c", "c b a"] == 1 and got[None, None] == 1
    assert got["hello world", "hello there"] >= SequenceMatcher(None, "hello world", "hello there").ratio()


def test_formals(spark):
    df = spark.sql("select array('x', '...', 'y') a, array('x', 'z') b, array('x', 'y', 'kwargs') c, map('k', '1') m, cast(map() as map<string,string>) e")
    row = df.select(C.formals_score(F.col("a"), F.col("b"), F.col("m"), F.col("m")).alias("p"), C.formals_score(F.col("a"), F.col("c"), F.col("e"), F.col("e")).alias("q"), C.formals_score(F.col("a"), F.col("c"), F.col("m"), F.col("e")).alias("r")).first()
    assert (round(row.p, 9), row.q, row.r) == (0.65, 1.0, 0.7)


def test_scalars(spark):
    v = lambda c: value(spark, c)
    assert v(S.rename_keyword(F.lit("f(lambda=1, lambda == 2)"), "lambda")) == "f(lambda_val=1, lambda == 2)"
    calls = {"x <- rnorm(5) # c": "rnorm", "1 + rnorm(5)": "rnorm", "y = mean(runif(2))": "mean", "# sample(3)": "", "# sample(3)\nSys.time()": "Sys.time", "  a.b <- read.csv ('f')": "read.csv", "library(dplyr)": "library", "": ""}
    assert {s: v(S.leading_call(F.lit(s))) for s in calls} == calls
    assert {s for s in calls if v(S.is_source(F.lit(s)))} == {"x <- rnorm(5) # c", "1 + rnorm(5)", "# sample(3)\nSys.time()", "  a.b <- read.csv ('f')"} and len(S.SOURCE_CALLS) == 27
    urls = {"https://github.com/a/b": "github", "https://github.com/a/b.R": "script", "http://x.org/p_1.0.tar.gz/": "cran", "https://cran.r-project.org/package=x": "cran", "http://x.org/a.r": "script", "https://rpubs.com/u/1": "rpubs", "http://x.org": "other"}
    assert {u: v(S.url_class(F.lit(u))) for u in urls} == urls
    assert v(C.normalise_printed(F.lit('[1] "#FFFFFF" TRUE #AbC, #12 #ABCDEF012 x#FFF'))) == "#ffffff True #abc #12 #ABCDEF012 x#fff"
    assert v(S.slug(F.lit("A b_C"))) == "a-b-c"
    assert v(S.preview(F.lit("abcdef"), 2)) == "ab…" and v(S.preview(F.lit("ab"), 2)) == "ab" and v(S.shortened(F.lit("abcdef"), 2)) == "ab... (4 more chars)"
    assert v(C.passes(F.lit("WARNINGS"), F.lit(0.95))) == "pass" and v(C.passes(F.lit("ENV"), F.lit(0.99))) == "fail" and v(C.passes(F.lit("?"), F.lit(1.0))) is None
    assert [v(S.finite(F.lit(x))) for x in (NAN, INF, -INF, 1.5)] == [None, "Inf", "-Inf", "1.5"]
    assert v(S.recency(F.lit("2024-01-01"), "2024-01-01")) == 1 and v(S.recency(F.lit("bad"), "2024-01-01")) == 0
    assert [str(v(S.easter(F.lit(y)))) for y in (2000, 2024, 2025)] == ["2000-04-23", "2024-03-31", "2025-04-20"]
    assert 0.01 < S.binomial_tail(9, 10) < 0.02


def test_printed_forms_with_and_without_marks(spark):
    rows = [("[1] a  b\n [2] TRUE",), ("x #AbC FALSE",), ("b\ta  'c'",), ("TRUEST",), ("",), (None,), ("c\n\nb a é Z",)]
    got = spark.createDataFrame(rows, "t string").select("t", C.normalise_printed(F.col("t")).alias("n"), C.sorted_tokens(F.col("t")).alias("s")).collect()
    assert [x.n for x in got] == ["a b True", "x #abc False", "b a c", "TRUEST", "", None, "c b a é Z"]
    assert [x.s for x in got] == ["TRUE [1] [2] a b", "#AbC FALSE x", "'c' a b", "TRUEST", "", None, "Z a b c é"]
