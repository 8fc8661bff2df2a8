from tallyloom.sources import readers, writers
from tallyloom.streaming import evidence as stream


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.R").write_text("x <- 1\ny <- 2\n")
    (tmp_path / "b.txt").write_text("no")
    assert [r.text for r in readers.read_scripts(spark, str(tmp_path)).collect()] == ["x <- 1\ny <- 2\n"]
    (tmp_path / "m.lst").write_text("# c\n\n one \ntwo\n")
    assert [r.entry for r in readers.read_manifest(spark, str(tmp_path / "m.lst")).collect()] == ["one", "two"]
    assert readers.snapshot(spark, str(tmp_path)).count() == 3


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "s.csv").write_text("script_id,final_score,timestamp\ns,0.1,1\ns,0.5,2\nt,0.2,1\n")
    got = readers.read_scores(spark, str(tmp_path / "s.csv"), "script_id string, final_score double, timestamp int", "script_id", "timestamp")
    assert {(r.script_id, r.final_score) for r in got.collect()} == {("s", 0.5), ("t", 0.2)}


def test_patterns_round_trip(spark):
    rows = spark.createDataFrame([("p1", "dplyr", "confirmed", True, "Use x", ["s: 0.5", "t: 0.7"]), ("p2", "q", "confirmed", False, "y", [])], "id string, package string, confidence string, seed boolean, guidance string, evidence array<string>")
    assert sorted(map(tuple, readers.parse_patterns(writers.pattern_markdown(rows)).collect())) == sorted(map(tuple, rows.collect()))


def test_chunks(spark):
    df = spark.createDataFrame([("t\n```{r a}\nx <- 1\n```\n```{python}\nno\n```\n```{r}\ny\n```\n", "<code>a &lt; b</code><code>&amp;c</code>")], "text string, html string")
    assert [r.chunk for r in readers.code_chunks(df).collect()] == ["x <- 1\n", "y\n"]
    assert [r.block for r in readers.html_blocks(df, "html", "code").collect()] == ["a < b", "&c"]


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), (" ", 3), ("b", 4)], "text string, id int")
    known = spark.createDataFrame([], "hash string")
    writers.write_new_content(df, str(tmp_path / "c"), "text", known)
    stored = spark.read.parquet(str(tmp_path / "c"))
    writers.write_new_content(df, str(tmp_path / "c"), "text", stored)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, kind, float(d)) for k in "ab" for kind, d in (("evidence", 1), ("evidence", 0), ("tie", 0), ("contradiction", 0))]
    facts = spark.createDataFrame(rows, "key string, kind string, delta double")
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    for part in (facts.where("key = 'a'"), facts):
        part.write.mode("append").parquet(source)
        stream.stream_fold(spark, source, "key string, kind string, delta double", state, str(tmp_path / "cp"))
    got = spark.read.parquet(f"{state}/version=1").orderBy("key").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in stream.fold(facts.union(facts.where("key = 'a'"))).orderBy("key").collect()]
