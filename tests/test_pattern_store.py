import json
import random

import pytest

from tallyloom.sources import pattern_store as P

FILE = """---
id: base.with-locale
# a comment
package: base
confidence: sure
seed: TRUE
created: 2024-01-02
last_review: 2024-02-03
tie_count: 4
id : base.with-locale
---

# base.with-locale

## Guidance

Use `x`: é → y.
  - a point

## Evidence
- s 1 → score 0.500 (path: exact, variable: e1)
- s2 → score 1. (path:  tie , variable: e2)
- s3 → score 0.25 (path: fallback, variable: a (b))
- not an entry

## Contradictions
- s/e: score regressed to 0.100
without a dash

## Translation Examples
- {"r_hash": "ab", "r_snippet": "f(x)\\n# c", "py_snippet": "é\\"", "score": 0.98765, "script_id": "s"}
- {broken
{"r_hash": "cd", "r_snippet": "g", "py_snippet": "h", "score": 1, "script_id": "t"}

## Edit Examples
(none)
"""


def write(folder, files):
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text, encoding="utf-8", newline="")


def test_files_are_read_by_their_rules(spark, tmp_path):
    write(tmp_path, {
        "a.md": FILE, "deep/b.md": "---\nid: b\n---\n\n## Guidance\nold\n## Guidance\nnew\n", "bad.md": "no front matter", "worse.md": "---\nid: worse\n---\n## Evidence\n- s → score 1.2.3 (path: p, variable: v)\n",
        "c.md": "---\r\nid: c\r\ntie_count: many\r\nseed: yes\r\n---\r\n## Guidance\r\ntext\r\n", "deep/z.md": "---\nid: c\npackage: later\n---\n", "x.txt": FILE, "empty.md": ""})
    got = {r.id: r for r in P.read_store(spark, str(tmp_path)).collect()}
    assert set(got) == {"base.with-locale", "b", "c"}
    a = got["base.with-locale"]
    assert (a.package, a.confidence, a.seed, a.created, a.last_review, a.tie_count) == ("base", "tentative", True, "2024-01-02", "2024-02-03", 5)
    assert a.guidance == "Use `x`: é → y.\n  - a point"
    assert [tuple(e) for e in a.evidence] == [("s 1", 0.5, "exact", "e1"), ("s3", 0.25, "fallback", "a (b)")]
    assert a.contradictions == ["s/e: score regressed to 0.100", "without a dash"]
    assert [(e.r_hash, e.r_snippet, e.py_snippet, e.score) for e in a.examples] == [("ab", "f(x)\n# c", 'é"', 0.98765), ("cd", "g", "h", 1.0)] and a.edits == []
    assert got["b"].guidance == "new" and got["c"].package == "later" and got["c"].tie_count == 0


def test_patterns_written_are_read_back(spark, tmp_path):
    r = random.Random(2)
    text = lambda: r.choice(["x <- 1", "a\nb", 'q"\\', "é → z", "# c"])
    rows = [
        (f"p.{i}-{i % 3}", r.choice(["", "base"]), r.choice(P.CONFIDENCE), r.random() < 0.5, "2024-01-01", "2024-05-06", i % 4, f"rule {i}\n\n- point",
         [("s", round(r.random(), 3), "exact", f"v{k}") for k in range(i % 4)], [f"c{k}: x" for k in range(i % 3)], [("h", text(), text(), round(r.random(), 4), "s") for _ in range(i % 3)], [("DATA", text(), text(), round(r.random(), 4), "s") for _ in range(i % 2)])
        for i in range(42)
    ]
    schema = f"id string, package string, confidence string, seed boolean, created string, last_review string, tie_count long, guidance string, evidence array<struct<{P.EVIDENCE}>>, contradictions array<string>, examples array<struct<{P.EXAMPLE}>>, edits array<struct<{P.EDIT}>>"
    folder = str(tmp_path / "store")
    df = spark.createDataFrame(rows, schema).repartition(5)
    P.write_store(df, folder)
    plain = lambda d: sorted(json.dumps(x.asDict(True), sort_keys=True) for x in d.select(*df.columns).collect())
    assert plain(P.read_store(spark, folder)) == plain(df)
    P.write_store(df.where("id = 'p.3-0'").replace("rule 3\n\n- point", "other", ["guidance"]), folder)
    got = {x.id: x.guidance for x in P.read_store(spark, folder).collect()}
    assert len(got) == 42 and got["p.3-0"] == "other"
    named = spark.read.format("named_texts").option("path", folder).option("files", "10").load()
    assert named.count() == 42 and named.rdd.getNumPartitions() == 5 and not list((tmp_path / "store").glob(".*"))
    with pytest.raises(Exception, match="no name of a file"):
        P.write_store(df.limit(1).replace("p.0-0", "../x", ["id"]).withColumn("id", P.F.lit("../x")), folder)
    assert len(list((tmp_path / "store").iterdir())) == 42
