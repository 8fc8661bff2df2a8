import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import examples as X
from tallyloom.streaming import patterns as P

NAMES = [c.split()[0] for c in P.FACTS.split(", ")]


def plain(facts):
    """One fact after the other, as lists that are sorted and cut each time."""
    out = {}
    for f in sorted((dict(zip(NAMES, f, strict=True)) for f in facts), key=lambda f: f["at"]):
        p = f["pattern"]
        if f["kind"] == "noise":
            continue
        if not p or (p not in out and (f["kind"] != "evidence" or not (f["guidance"] or "").strip())):
            continue
        s = out.setdefault(p, {"guidance": None, "package": None, "evidence": 0, "real": 0, "gain": 0.0, "ties": 0, "contradictions": 0, "stamp": None, "reviewed": None, "examples": [], "edits": {}})
        s["reviewed"] = max(s["reviewed"] or f["day"], f["day"])
        if f["kind"] == "tie":
            s["ties"] += 1
        elif f["kind"] == "contradiction":
            s["contradictions"] += 1
            s["stamp"] = max(s["stamp"] or 0, f["run"])
        else:
            s["guidance"] = s["guidance"] or (f["guidance"] or "").strip()
            s["package"] = s["package"] or f["package"] or None
            s["evidence"] += 1
            if f["delta"] > 0:
                s["real"] += 1
                s["gain"] += f["delta"]
                if f["source"] and f["target"]:
                    new = (hashlib.sha256(f["source"].encode()).hexdigest()[:8], f["source"][:300], f["target"][:600], f["delta"])
                    same = [e for e in s["examples"] if e[0] == new[0]]
                    if not same or new[3] > same[0][3]:
                        s["examples"] = sorted([e for e in s["examples"] if e[0] != new[0]] + [new], key=lambda e: -e[3])[:3]
                if f["class"] and f["old"] and f["new"]:
                    s["edits"][f["class"]] = sorted([*s["edits"].get(f["class"], []), (f["old"][:300], f["new"][:300], f["delta"])], key=lambda e: -e[2])[:5]
    return out


@pytest.fixture(scope="module")
def facts():
    r = random.Random(5)
    day = datetime.date(2024, 1, 1)
    rows = []
    for at in range(900):
        p = r.choice(["hot", "hot", "a", "b", "c-1", "late", None, ""])
        kind = r.choice(["evidence", "evidence", "evidence", "tie", "contradiction", "noise"])
        says = r.choice([" rule ", "", None, "  "]) if p != "late" or at > 500 else ""
        rows.append((p, kind, at, at // 30, day + datetime.timedelta(at % 200), r.randrange(-40, 60) / 8, says, r.choice(["pkg", "", None, "other"]), f"s{at}", r.choice(["x <- 1", "y" * 400, "", "z" * at, None]), r.choice(["py", "p" * 700, ""]), r.choice(["DATA", "HTML", None]), r.choice(["old", "o" * 301]), r.choice(["new", ""])))
    return rows


def view(df):
    return {
        r.pattern: {
            "guidance": r.guidance, "package": r.package, "evidence": r.evidence, "real": r.real_evidence, "gain": r.gain, "ties": r.ties, "contradictions": r.contradictions, "stamp": r.contradicted_at, "reviewed": r.reviewed,
            "examples": [(e.hash, e.source, e.target, e.score) for e in r.examples or []],
            "edits": {c: [(e.old, e.new, e.gain) for e in r.edits if e["class"] == c] for c in {e["class"] for e in r.edits or []}},
        }
        for r in df.collect()
    }


def test_state_of_a_stream_equals_facts_one_by_one(spark, tmp_path, facts):
    source, state, seen = (str(tmp_path / n) for n in ("facts", "state", "seen"))
    read = lambda: spark.readStream.schema(P.FACTS).option("maxFilesPerTrigger", 1).parquet(source)
    df = spark.createDataFrame(facts, P.FACTS)
    for lo, hi in ((0, 200), (200, 480)):
        df.where(f"at >= {lo} and at < {hi}").coalesce(1).write.mode("append").parquet(source)
    P.stream(spark, read(), state, seen)
    assert view(P.patterns(spark, state)) == plain([f for f in facts if f[2] < 480])
    df.where("at >= 480 and at < 700").coalesce(1).write.mode("append").parquet(source)
    P.stream(spark, read(), state, seen)  # another query goes on from the checkpoint
    P.apply(spark, df.where("at >= 480 and at < 700"), state, 2)  # a batch that is run again
    df.where("at >= 700").coalesce(1).write.mode("append").parquet(source)
    P.stream(spark, read(), state, seen)
    want = plain(facts)
    assert view(P.patterns(spark, state)) == want and set(want) == {"hot", "a", "b", "c-1", "late"}
    once = str(tmp_path / "once")
    P.apply(spark, df, once, 0)
    assert view(P.patterns(spark, once)) == want


def test_batches_write_only_the_buckets_they_touch(spark, tmp_path, facts):
    state = str(tmp_path / "state")
    P.apply(spark, spark.createDataFrame(facts, P.FACTS), state, 0)
    before = view(P.patterns(spark, state))
    one = [("a", "tie", 1000, 40, datetime.date(2025, 1, 1), 0.0, *[None] * 8)]
    P.apply(spark, spark.createDataFrame(one, P.FACTS), state, 1)
    assert len(list((tmp_path / "state" / "counts" / "version=1").glob("bucket=*"))) == 1
    after = view(P.patterns(spark, state))
    assert after["a"]["ties"] == before["a"]["ties"] + 1 and {k: v for k, v in after.items() if k != "a"} == {k: v for k, v in before.items() if k != "a"}
    P.apply(spark, spark.createDataFrame([], P.FACTS), state, 2)
    assert view(P.patterns(spark, state)) == after


def merged_plainly(ids, examples, edits):
    groups = {}
    import re

    for i in ids:
        m = re.match(r"^(.+?)-(\d+)$", i)
        groups.setdefault(m.group(1) if m else i, []).append(i)
    out = {}
    for base, own in groups.items():
        if len(own) < 2:
            continue
        canonical = base if base in own else min(own)
        order = [canonical, *sorted(i for i in own if i != canonical)]
        best, kept = {}, {}
        for i in order:
            for e in sorted((e for e in examples if e[0] == i), key=lambda e: e[6]):
                if e[1] not in best or e[4] > best[e[1]][4]:
                    best.pop(e[1], None)
                    best[e[1]] = e
            for e in sorted((e for e in edits if e[0] == i), key=lambda e: e[6]):
                kept.setdefault(e[1], []).append(e)
        top = sorted(best.values(), key=lambda e: -e[4])[:3]
        top.sort(key=lambda e: (0 if f"def {base.replace('-', '_')}(" in e[3] else 1, -e[4]))
        out[canonical] = ([(e[1], e[4]) for e in top], {c: [(x[2], x[4]) for x in sorted(v, key=lambda e: -e[4])[:5]] for c, v in kept.items()})
    return out


def test_consolidation_with_examples(spark):
    r = random.Random(4)
    ids = ["with-locale", "with-locale-1", "with-locale-2", "only-3", "only-10", "alone", "x-1-2", "x-1", "solo-7"]
    examples = [(r.choice(ids), f"h{r.randrange(12)}", "src", r.choice(["def with_locale(x):", "call()", "def only(y):"]), r.randrange(200) / 7 + k / 1e6, "s", k) for k in range(150)]
    edits = [(r.choice(ids), r.choice(["DATA", "ENV"]), f"o{k}", "n", float(r.randrange(9)), "s", k) for k in range(120)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = X.consolidated(
        frame([(i, k) for k, i in enumerate(ids)], "id string, ties long"), frame(examples, "pattern string, hash string, source string, target string, score double, script string, at long"),
        frame(edits, "pattern string, class string, old string, new string, gain double, script string, at long"), frame([(i, 1) for i in ids * 3], "pattern string, v int"),
        frame([("with-locale-2", 0, "b"), ("with-locale", 0, "a"), ("with-locale-1", 0, "b"), ("with-locale-1", 1, "a"), ("alone", 0, "c")], "pattern string, at long, said string"))
    want = merged_plainly(ids, examples, edits)
    mine = {c: ([], {}) for c in want}
    for e in got["examples"].orderBy("pattern", "place").collect():
        mine[e.pattern][0].append((e.hash, e.score))
    for e in got["edits"].orderBy("pattern", "class", F.desc("gain"), "at").collect():
        mine[e.pattern][1].setdefault(e["class"], []).append((e.old, e.gain))
    assert mine == want and set(want) == {"with-locale", "only-10"}  # x-1-2 is a variant of x-1, which is one of x itself
    assert {(p.canonical, p.n_merged, p.ties) for p in got["patterns"].collect()} == {("with-locale", 3, 3), ("only-10", 2, 7)}
    assert sorted(x.id for x in got["removed"].collect()) == ["only-3", "with-locale-1", "with-locale-2"]
    assert {(x.pattern, x["count"]) for x in got["evidence"].groupBy("pattern").count().collect()} == {("with-locale", 9), ("only-10", 6)}
    assert [(x.said, x.place) for x in got["contradictions"].orderBy("place").collect()] == [("a", 1), ("b", 2)]
