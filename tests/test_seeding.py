import hashlib
import random
import re

from tallyloom.operators import seeding as S


def plainly(entities, patterns, examples):
    split = lambda s: set(re.split(r"[\s._\-]+", (s or "").lower())) - {""}
    like = lambda a, b: len(split(a) & split(b)) / len(split(a) | split(b)) if split(a) and split(b) else 0.0
    groups = {}
    for e in sorted(entities, key=lambda e: e["at"]):
        code = [x.strip() for x in (e["target"] or "").split("\n") if x.strip() and not x.strip().startswith("#")]
        if e["kind"] == "library_import" or e["score"] < 0.95 or not e["source"] or all(c == "pass" or c.startswith("pass  #") for c in code):
            continue
        groups.setdefault((e["script"], e["name"] or e["entity"]), []).append(e)
    library = {p["id"]: p for p in patterns}
    kept = {p: [] for p in library}
    for x in examples:
        kept.setdefault(x[0], []).append(x)
    touched, seeds = [], {}
    chosen = [next((e for e in g if f"def {name.replace('::', '.').replace('.', '_')}(" in e["target"]), g[0]) | {"name": name} for (_, name), g in groups.items()]
    for e in sorted(chosen, key=lambda e: e["at"]):
        package = e["package"] or ""
        all_of = [p for p in patterns if (p["package"] or "") == package] if package else []
        pool = [p for p in (all_of or patterns) if p["confidence"] != "contradicted" and (p["seed"] or p["confidence"] == "confirmed" or p["real_evidence"] >= 2)]
        pool.sort(key=lambda p: ((p["package"] or "") != package, -like(e["kind"], p["id"]), -like(e["name"], p["guidance"]), p["id"]))
        found = next((p["id"] for p in pool[:3] if (p["package"] or "") == package), None)
        created = found is None
        if created:
            base = re.sub(r"[^a-z0-9.\-]", "-", (f"{package}.{e['name']}" if package else e["name"]).lower())[:60]
            found, k = base, 0
            while found in library or found in seeds:
                k += 1
                found = f"{base}-{k}"
            seeds[found] = package
        touched.append((e["script"], e["entity"], found, created))
        source = e["source"][:300]
        kept.setdefault(found, []).append((found, hashlib.sha256(source.encode()).hexdigest()[:8], source, e["target"][:600], e["score"], e["script"], e["at"]))
    best = {}
    for p, rows in kept.items():
        once = {}
        for x in sorted(rows, key=lambda x: x[6]):
            if x[1] not in once or x[4] > once[x[1]][4]:
                once[x[1]] = x
        best[p] = sorted(once.values(), key=lambda x: (-x[4], x[6], x[1]))[:3]
    return sorted(touched), seeds, sorted(x for rows in best.values() for x in rows)


def test_seeds_against_a_loop(spark):
    r = random.Random(8)
    entity = lambda k: {
        "script": f"s{k % 4}", "entity": f"e{k}", "name": r.choice(["with_locale", "a::b", "x.y", "", None, "Plot It"]), "kind": r.choice(["function", "assignment", "library_import"]), "package": r.choice(["withr", "base", "", None, "new"]),
        "source": r.choice(["f(x)", "g(y)" * 100, "", "h()"]), "target": r.choice(["def with_locale(x):\n  return x", "pass", "# a\n  pass  # untranslatable\n", "y = 1\npass", "def a_b(): pass", "", "  pass\n\tz()"]), "score": r.choice([1.0, 0.95, 0.97, 0.5]), "at": k}
    entities = [entity(k) for k in range(160)]
    patterns = [{"id": i, "package": p, "guidance": g, "confidence": c, "seed": s, "real_evidence": n} for i, p, g, c, s, n in [
        ("withr.function-one", "withr", "with locale", "confirmed", False, 0), ("withr.two", "withr", "a b", "tentative", True, 0), ("withr.three", "withr", "x", "tentative", False, 1), ("base.x", "base", "x y", "contradicted", True, 9),
        ("plot-it", "", "plot it function", "tentative", False, 1), ("x.y", None, "x y", "confirmed", False, 2), ("new.x.y-1", "old", "other", "tentative", False, 0), ("new.x.y", "old", "other", "tentative", False, 0), ("new.with-locale", "old", "other", "tentative", False, 0), ("new.a--b", "old", "other", "tentative", False, 0), ("new.plot-it", "old", "other", "tentative", False, 0)]]
    examples = [("withr.two", "h1", "s", "t", 0.99, "old", -2), ("x.y", "h2", "s", "t", 0.4, "old", -1)]
    frame = lambda rows, schema: spark.createDataFrame([tuple(x.values()) if isinstance(x, dict) else x for x in rows], schema)
    got = S.seeded(
        frame(entities, "script string, entity string, name string, kind string, package string, source string, target string, score double, at long"),
        frame(patterns, "id string, package string, guidance string, confidence string, seed boolean, real_evidence int"), frame(examples, "pattern string, hash string, source string, target string, score double, script string, at long"))
    touched, seeds, best = plainly(entities, patterns, examples)
    assert sorted(map(tuple, got["touched"].collect())) == touched
    assert {x.id: x.package for x in got["seeds"].collect()} == seeds and any(re.search(r"-[1-9]$", s) for s in seeds)
    assert sorted(map(tuple, got["examples"].collect())) == best
    assert all(x.guidance.startswith("Translate R `") and x.seed and x.confidence == "tentative" for x in got["seeds"].collect())
