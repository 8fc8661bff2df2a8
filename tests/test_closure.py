import random

from tallyloom.operators.closure import callee_closure


def walk(query, reach, definitions, calls, dispatch, classes, budget, most):
    """A queue, one symbol after the other."""
    packages = [p for q, p, _ in sorted(reach, key=lambda r: r[2]) if q == query[0]]
    queue, seen, out, left = [(query[1], 0)], {query[1]}, [], budget
    while queue and left > 0:
        symbol, depth = queue.pop(0)
        package = next((p for p in packages if (p, symbol) in definitions), None)
        if package is None:
            continue
        lines = min(definitions[package, symbol], most, left)
        left -= lines
        out.append((query[0], len(out), depth, package, symbol, lines))
        after = [c for p, s, c, _ in sorted(calls, key=lambda c: c[3]) if (p, s) == (package, symbol)]
        for generic in [g for p, s, g in dispatch if (p, s) == (package, symbol)]:
            after.append(generic + ".default")
            methods = sorted({s for p, s in definitions if p in packages and s.startswith(generic + ".")})
            after += [m for m in methods if classes is None or (query[0], m[len(generic) + 1 :]) in classes]
        for c in after:
            if c not in seen:
                seen.add(c)
                queue.append((c, depth + 1))
    return out


def test_closures_against_a_queue(spark):
    r = random.Random(3)
    names = [f"f{i}" for i in range(40)] + ["print", "print.default", "print.lm", "print.a.b", "tidy", "tidy.lm"]
    definitions = {(p, s): r.randrange(1, 120) for p in "abc" for s in names if r.random() < 0.6}
    calls = [(p, s, r.choice([*names, "missing"]), k) for p, s in definitions for k in range(r.randrange(5))] + [("a", "f0", "f0", 9)]
    dispatch = [(p, s, s) for p, s in definitions if s in ("print", "tidy")]
    queries = [(i, r.choice(names)) for i in range(60)] + [(100, "missing"), (101, "print"), (102, "tidy")]
    reach = [(q, p, k) for q, _ in queries for k, p in enumerate(r.sample("abc", r.randint(1, 3)))]
    classes = [(q, c) for q, _ in queries for c in ("lm", "a.b") if r.random() < 0.5]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = [
        frame(queries, "query int, symbol string"), frame(reach, "query int, package string, ord int"), frame([(*k, v) for k, v in definitions.items()], "package string, symbol string, lines int"),
        frame(calls, "package string, symbol string, callee string, ord int"), frame(dispatch, "package string, symbol string, generic string"), frame(classes, "query int, class string"),
    ]
    for own, budget in ((classes, 200), (None, 500)):
        got = callee_closure(*tables[:5], tables[5] if own is not None else None, budget)
        want = [row for q in queries for row in walk(q, reach, definitions, calls, dispatch, None if own is None else set(own), budget, 80)]
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert callee_closure(tables[0].limit(0), *tables[1:4]).count() == 0


def test_lists_of_calls_end_at_the_budget(spark):
    """A caller of 1,000 symbols of 50 lines takes four of them at most, so the others never reach the rounds."""
    from tallyloom.operators.closure import _within_budget

    definitions = spark.range(1001).selectExpr("'p' as package", "id as symbol", "50 as lines")
    calls = spark.range(1, 1001).selectExpr("'p' as package", "0L as symbol", "id as callee", "id as ord")
    got = _within_budget(calls, definitions, 200, 80).collect()
    assert sorted(r.callee for r in got) == [1, 2, 3, 4]
