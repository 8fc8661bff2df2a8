import ast
import random
import re

from pyspark.sql import functions as F

from tallyloom.functions import structure as S


def plain(source):
    """Line by line."""
    out, stack = [], []
    for line in source.splitlines(keepends=True):
        bare = line.lstrip()
        indent, nl = line[: len(line) - len(bare)], "\n" if line.endswith("\n") else ""
        if re.match(r"if\s*\(\s*(" + "|".join(map(re.escape, S.GUARDS)) + ")", bare):
            depth = bare.count("{") - bare.count("}")
            if "{" in bare and depth > 0:
                stack.append(depth)
            elif "{" in bare:
                m = re.search(r"\{(.+)\}", bare)
                out += [indent + m.group(1).strip() + nl] if m else []
            else:
                d, rest = 0, ""
                for i, c in enumerate(bare):
                    d += (c == "(") - (c == ")")
                    if c == ")" and d == 0:
                        rest = bare[i + 1 :].strip()
                        break
                out += [indent + rest + nl] if rest else []
            continue
        if stack:
            stack[-1] += line.count("{") - line.count("}")
            if stack[-1] <= 0:
                stack.pop()
                continue
        out.append(line)
    return "".join(out)


def test_guards(spark):
    fixed = {
        "if (interactive()) {\n  f(1)\n}\ng()": "  f(1)\ng()", "if(FALSE) h(2)\n": "h(2)\n", "  if ( requireNamespace('x', quietly = TRUE) ) { a; b }\n": "  a; b\n", "if (interactive())": "", "if (x) {\n y\n}\n": "if (x) {\n y\n}\n",
        "if (rlang::is_installed(\"p\")) {\n if (z) {\n  y\n }\n}\nk": " if (z) {\n  y\n }\nk", "": "",
    }
    r = random.Random(1)
    part = ["if (interactive()) {\n", "if (FALSE) {\n", "}\n", "  } else {\n", "x <- 1\n", "f({\n", "})\n", "  if (requireNamespace('a')) b(c(1))\n", "if (interactive()) { z }\n", "if (FALSE) {}\n", "last", "\n", "if (y) {\n", "if (FALSE\n"]
    sources = [*fixed, *("".join(r.choice(part) for _ in range(r.randrange(1, 14))) for _ in range(400))]
    df = spark.createDataFrame(list(enumerate(sources)), "i int, s string")
    got = [x.g for x in df.select("i", S.guard_strip(F.col("s")).alias("g")).orderBy("i").collect()]
    assert dict(zip(fixed, got, strict=False)) == fixed
    assert got == [plain(s) for s in sources]


def test_arguments_in_order(spark):
    cases = {
        "f(a=1, b)": "f(b, a=1)", "f(x, a=g(k=2, y), z)": "f(x, z, a=g(y, k=2))", "f(a = 1,\n  b,\n  c == 2)": "f(b, c == 2, a = 1)", "f(b, a=1)": "f(b, a=1)", "f(a=1, )": "f(a=1, )", "f(a=1, b,)": "f(b, a=1)", "x = [a, (b, c)]": "x = [a, (b, c)]",
        "f(s='a=1, b)', t)": "f(t, s='a=1, b)')", 'f(k="""x\n)""", y)  # f(a=1, b)': 'f(y, k="""x\n)""")  # f(a=1, b)', "f(a=1, *args, **kw)": "f(*args, **kw, a=1)", "f(g)(a=1, b)": "f(g)(b, a=1)", "d[0](a=1, b)": "d[0](b, a=1)",
        "f(a=1, b": "f(a=1, b", "f(a=1, 'b)": "f(a=1, 'b)", "f(a=1, b])": "f(a=1, b])", "f(a={'k': 1, 'm': [2, 3]}, b[1, 2])": "f(b[1, 2], a={'k': 1, 'm': [2, 3]})", "": "", "f(a=rb'\\'', x)": "f(x, a=rb'\\'')", "f(a=(1, 2), b)": "f(b, a=(1, 2))",
    }
    df = spark.createDataFrame(list(enumerate([*cases, None])), "i int, s string")
    got = [x.g for x in df.select("i", S.call_reorder(F.col("s")).alias("g")).orderBy("i").collect()]
    assert dict(zip(cases, got, strict=False)) == cases and got[-1] is None
    r = random.Random(3)

    def call(depth):
        args = [("" if r.random() < 0.5 else f"k{i}=") + (call(depth - 1) if depth and r.random() < 0.6 else r.choice(["1", "'a, b'", "[x, (y, 2)]", "z == 3"])) for i in range(r.randrange(5))]
        return f"f{r.randrange(9)}({', '.join(args)})"

    for _ in range(300):
        source = call(3)
        done = S.ordered_arguments(source)
        ast.parse(done)
        assert sorted(re.sub(r"[ ,]", "", done)) == sorted(re.sub(r"[ ,]", "", source)) and S.ordered_arguments(done) == done
