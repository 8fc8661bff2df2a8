"""Column builders for typed, tolerance-aware comparison."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .ratio import text_ratios

RTOL, ATOL = 1e-6, 1e-9


def plain(x: Column) -> Column:
    """A number with NaN as null."""
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def within(expected: Column, actual: Column, rtol: float = RTOL, atol: float = ATOL) -> Column:
    """Tolerance relative to the actual side only; nulls and NaN are equal to each other, infinities to themselves."""
    a, b = plain(expected.cast("double")), plain(actual.cast("double"))
    return a.eqNullSafe(b) | F.coalesce((F.abs(b) < float("inf")) & (F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)), F.lit(False))


def close(a: Column, b: Column, rel: float = 1e-6, abs_: float = 1e-9) -> Column:
    """Symmetric tolerance: relative to the larger side."""
    return a.eqNullSafe(b) | F.coalesce((F.abs(a - b) < float("inf")) & (F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))), F.lit(False))


def verdict(expected: Column, actual: Column, present: Column, rtol: float = RTOL, atol: float = ATOL) -> Column:
    """missing, null_mismatch, value or pass for a numeric pair; ``present`` says whether the actual side has the variable at all."""
    e, a = plain(expected.cast("double")), plain(actual.cast("double"))
    return (
        F.when(~F.coalesce(present, F.lit(False)), "missing")
        .when(e.isNull() != a.isNull(), "null_mismatch")
        .when(within(expected, actual, rtol, atol), "pass")
        .otherwise("value")
    )


def bool_equals_number(flag: Column, number: Column) -> Column:
    """Booleans count as 0 and 1 beside numbers."""
    return (flag.cast("int").cast("double") == number.cast("double")) & flag.isNotNull() & number.isNotNull()


def list_verdict(expected: Column, actual: Column, rtol: float = RTOL, atol: float = ATOL) -> Column:
    """infra for other lengths, value if any element is off, else pass."""
    same = F.forall(F.zip_with(expected, actual, lambda a, b: within(a, b, rtol, atol)), lambda ok: ok)
    return F.when(F.size(expected) != F.size(actual), "infra").when(same, "pass").otherwise("value")


def formals_score(expected: Column, actual: Column, own_attrs: Column, other_attrs: Column) -> Column:
    """0.7 for formal arguments (all, or the shared share; without ... on the expected side and args and kwargs on the other), 0.3 for attributes of the same name and value."""
    a, b = F.filter(expected, lambda f: f != "..."), F.filter(actual, lambda f: ~f.isin("args", "kwargs"))
    longest = F.greatest(F.size(a), F.size(b))
    formals = F.when(a == b, 1.0).when(longest == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / longest)
    names = F.array_intersect(F.map_keys(own_attrs), F.map_keys(other_attrs))
    equal = F.size(F.filter(names, lambda k: own_attrs[k] == other_attrs[k]))
    one, two = F.size(own_attrs), F.size(other_attrs)
    attrs = F.when((one == 0) & (two == 0), 0.3).when((one == 0) | (two == 0), 0.0).when(F.size(names) == 0, 0.15).otherwise(0.3 * equal / F.size(names))
    return 0.7 * formals + attrs


def callable_score(likeness: Column) -> Column:
    """1 from a likeness of 0.95 on, else the likeness itself."""
    return F.when(likeness >= 0.95, 1.0).otherwise(likeness)


def callable_tag(likeness: Column) -> Column:
    """Why callables differ: infra from a likeness of 0.5 on, value below; null where they pass."""
    return F.when(likeness >= 0.95, None).when(likeness >= 0.5, "infra").when(likeness.isNotNull(), "value")


def exit_score(expected: Column, actual: Column) -> Column:
    return F.when((expected == 0) & (actual == 0), 1.0).when((expected != 0) & (actual != 0), 0.8).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if their union is empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def tokens(x: Column) -> Column:
    """Lower-case words between white space, dots, underscores and hyphens, each once."""
    return F.array_remove(F.array_distinct(F.split(F.lower(x), r"[\s._\-]+")), "")


def request_key(verb: Column, url: Column) -> Column:
    """(verb, scheme://host/path in lower case, without parameters, query or slashes at its end)."""
    part = lambda n: F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)", n)
    path = F.regexp_replace(part(3), r";[^/]*$", "")
    return F.struct(verb.alias("verb"), F.lower(F.regexp_replace(F.concat(part(1), F.lit("://"), part(2), path), "/+$", "")).alias("target"))


def requests_score(expected: Column, actual: Column) -> Column:
    """Jaccard similarity of two sets of requests; 1 if both are empty."""
    return F.when((F.size(expected) == 0) & (F.size(actual) == 0), 1.0).otherwise(jaccard(expected, actual))


def infra_rescue(tag: Column, score: Column, similarity: Column) -> Column:
    """A failure of kind infra scores as the similarity of the printed values; other failures are never rescued."""
    return F.when(tag == "infra", similarity).otherwise(score)


#: Least scores with which comparisons pass.
THRESHOLDS = {"DATA": 1.0, "STDOUT": 0.95, "WARNINGS": 0.95, "ENV": 1.0, "FILES": 1.0, "HTML": 0.7, "GRAPHICS": 0.9, "NETWORK": 0.95, "RNG": 1.0}
#: Endings of files that are compared as texts.
TEXT_ENDINGS = (".csv", ".txt", ".json", ".tsv", ".xml", ".yaml", ".yml", ".log")


def passes(effect: Column, score: Column) -> Column:
    """pass or fail by the effect's threshold; null for an unknown effect."""
    least = F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair])
    return F.when(F.element_at(least, effect).isNotNull(), F.when(score >= F.element_at(least, effect), "pass").otherwise("fail"))


def is_text_file(path: Column) -> Column:
    return F.lower(path).rlike("(" + "|".join(re.escape(e) for e in TEXT_ENDINGS) + ")$")


def judged(answer: Column) -> Column:
    """The verdict that a judge's answer ends up with between verdict tags: pass, fail or uncomparable (also for none or any other)."""
    found = F.lower(F.regexp_extract(answer, r"(?is)<verdict>\s*(\w+)\s*</verdict>", 1))
    return F.when(found.isin("pass", "fail"), found).otherwise("uncomparable")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def normalise_printed(x: Column) -> Column:
    """Printed values without line numbers, quotes, brackets and layout; TRUE and FALSE as True and False, hex colours in lower case."""
    found = F.contains(x, F.lit("[")) | F.contains(x, F.lit("#")) | F.contains(x, F.lit("TRUE")) | F.contains(x, F.lit("FALSE"))
    marked = F.regexp_replace(x, r"(?m)^\s*\[\d+\]\s*", "")
    colour = r"#[0-9A-Fa-f]{3,8}\b"
    lowered = lambda p: F.concat(F.lower(F.regexp_extract(p, f"^{colour}", 0)), F.regexp_replace(p, f"^{colour}", ""))
    marked = F.array_join(F.transform(F.split(marked, f"(?={colour})"), lowered), "")
    marked = F.regexp_replace(F.regexp_replace(marked, r"\bTRUE\b", "True"), r"\bFALSE\b", "False")
    return F.trim(F.regexp_replace(F.translate(F.when(found, marked).otherwise(x), "\"'[](),{}:", ""), r"\s+", " "))


def sorted_tokens(x: Column) -> Column:
    return F.array_join(F.sort_array(F.array_remove(F.split(x, r"\s+"), "")), " ")


def text_similarity(pairs, a: str, b: str, out: str = "similarity"):
    """``pairs`` with the best Ratcliff-Obershelp ratio of two text columns: raw, normalised, or of sorted tokens.

    Equal texts never reach Python: they are 1, and null there; the rest are matched by Arrow batches. A form whose characters allow no better ratio is left out.
    """
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series, nx: pd.Series, ny: pd.Series, sx: pd.Series, sy: pd.Series) -> pd.Series:
        found = pd.Series(0.0, index=x.index)
        forms = [(list(p), list(q)) for p, q in ((x, y), (nx, ny), (sx, sy))]
        both = [n for n, (p, q) in enumerate(zip(*forms[0], strict=True)) if p and q]
        for f, (p, q) in enumerate(forms):
            new = [n for n in both if all((p[n], q[n]) != (u[n], v[n]) for u, v in forms[:f])]
            found.iloc[new] = text_ratios([p[n] for n in new], [q[n] for n in new], found.iloc[new].to_numpy())
        return found

    x, y = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
    differs = lambda t: F.when(x != y, t)
    nx, ny = normalise_printed(differs(x)), normalise_printed(differs(y))
    return pairs.withColumn(out, F.when(x == y, 1.0).otherwise(ratio(differs(x), differs(y), nx, ny, sorted_tokens(nx), sorted_tokens(ny))))
