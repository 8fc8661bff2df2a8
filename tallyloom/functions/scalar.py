"""Scalar rules over names, texts, hashes and dates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calls whose results are drawn at random, read from files or taken from the system.
SOURCE_CALLS = (
    "rnorm", "runif", "sample", "rbinom", "rpois", "rgamma", "rbeta", "rt", "rexp", "rchisq", "rlnorm", "rweibull", "rcauchy", "rf",
    "read.csv", "read.csv2", "read.table", "read.delim", "read.delim2", "readRDS", "readLines", "scan", "load", "Sys.getenv", "Sys.time", "Sys.Date", "Sys.timezone",
)
# Variables of the environment that a run may see, and the one that is always set.
ENV_ALLOWED = ("PATH", "HOME", "USERPROFILE", "TMPDIR", "TEMP", "TMP", "R_LIBS_USER", "R_HOME", "RSCRIPT_PATH", "LANG", "LC_ALL", "LC_CTYPE", "SYSTEMROOT", "WINDIR", "COMSPEC", "PROCESSOR_ARCHITECTURE")
ENV_SET = ("PYTHONIOENCODING", "utf-8")


def scrubbed_env(env: Column, more: tuple[str, ...] = ()) -> Column:
    """A map of environment variables with only those allowed, and the one that is always set."""
    allowed = F.map_filter(env, lambda k, v: k.isin(*ENV_ALLOWED, *more) & (k != ENV_SET[0]))
    return F.map_concat(allowed, F.create_map(F.lit(ENV_SET[0]), F.lit(ENV_SET[1])))


#: Ways to write a value as text, by the name of its kind; the first whose condition holds is taken.
Adapter = tuple[Column, Column]


def canonical_value(adapters: list[Adapter]) -> Column:
    """The first adapter (condition, text) that fits, or __uncapturable__."""
    out = None
    for condition, text in adapters:
        out = F.when(condition, text) if out is None else out.when(condition, text)
    return out.otherwise("__uncapturable__") if out is not None else F.lit("__uncapturable__")


def decoded_state(text: Column) -> Column:
    """A JSON object as a map of names to JSON texts; values that are strings holding JSON are decoded once more. Empty if it doesn't parse.

    NaN and infinities, written bare, are null, "Inf" and "-Inf".
    """
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?<=[:\[,]\s?)-Infinity(?=\s*[,}\]])", '"-Inf"'), r"(?<=[:\[,]\s?)Infinity(?=\s*[,}\]])", '"Inf"'), r"(?<=[:\[,]\s?)NaN(?=\s*[,}\]])", "null")
    values = F.try_variant_get(F.try_parse_json(plain), "$", "map<string,variant>")
    once = lambda k, v: F.when(F.schema_of_variant(v) == "STRING", F.coalesce(F.to_json(F.try_parse_json(F.try_variant_get(v, "$", "string"))), F.to_json(v))).otherwise(F.to_json(v))
    return F.coalesce(F.transform_values(values, once), F.create_map().cast("map<string,string>"))


def brace_depth(line: Column) -> Column:
    """Braces that a line opens less those it closes, outside of strings and comments."""
    bare = F.regexp_replace(F.regexp_replace(line, r"\"[^\"]*\"|'[^']*'", ""), r"#.*$", "")
    return (F.length(F.regexp_replace(bare, r"[^{]", "")) - F.length(F.regexp_replace(bare, r"[^}]", ""))).cast("int")


def finite(x: Column) -> Column:
    """A number as JSON text has it: NaN is null, infinities are Inf and -Inf."""
    return F.when(x.isNull() | F.isnan(x), F.lit(None)).when(x == float("inf"), "Inf").when(x == float("-inf"), "-Inf").otherwise(x.cast("string"))


def is_internal(name: Column) -> Column:
    return name.startswith("__") | name.startswith(".tmp_")


def slug(x: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.lower(x), r"[^a-z0-9.\-]", "-"), 1, most)


def preview(x: Column, most: int = 120) -> Column:
    """A value as feedback shows it: the first characters and an ellipsis."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("…"))).otherwise(x)


def shortened(x: Column, most: int = 500) -> Column:
    """A value as a prompt holds it: the first characters and how many more there are."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.format_string("... (%d more chars)", F.length(x) - most))).otherwise(x)


def url_class(url: Column) -> Column:
    """What an address, without slashes at its end, leads to; the first rule that fits. An address of a repository that names a script is a script."""
    x = F.regexp_replace(url, "/+$", "")
    return (
        F.when(x.contains("github.com") & ~x.endswith(".R"), "github").when(x.contains("cran.r-project.org") | x.endswith(".tar.gz"), "cran")
        .when(x.endswith(".R") | x.endswith(".r"), "script").when(x.contains("rpubs.com"), "rpubs").otherwise("other")
    )


def is_package_name(x: Column) -> Column:
    return x.rlike(r"^[A-Za-z][A-Za-z0-9._-]*$")


def rename_keyword(x: Column, word: str) -> Column:
    """word= becomes word_val=, comparisons (==) stay."""
    return F.regexp_replace(x, rf"\b{word}(\s*)=([^=])", rf"{word}_val$1=$2")


def leading_call(x: Column) -> Column:
    """The first call anywhere in a source, without its comments and a leading assignment; empty if there is none."""
    x = F.regexp_replace(F.regexp_replace(x, r"#[^\n]*", ""), r"^\s*([A-Za-z_.][\w.]*\s*(<-|=)\s*)?", "")
    return F.regexp_extract(x, r"\b([A-Za-z_][\w.]*)\s*\(", 1)


def is_source(x: Column) -> Column:
    """Whether the first call of a source is one of SOURCE_CALLS; not for null."""
    return F.coalesce(leading_call(x).isin(*SOURCE_CALLS), F.lit(False))


def short_hash(x: Column, kind: str, n: int) -> Column:
    made = {"md5": lambda c: F.md5(c), "sha1": lambda c: F.sha1(c), "sha256": lambda c: F.sha2(c, 256)}[kind](x.cast("binary"))
    return F.substring(made, 1, n)


def recency(day: Column, today: str) -> Column:
    """1 on the day, falling to 0 in a year; 0 without a valid date."""
    age = F.datediff(F.lit(today).cast("date"), F.try_to_date(day))
    return F.coalesce(F.greatest(F.lit(0.0), 1 - age / F.lit(365.0)), F.lit(0.0))


def binomial_tail(k: int, n: int, p: float = 0.5) -> float:
    """P(X >= k) by the normal approximation with continuity correction."""
    spread = math.sqrt(n * p * (1 - p))
    return 0.5 * math.erfc((k - 0.5 - n * p) / (spread * math.sqrt(2))) if spread else float(k <= n * p)


def easter(year: Column) -> Column:
    """Gregorian Easter Sunday by whole-number arithmetic."""
    div = lambda x, y: F.floor(x / y)
    a, b, c = year % 19, div(year, 100), year % 100
    d, e = div(b, 4), b % 4
    g = div(8 * b + 13, 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = div(c, 4), c % 4
    w = (32 + 2 * e + 2 * i - h - k) % 7
    m = div(a + 11 * h + 22 * w, 451)
    month, day = div(h + w - 7 * m + 114, 31), (h + w - 7 * m + 114) % 31 + 1
    return F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))
