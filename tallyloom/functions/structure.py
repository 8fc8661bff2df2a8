"""The structure of source texts: guards around examples, order of arguments."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Conditions of guards around code that is meant to run by hand only.
GUARDS = ("rlang::is_interactive(", "interactive(", "FALSE", "rlang::is_installed(", "requireNamespace(")


def _escaped(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "_" else c for c in s)


def guard_strip(source: Column) -> Column:
    """A source without the if-lines of GUARDS and the lines that close them, so that what they guard always runs.

    A guard that opens braces guards until they are closed; one that closes them in its line, or has none, leaves its body, indented as it was.
    Braces are counted wherever they stand. The lines go through one aggregate, whose state is a stack of open braces and the lines kept.
    """
    lines = F.regexp_extract_all(source, F.lit("[^\n]*\n|[^\n]+"), F.lit(0))
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    start = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<string>").alias("out"))

    def after_condition(x: Column) -> Column:
        """What follows the parenthesis that the first one of a line closes with; empty if it doesn't close."""
        step = lambda s, c: F.struct(
            (s.depth + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("depth"), (s.at + 1).alias("at"), F.when((s.end == 0) & (c == ")") & (s.depth == 1), s.at + 1).otherwise(s.end).alias("end"))
        end = F.aggregate(F.split(x, ""), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end")), step, lambda s: s.end)
        return F.when(end > 0, F.substr(x, end + 1)).otherwise("")

    def step(state: Column, line: Column) -> Column:
        bare = F.regexp_replace(line, r"^\s+", "")
        guards = bare.rlike(r"\Aif\s*\(\s*(" + "|".join(map(_escaped, GUARDS)) + ")")
        depth = count(line, "{") - count(line, "}")
        indent, newline = F.regexp_extract(line, r"^(\s*)", 1), F.when(line.endswith("\n"), "\n").otherwise("")
        braced = line.contains("{")
        body = F.when(braced, F.when(bare.rlike(r"\{.+\}"), strip(F.regexp_extract(bare, r"\{(.+)\}", 1)))).otherwise(F.nullif(strip(after_condition(bare)), F.lit("")))
        top = F.element_at(state.open, -1) + depth
        lower = F.slice(state.open, F.lit(1), F.greatest(F.size(state.open) - 1, F.lit(0)))
        inside = F.size(state.open) > 0
        keep = F.concat(state.out, F.array(line))
        pair = lambda o, k: F.struct(o.alias("open"), k.alias("out"))
        return (
            F.when(guards & braced & (depth > 0), pair(F.concat(state.open, F.array(depth.cast("int"))), state.out))
            .when(guards, pair(state.open, F.when(body.isNotNull(), F.concat(state.out, F.array(F.concat(indent, body, newline)))).otherwise(state.out)))
            .when(inside & (top <= 0), pair(lower, state.out))
            .when(inside, pair(F.concat(lower, F.array(top.cast("int"))), keep))
            .otherwise(pair(state.open, keep))
        )

    return F.array_join(F.aggregate(lines, start, step, lambda s: s.out), "")


def ordered_arguments(code: str) -> str:
    """A source with the keyword arguments of each call after its positional ones; unchanged if its brackets or strings don't match.

    One walk with a stack of open brackets: a call is put in order when it closes, with those inside it already done.
    Strings and comments are passed over; an empty last argument is none. Calls in order keep their layout.
    """
    import re

    # Open brackets: bracket, whether it belongs to a call, its finished arguments, and the one being read.
    stack: list[list] = [["", False, [], []]]
    at, before = 0, ""
    token = re.compile(r"(?P<text>[A-Za-z]{0,2}(?:'''|\"\"\"|'|\"))|(?P<note>#[^\n]*)|(?P<name>\w+)|(?P<space>\s+)|(?P<other>.)", re.S)
    keyword = re.compile(r"(?:\s|#[^\n]*\n)*[A-Za-z_]\w*\s*=(?!=)")
    while at < len(code):
        m = token.match(code, at)
        piece, kind = m.group(), m.lastgroup
        if kind == "text":
            quote = piece.lstrip("".join(set(piece) - set("'\"")))
            end = re.compile(r"(?:\\.|(?!" + quote + (r").)*" if len(quote) == 3 else r")[^\n])*") + quote, re.S).match(code, m.end())
            if not end:
                return code
            piece = code[at : end.end()]
        at += len(piece)
        if kind == "other" and piece in "([{":
            stack.append([piece, piece == "(" and (before[-1:].isalnum() or before[-1:] in ("_", ")", "]")), [], []])
        elif kind == "other" and piece in ")]}":
            opened, is_call, done, last = stack.pop()
            if not stack or opened + piece not in ("()", "[]", "{}"):
                return code
            args = [*done, "".join(last)]
            tail = [args.pop()] if len(args) > 1 and not args[-1].strip() else []
            named = [bool(keyword.match(a)) for a in args]
            if is_call and any(x and not y for x, y in zip(named, named[1:], strict=False)):
                text = ", ".join(a.strip() for _, a in sorted(zip(named, args, strict=True), key=lambda x: x[0]))
            else:
                text = ",".join(args + tail)
            stack[-1][3].append(opened + text + piece)
        elif kind == "other" and piece == "," and len(stack) > 1:
            stack[-1][2].append("".join(stack[-1][3]))
            stack[-1][3] = []
        else:
            stack[-1][3].append(piece)
        if kind not in ("space", "note"):
            before = piece
    return "".join(stack[0][3]) if len(stack) == 1 else code


def call_reorder(source: Column) -> Column:
    """``ordered_arguments`` of each source; null stays null."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

    @F.pandas_udf("string")
    def ordered(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else ordered_arguments(s))

    return ordered(source)
