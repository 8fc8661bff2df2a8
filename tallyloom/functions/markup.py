"""Markup as token lists, and their similarity."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from .ratio import list_ratio


#: Tags around the contents of a page.
WRAPPERS = ("html", "head", "body", "!doctype")


def dom_tokens(html: str) -> list[str]:
    """The tree of a page's contents as a list: <tag .sorted.classes #id [type=x]>, T:text and </tag> of each node.

    An end tag closes the node that is open last, whatever its name, and a tag without an end holds all that follows until then.
    Where the page is one html, head or body, its contents are those of the body right below, or else all but such tags.
    """
    from html.parser import HTMLParser

    root = ("", "", [])  # tag, token, children
    open_nodes = [root]

    def opening(tag, attributes):
        a = {k: v or "" for k, v in attributes}
        parts = [tag, *(["." + ".".join(sorted(a["class"].split()))] if "class" in a else []), *([f"#{a['id']}"] if "id" in a else []), *([f"[type={a['type']}]"] if "type" in a else [])]
        node = (tag, f"<{' '.join(parts)}>", [])
        open_nodes[-1][2].append(node)
        return node

    class Tree(HTMLParser):
        def handle_starttag(self, tag, attrs):
            open_nodes.append(opening(tag, attrs))

        def handle_startendtag(self, tag, attrs):
            opening(tag, attrs)

        def handle_endtag(self, tag):
            if len(open_nodes) > 1:
                open_nodes.pop()

        def handle_data(self, data):
            if text := " ".join(data.split()):
                open_nodes[-1][2].append(("", "T:" + text, []))

    Tree().feed(html)
    contents = root[2]
    if len(contents) == 1 and contents[0][0] in WRAPPERS:
        inner = contents[0][2]
        contents = next((c[2] for c in inner if c[0] == "body"), [c for c in inner if c[0] not in WRAPPERS])
    out: list[str] = []
    waiting = list(reversed(contents))
    while waiting:
        node = waiting.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        tag, token, children = node
        out.append(token)
        if tag:
            waiting.append(f"</{tag}>")
            waiting.extend(reversed(children))
    return out


def markup_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of token lists; equal or both empty is 1."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([1.0 if p == q else list_ratio(dom_tokens(p or ""), dom_tokens(q or "")) for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)
