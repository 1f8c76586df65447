"""Extracts of results: a window around the first hit, and hits marked in HTML. Terms are lower-case words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = r"[^\p{L}\p{N}<>]"
LENGTH, BEFORE = 300, 60


def _any(terms: list[str]) -> str:
    return "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))


def snippet(text: Column, terms: list[str]) -> Column:
    """At most 300 characters, beginning 60 before the first hit, or with the text if there is none."""
    before = F.regexp_extract(text, rf"(?is)^(.*?)(?:^|{EDGE})(?:{_any(terms)})(?:{EDGE}|$)", 1)
    return F.substr(text, F.greatest(F.length(before) - BEFORE, F.lit(0)) + 1, F.lit(LENGTH))


def highlight(text: Column, terms: list[str]) -> Column:
    """HTML-escaped text with <b> around every whole-word hit. Neighbouring hits share an edge, hence two passes;
    marked ones stand between angle brackets, which are no edge."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    for _ in range(2):
        text = F.regexp_replace(text, rf"(?i)(^|{EDGE})({_any(terms)})({EDGE}|$)", "$1<b>$2</b>$3")
    return text
