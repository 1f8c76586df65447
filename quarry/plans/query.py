"""The query language: AND OR NOT + - brackets, "phrases", NEAR, wild*cards, field:filters and a..b ranges.

parse() gives a tree of tuples; predicate() turns it into one condition. match() evaluates it over documents in a single
scan without joins; operators.store evaluates the same tree over stored postings.
"""

from __future__ import annotations

import re
import unicodedata

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import CJKV, DOT, has_cjkv, tokens

LEX = re.compile(r'\s*(?:(\()|(\))|(\w+):"([^"]*)"|"([^"]*)"|([+-])(?=[("])|(\S+?)(?=[()]|\s|$))')
CJKV_CHAR = re.compile(CJKV)
BREAKS = regex.compile(r"[\p{P}\p{S}\p{Z}\s]+")
FILTERS = {"lang": "language", "type": "type", "site": "site", "file": "file", "ext": "ext", "url": "url", "dir": "dir", "class": "type", "label": "labels", "title": "title", "path": "dir", "inurl": "url", "tokens": "text"}


def lex(text: str) -> list[tuple[str, str]]:
    """(kind, value) of every word, phrase, filter, range, bracket and operator; + and - are kinds of their own."""
    out = []
    for m in LEX.finditer(text.strip()):
        if m[1] or m[2]:
            out.append(("(", "") if m[1] else (")", ""))
        elif m[3]:
            out.append(("filter", f"{m[3]}:{m[4]}"))
        elif m[5] is not None:
            out.append(("phrase", m[5]))
        elif m[7] in ("AND", "OR", "NOT", "NEAR", "ADJ"):
            out.append((m[7], ""))
        elif m[7]:
            w = m[7]
            if w[0] in "+-" and len(w) > 1:
                out.append((w[0], ""))
                w = w[1:]
            kind = "range" if ".." in w else "filter" if ":" in w and w.split(":")[0] in FILTERS else "prefix" if w.endswith("*") and len(w) > 1 else "word"
            out.append((kind, w))
        elif m[6]:
            out.append((m[6], ""))
    return out


def parse(text: str, default: str = "AND"):
    """An empty or unfinished query is an error. Filters of one name are alternatives; those of different names all
    hold. Words side by side bind closer than AND and NOT, and these closer than OR. Under OR as the default a word
    with + must be there, and then the unmarked ones needn't. A bracket that nothing opened is ignored."""
    toks = lex(text)
    if not toks:
        raise ValueError("empty query")
    at = 0

    def peek():
        return toks[at][0] if at < len(toks) else None

    def take():
        nonlocal at
        if at >= len(toks) or toks[at][0] in ("AND", "OR", "NEAR", "ADJ", ")"):
            raise ValueError("something is missing in the query")
        at += 1
        return toks[at - 1]

    def unit():
        nonlocal at
        kind, value = take()
        if kind == "(":
            node = either()
            at += peek() == ")"
            return node
        if kind in ("NOT", "-"):
            return ("not", unit())
        if kind == "+":
            return unit()
        node = (kind, value)
        while peek() in ("NEAR", "ADJ"):
            joined = peek().lower()
            at += 1
            node = (joined, node[-1], take()[1])
        return node

    def group():
        """Units side by side."""
        must, may, filters = [], [], []
        while True:
            kind = peek()
            node = unit()
            if node[0] in ("filter", "range"):
                filters.append(node)
            elif default == "AND" or kind in ("+", "-", "NOT"):
                must.append(node)
            else:
                may.append(node)
            if peek() in (None, ")", "OR", "AND", "NOT"):
                break
        loved = [n for n in must if n[0] != "not"]
        if may and not loved:
            must.append(("or", may) if len(may) > 1 else may[0])
        nodes = must + filters
        return ("and", nodes) if len(nodes) > 1 else nodes[0]

    def both():
        nonlocal at
        nodes = [group()]
        while peek() in ("AND", "NOT"):
            at += peek() == "AND"
            nodes.append(group())
        return ("and", nodes) if len(nodes) > 1 else nodes[0]

    def either():
        nonlocal at
        nodes = [both()]
        while peek() == "OR":
            at += 1
            nodes.append(both())
        return ("or", nodes) if len(nodes) > 1 else nodes[0]

    nodes = []
    while at < len(toks):
        if peek() == ")":
            at += 1
            continue
        nodes.append(either())
    if not nodes:
        raise ValueError("empty query")
    return ("and" if default == "AND" else "or", nodes) if len(nodes) > 1 else nodes[0]


def words_of(text: str) -> list[str]:
    """The terms of a piece of a query, cut as documents are cut."""
    terms = []
    for w in BREAKS.split(text.lower().replace(".", DOT)):
        t = w.replace(DOT, ".")
        bare = t.rstrip(".")
        terms.append(t if "." in bare else bare)
    return [t for t in terms if t]


def plain(word: str) -> str:
    """Without accents: decomposed, and marks left out."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def has_any_cjkv(word: str) -> bool:
    return CJKV_CHAR.search(word) is not None


def grams(word: str) -> list[str]:
    """Each character, then the pair that it begins."""
    return [g for i in range(len(word)) for g in (word[i], word[i : i + 2])[: 1 + (i + 1 < len(word))]]


def _range(value: str) -> Column:
    """a..b, a.. or ..b over dates (8 digits), times (6, or with colons) or sizes (with a b at the end)."""
    lo, hi = (x.replace(":", "") for x in value.split("..", 1))
    if hi.endswith("b"):
        column, lo, hi = F.col("size"), *(int(x) if x.isdigit() else None for x in (lo, hi[:-1]))
    else:
        column = F.col("date_key" if len(hi or lo) == 8 else "time_key")
    held = F.lit(True)
    if lo not in ("", None):
        held &= column >= lo
    if hi not in ("", None):
        held &= column <= hi
    return held


def leaf_words(node) -> list[list[str]]:
    """The terms of each side of a word, phrase or nearness."""
    return [words_of(x) for x in node[1:]]


def next_to(positions: list[Column]) -> Column:
    """Whether positions hold a run of neighbours, one of each."""
    if len(positions) == 1:
        return F.size(positions[0]) > 0
    held = lambda i: F.array_contains(positions[1], i + 1)
    for k in range(2, len(positions)):
        held = (lambda f, k: lambda i: f(i) & F.array_contains(positions[k], i + k))(held, k)
    return F.exists(positions[0], held)


def near(a: list[Column], b: list[Column], ordered: bool, window: int = 10) -> Column:
    """Whether some position of a (its first word's) is within the window of one of b, after it if ordered."""
    apart = lambda i, j: (j > i) & (j - i < window) if ordered else F.abs(i - j) < window
    return F.exists(a[0], lambda i: F.exists(b[0], lambda j: apart(i, j)))


def scanned(node) -> Column:
    """A word, prefix, phrase or nearness over a document's token array, _tokens."""
    t = F.col("_tokens")
    at = lambda w: F.filter(F.transform(t, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())
    if node[0] == "prefix":
        return F.exists(t, lambda x: x.startswith(node[1][:-1].lower()))
    sides = leaf_words(node)
    if not all(sides):
        return F.lit(False)
    if node[0] in ("near", "adj"):
        return near(*[[at(w) for w in x] for x in sides], node[0] == "adj")
    words = sides[0]
    if len(words) > 1:
        return F.contains(F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")), F.lit(f" {' '.join(words)} "))
    return F.array_contains(t, words[0])


def held_words(field: str, value: str) -> Column:
    """title: and path: over a document's columns: all words are among the field's; tokens: tells of scripts."""
    if field == "tokens":
        return has_cjkv(F.col("text")) & F.lit(value == "CJKV")
    held = tokens(F.col("title") if field == "title" else F.replace("url", F.lit("."), F.lit(" ")))
    return F.forall(F.array(*[F.lit(w) for w in re.findall(r"\w+", value.lower())]).cast("array<string>"), lambda w: F.array_contains(held, w))


def predicate(node, leaf=scanned, words_in=held_words) -> Column:
    """The query as one condition. leaf gives the condition of a word, prefix, phrase or nearness, words_in that of
    title:, path: and tokens:; everything else is over a document's columns."""
    kind, again = node[0], lambda n: predicate(n, leaf, words_in)
    if kind == "and":
        names: dict[str, Column] = {}
        rest = []
        for n in node[1]:
            if n[0] == "filter":
                k = n[1].split(":")[0]
                names[k] = again(n) | names[k] if k in names else again(n)
            else:
                rest.append(again(n))
        out = F.lit(True)
        for c in [*names.values(), *rest]:
            out = out & c
        return out
    if kind == "or":
        out = F.lit(False)
        for n in node[1]:
            out = out | again(n)
        return out
    if kind == "not":
        return ~again(node[1])
    if kind == "range":
        return _range(node[1])
    if kind == "filter":
        k, v = node[1].split(":", 1)
        if k == "label":
            return F.coalesce(F.array_contains("labels", v), F.lit(False))
        if k == "class":
            return F.col("type").startswith(v + "/")
        if k == "dir":
            return (F.col("dir") == v) | F.col("dir").startswith(v.rstrip("/") + "/")
        if k in ("title", "path", "tokens"):
            return words_in(k, v)
        if k == "inurl":
            return F.col("url").startswith(v)
        return F.col(FILTERS[k]) == v if k in FILTERS else F.lit(False)
    return leaf(node)


def match(docs: DataFrame, query: str, default: str = "AND") -> DataFrame:
    """The rows of docs (doc_info columns, text included) that the query finds, by one scan."""
    return docs.withColumn("_tokens", tokens(F.col("text"))).filter(predicate(parse(query, default))).drop("_tokens")
