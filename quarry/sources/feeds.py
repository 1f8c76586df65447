"""Results of web engines (RSS and Atom), engine descriptions, and saved queries."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass
from urllib.parse import quote_plus

import pandas as pd
from pyspark.sql import DataFrame

from quarry.functions.extract import LENGTH


def _name(e) -> str:
    return e.tag.rsplit("}", 1)[-1].lower()


def _text(e, *names: str) -> str:
    return next(("".join(c.itertext()).strip() for n in names for c in e if _name(c) == n), "")


def parse_feed(xml: str, mime: str = "application/xml") -> list[tuple[str, str, str, int]]:
    """(title, url, extract, score) of each item or entry, scored 100, 99, 98...; what isn't XML gives nothing."""
    if "xml" not in mime:
        return []
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    rows = []
    for e in root.iter():
        if _name(e) not in ("item", "entry"):
            continue
        links = [c for c in e if _name(c) == "link"]
        link = next((c for c in links if c.get("rel", "alternate") == "alternate"), links[0] if links else None)
        url = "" if link is None else (link.get("href") or (link.text or "").strip())
        rows.append((_text(e, "title"), url, _text(e, "description", "summary", "content")[:LENGTH], 100 - len(rows)))
    return rows


def feed_results(feeds: DataFrame) -> DataFrame:
    """feeds(engine, type, content): engine, title, url, extract, score of every result."""

    def run(batches):
        for b in batches:
            rows = [(e, *r) for e, m, x in zip(b.engine, b.type, b.content) for r in parse_feed(x or "", m or "")]
            yield pd.DataFrame(rows, columns=["engine", "title", "url", "extract", "score"])

    return feeds.select("engine", "type", "content").mapInPandas(run, "engine string, title string, url string, extract string, score int")


def parse_description(xml: str) -> dict[str, str]:
    """name, description and url template of an engine description."""
    root = ET.fromstring(xml)
    urls = [e for e in root if _name(e) == "url"]
    url = next((e for e in urls if "xml" in e.get("type", "")), urls[0] if urls else None)
    return {"name": _text(root, "shortname"), "description": _text(root, "description"), "template": "" if url is None else url.get("template", "")}


def fill_template(template: str, terms: str, count: int = 10, start: int = 1, language: str = "en") -> str:
    """The template's URL for a page of results; optional parameters may be marked by a question mark."""
    values = {"searchTerms": quote_plus(terms), "count": count, "startIndex": start, "startPage": (start - 1) // max(count, 1) + 1, "language": language, "inputEncoding": "UTF-8", "outputEncoding": "UTF-8"}
    for k, v in values.items():
        template = template.replace(f"{{{k}}}", str(v)).replace(f"{{{k}?}}", str(v))
    return template


@dataclass(frozen=True)
class StoredQuery:
    name: str
    text: str
    sort: str = "RELEVANCE"
    language: str = ""
    max_results: int = 10
    label: str = ""


#: The queries that every new user has.
DEFAULT_QUERIES = [
    StoredQuery("Latest First", "dir:/", "DATE_DESC"),
    StoredQuery("10kb And Smaller", "0..10240b", "SIZE_DESC"),
    StoredQuery("Home Stuff", "dir:~"),
    StoredQuery("With Label New", "label:New"),
    StoredQuery("Have CJKV", "tokens:CJKV"),
    StoredQuery("In English", "lang:en"),
]


def load_queries(xml: str) -> list[StoredQuery]:
    """Saved queries; older fields are folded into one query text: all words, a phrase, alternatives, exclusions,
    then filters. Fewer than ten results are never asked for."""
    found = []
    for e in ET.fromstring(xml).iter():
        if _name(e) not in ("storedquery", "query"):
            continue
        parts = [_text(e, "text"), _text(e, "and")]
        if phrase := _text(e, "phrase"):
            parts.append(f'"{phrase}"')
        if either := _text(e, "any").split():
            parts.append("(" + " OR ".join(either) + ")")
        parts += [f"-{w}" for w in _text(e, "not").split()]
        for field, names in (("lang", ("language",)), ("site", ("host", "hostfilter")), ("file", ("file", "filefilter")), ("label", ("labelfilter",))):
            if value := _text(e, *names):
                parts.append(f'{field}:"{value}"' if " " in value else f"{field}:{value}")
        if (low := _text(e, "mindate")) or _text(e, "maxdate"):
            parts.append(f"{low}..{_text(e, 'maxdate')}")
        count = _text(e, "maxresults")
        found.append(StoredQuery(_text(e, "name"), " ".join(p for p in parts if p), _text(e, "sortorder") or "RELEVANCE", _text(e, "stemming"), max(10, int(count) if count.isdigit() else 10), _text(e, "label")))
    return found


def normalize_query(text: str) -> str:
    """Trimmed, on one line, words mended that a hyphen broke at a line's end."""
    return text.strip().replace("\r\n", "\n").replace("-\n", "").replace("\n", " ")


def without_filters(text: str) -> str:
    return " ".join(w for w in normalize_query(text).split() if ":" not in w and ".." not in w)


def more_like(text: str, terms: list[str]) -> str:
    """The query that finds more of the same: what was asked, or any of the expansion terms."""
    return " OR ".join([f"({text})"] * bool(text) + terms)


TAG = re.compile(r"""<\s*(/?\w+)((?:\s+[\w:-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?)*)\s*/?>""")
ATTRIBUTE = re.compile(r"""([\w:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")


def parse_plugin(text: str) -> dict:
    """An engine in the older plug-in format: name, description, action and method of <search>, the names and values of <input>
    (user marks the one that takes the terms), and the markers of <interpret>. Lines that begin with # are comments."""
    text = "\n".join(x for x in text.splitlines() if not x.lstrip().startswith("#"))
    out = {"name": "", "description": "", "action": "", "method": "GET", "user": "", "inputs": {}, "next": None, "interpret": {}}
    for m in TAG.finditer(text):
        tag = m[1].lower()
        a = {k.lower(): v1 or v2 or v3 for k, v1, v2, v3 in ATTRIBUTE.findall(m[2])}
        if tag == "search":
            out.update({k: a[k] for k in ("name", "description", "action", "method") if a.get(k)})
        elif tag == "input" and "user" in a:
            out["user"] = a.get("name", "")
        elif tag == "input" and a.get("name"):
            out["inputs"][a["name"]] = a.get("value", "")
        elif tag in ("inputnext", "inputprev"):
            out["next"] = out["next"] or (a.get("name", ""), int(a["factor"]) if a.get("factor", "").isdigit() else 10)
        elif tag == "interpret":
            out["interpret"].update(a)
    return out


def plugin_url(plugin: dict, terms: str, page: int = 0) -> str:
    """The URL of a page of an engine's results."""
    fields = {**plugin["inputs"], plugin["user"]: terms}
    if plugin["next"] and page:
        fields[plugin["next"][0]] = str(plugin["next"][1] * page)
    return plugin["action"] + "?" + "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in fields.items() if k)


def _between(text: str, start: str, end: str) -> list[str]:
    out, at = [], 0
    while start and (a := text.find(start, at)) >= 0:
        b = text.find(end, a + len(start)) if end else -1
        out.append(text[a + len(start) : b if b >= 0 else len(text)])
        at = b + len(end) if b >= 0 else len(text)
    return out


def plugin_results(plugin: dict, html: str) -> list[tuple[str, str, str, int]]:
    """(title, url, extract, score) of a page's results: the list and its items are cut by the plug-in's markers, once more
    with the other kind of quotes if that finds nothing. An item's first link is the result."""
    from quarry.sources.filters import html_page

    marks = {k: plugin["interpret"].get(k.lower(), "") for k in ("resultListStart", "resultListEnd", "resultItemStart", "resultItemEnd")}
    swap = str.maketrans("\"'", "'\"")
    for turn in (lambda x: x, lambda x: x.translate(swap)):
        lists = _between(html, turn(marks["resultListStart"]), turn(marks["resultListEnd"])) if marks["resultListStart"] else [html]
        items = [i for x in lists[:1] for i in _between(x, turn(marks["resultItemStart"]), turn(marks["resultItemEnd"]))]
        rows = []
        for item in items:
            page = html_page(item.encode())
            if page.links:
                url, title = page.links[0]
                rows.append((title, url, " ".join("".join(page.text).split())[:LENGTH], 100 - len(rows)))
        if rows:
            return rows
    return []


def paged(fetch, parse, url_of, wanted: int) -> list[tuple]:
    """Results of an engine page by page, until there are enough, a page is short or brings nothing new, or url_of(page) is
    None (the engine doesn't scroll). fetch(url) gives a page's text; scores go on falling."""
    found, seen, page, full = [], set(), 0, 0
    while len(found) < wanted and (url := url_of(page)) is not None:
        whole = parse(fetch(url))
        rows = [r for r in whole if r[1] not in seen]
        if not rows:
            break
        found += rows
        seen |= {r[1] for r in rows}
        if len(whole) < full:
            break
        full, page = max(full, len(whole)), page + 1
    return [(*r[:3], max(100 - k, 0)) for k, r in enumerate(found[:wanted])]
