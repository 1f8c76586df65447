"""Document filters: bytes or markup to text and metadata, one row to many; a registry by MIME type."""

from __future__ import annotations

import bz2
import email
import email.utils
import gzip
import html
import html.parser
import io
import json
import os
import re
import tarfile
import zlib
from email import policy

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.mime import ancestors, mime_type
from quarry.sources.charset import to_utf8

FILTERS: dict[str, object] = {}
OUT = "url string, ipath string, title string, type string, text string, links array<struct<url:string,name:string>>"
#: Bytes of a nested document beyond which it is left out, if the environment says so.
NESTED_SIZE = "QUARRY_MAXIMUM_NESTED_SIZE"
#: What a document can do to its filter; it is then a document without text.
BROKEN = (ValueError, EOFError, OSError, RecursionError, LookupError, AttributeError, TypeError, tarfile.TarError, zlib.error, MemoryError)


def document_filter(*types: str):
    def add(f):
        FILTERS.update(dict.fromkeys(types, f))
        return f

    return add


class _Page(html.parser.HTMLParser):
    """Each tag adds a space; scripts and styles are left out; anchors are collected."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.title, self.meta, self.links, self.skip, self.in_title, self.link = [], [], {}, [], 0, False, None
        self.between = [[]]  # text between links, for the abstract

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.text.append(" ")
        self.skip += tag in ("script", "style", "frameset")
        self.in_title = tag == "title" or self.in_title
        if tag == "meta" and a.get("name"):
            self.meta[a["name"].lower()] = a.get("content") or ""
        if tag == "a" and a.get("href"):
            self.link = (a["href"], [])
            self.between.append([])
        if tag == "frame" and a.get("src"):
            self.links.append((a["src"], a.get("name") or ""))

    def handle_endtag(self, tag):
        self.text.append(" ")
        self.skip -= tag in ("script", "style", "frameset") and self.skip > 0
        if tag == "title":
            self.in_title = False
        if tag == "a" and self.link:
            self.links.append((self.link[0], " ".join("".join(self.link[1]).split())))
            self.link = None

    def handle_data(self, data):
        if self.skip:
            return
        (self.title if self.in_title else self.text).append(data)
        if self.link:
            self.link[1].append(data)
        elif not self.in_title:
            self.between[-1].append(data)

    def abstract(self) -> str:
        """The longest text between two links."""
        return max((" ".join("".join(x).split()) for x in self.between), key=len, default="")


CHARSET = re.compile(rb"""(?i)<meta[^>]+charset\s*=\s*["']?([A-Za-z0-9_:.-]+)""")


def html_page(data: bytes, charset: str = "") -> _Page:
    """A page read in the charset that it names itself, or the one given, or UTF-8."""
    found = CHARSET.search(data[:4096])
    raw = to_utf8(data, found[1].decode() if found else charset)
    at = raw.upper().find("<!DOCTYPE")
    p = _Page()
    p.feed(raw[max(at, 0) :])
    p.close()
    return p


@document_filter("text/html")
def html_filter(url: str, data: bytes, charset: str = ""):
    p = html_page(data, charset)
    text = " ".join(("".join(p.text) + " " + p.meta.get("keywords", "")).split())
    yield ("", " ".join("".join(p.title).split()), "text/plain", text.encode(), [{"url": u, "name": n} for u, n in p.links])


def robots_allow(data: bytes) -> bool:
    """Whether a page's robots meta tag lets it be indexed."""
    said = {x.strip().lower() for x in html_page(data).meta.get("robots", "").split(",")}
    return not said & {"none", "noindex"}


@document_filter("text/xml", "application/xml")
def xml_filter(url: str, data: bytes):
    named = re.match(rb"""\s*<\?xml[^>]*encoding\s*=\s*["']([A-Za-z0-9_:.-]+)""", data[:200])
    text = re.sub("<[^>]*>", " ", to_utf8(data, named[1].decode() if named else ""))
    yield ("", "", "text/plain", html.unescape(text).encode(), [])


def _leaves(x):
    """Depth first, by a stack: nesting may be deep."""
    stack = [x]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            stack += reversed(x.values())
        elif isinstance(x, list):
            stack += reversed(x)
        elif x is not None:
            yield x if isinstance(x, str) else json.dumps(x)


@document_filter("application/json")
def json_filter(url: str, data: bytes):
    try:
        text = " ".join(_leaves(json.loads(data)))
    except RecursionError:  # the parser's own limit: strings and numbers in order, but for the keys
        pairs = re.finditer(r'"((?:[^"\\\\]|\\\\.)*)"(\s*:)?|(-?\d[\d.eE+-]*|true|false)', data.decode("utf-8", "replace"))
        text = " ".join(m[3] or m[1] for m in pairs if not m[2])
    except ValueError:
        text = ""
    yield ("", "", "text/plain", text.encode(), [])


#: The line that begins a message: at the start or after an empty line, an address or name and, with more words, a year.
FROM = re.compile(rb"(?m)(?:\A|(?<=\n\n)|(?<=\n\r\n))From \S+(?:[ \t][^\n]*\d{4}[^\n]*)?[ \t\r]*$")


def _mail_gone(msg) -> bool:
    """Marked as deleted by Mozilla (bits 0x0008, 0x0040) or Evolution (bit 0x0002)."""
    status, evolution = str(msg.get("X-Mozilla-Status", "")).strip(), str(msg.get("X-Evolution", "")).partition("-")[2][:4]
    one = re.fullmatch(r"[0-9A-Fa-f]{4}", status) and int(status, 16) & 0x48
    two = re.fullmatch(r"[0-9A-Fa-f]{4}", evolution) and int(evolution, 16) & 0x02
    return bool(one or two)


def mail_date(msg) -> str:
    """The Date, else that of the last Received, in ISO form; nothing if neither is a date."""
    for text in (str(msg.get("Date", "")), str(msg.get("Received", "")).rpartition(";")[2]):
        try:
            return email.utils.parsedate_to_datetime(text.strip()).isoformat()
        except (ValueError, TypeError, IndexError):
            continue
    return ""


@document_filter("application/mbox", "text/x-mail", "message/rfc822", "text/x-news")
def mbox_filter(url: str, data: bytes):
    """Messages and their text parts; messages marked as deleted are left out."""
    starts = [m.span() for m in FROM.finditer(data)] or [(0, 0)]
    for k, (start, body) in enumerate(starts):
        end = starts[k + 1][0] if k + 1 < len(starts) else len(data)
        msg = email.message_from_bytes(data[body:end].lstrip(b"\r\n"), policy=policy.default)
        if _mail_gone(msg):
            continue
        for level, part in enumerate(p for p in msg.walk() if not p.is_multipart()):
            payload, kind = part.get_payload(decode=True) or b"", part.get_content_type()
            if kind.startswith("text/"):
                payload = to_utf8(payload, part.get_content_charset() or "").encode()
            yield (f"o={start}&l=[{level}]", str(msg.get("Subject", "")), kind, payload, [])


def _limit() -> float:
    value = os.environ.get(NESTED_SIZE, "")
    return int(value) if value.isdigit() else float("inf")


NESTED = {".tar": "application/x-tar", ".tgz": "application/x-tar", ".tar.gz": "application/x-tar", ".html": "text/html", ".htm": "text/html", ".json": "application/json", ".xml": "application/xml", ".mbox": "application/mbox"}


def nested_type(name: str) -> str:
    return next((t for end, t in NESTED.items() if name.endswith(end)), "text/plain")


@document_filter("application/x-tar", "application/gzip", "application/x-bzip2", "application/x-compressed-tar")
def archive_filter(url: str, data: bytes):
    """Members of an archive, or what a compressed file holds. What comes before damage is kept."""
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile() and m.size <= _limit():
                    yield (f"f={m.name}", m.name.rsplit("/", 1)[-1], nested_type(m.name), t.extractfile(m).read(), [])
        return
    except tarfile.ReadError:
        pass
    except BROKEN:
        return
    for opened, magic in ((gzip.open, b"\x1f\x8b"), (bz2.open, b"BZh")):
        if data.startswith(magic):
            try:
                with opened(io.BytesIO(data)) as f:
                    yield ("", "", "text/plain", f.read(), [])
            except BROKEN:
                return


@document_filter("application/x-archive", "application/vnd.debian.binary-package")
def ar_filter(url: str, data: bytes):
    """Members of an ar archive: a header of 60 bytes each, names of 16, sizes of 10 digits, even offsets."""
    at = 8
    while data.startswith(b"!<arch>\n") and at + 60 <= len(data):
        name, size = data[at : at + 16].decode("latin-1").strip().rstrip("/"), data[at + 48 : at + 58].strip()
        if not size.isdigit():
            return
        body = data[at + 60 : at + 60 + int(size)]
        if len(body) <= _limit():
            yield (f"f={name}", name, nested_type(name) if not name.endswith((".tar.xz", ".tar.bz2")) else "application/x-tar", body, [])
        at += 60 + int(size) + int(size) % 2


def filter_of(mime: str):
    """The filter of a type, or of the nearest type that it also is; plain text needs none."""
    for t in (mime, *ancestors(mime)):
        if t in FILTERS or t == "text/plain":
            return FILTERS.get(t)
    return None


def one_part(url: str, mime: str, data: bytes, ipath: str) -> bytes:
    """The bytes of a document inside containers, by its path."""
    kind, body = (mime or "").partition(";")[0].strip(), data
    for step in ipath.split("&next&") if ipath else []:
        f = filter_of(kind)
        found = next(((k, b) for sub, _, k, b, _ in f(url, body) if sub == step), None) if f else None
        if found is None:
            raise KeyError(ipath)
        kind, body = found
    return body


def reduce_document(url: str, mime: str, data: bytes, depth: int = 6):
    """Filter until everything is plain text; nested documents come out as rows of their own. A top document's title wins;
    one without any is titled by its file. A document that its filter can't read has no text."""
    todo = [("", "", mime or "", data or b"", [], 0)]
    while todo:
        ipath, title, full, body, links, level = todo.pop(0)
        kind, _, rest = full.partition(";")
        kind, charset = kind.strip(), rest.partition("charset=")[2].strip().strip("\"'")
        f = filter_of(kind)
        if f is None or level >= depth:
            yield url, ipath, title, kind, to_utf8(body, charset) if kind.startswith("text/") else "", links
            continue
        try:
            parts = list(f(url, body, charset) if f is html_filter else f(url, body))
        except BROKEN:
            yield url, ipath, title, kind, "", links
            continue
        for sub, name, sub_kind, sub_body, sub_links in parts:
            todo.append(("&next&".join(x for x in (ipath, sub) if x), title or name, sub_kind, sub_body, sub_links or links, level + 1))


def apply_filters(files: DataFrame) -> DataFrame:
    """files: url, type, content (binary)."""

    def run(batches):
        for pdf in batches:
            rows = [r for u, t, c in zip(pdf["url"], pdf["type"], pdf["content"]) for r in reduce_document(u, t, bytes(c) if c is not None else b"")]
            yield pd.DataFrame(rows, columns=["url", "ipath", "title", "type", "text", "links"])

    return files.select("url", "type", "content").mapInPandas(run, OUT)


def crawl(spark, path: str, max_size: int = (1 << 31) - 1, max_depth: int | None = None, blocked: list[str] = (), overrides: dict[str, str] | None = None) -> DataFrame:
    """A directory tree as files to filter: url, modtime, size, type, content. Names below the root that begin with a dot are
    skipped, and blocked patterns (* and ?) over whole URLs. max_depth: folders below the root. Files beyond max_size (by
    default, what a binary value holds) have null content."""
    root = path if re.match(r"\w+:", path) else "file:" + os.path.abspath(path)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    below = F.regexp_replace(F.substr(F.regexp_replace("path", "^(\\w+):/+", "$1:/"), F.lit(len(re.sub(r"^(\w+):/+", r"\1:/", root.rstrip("/"))) + 1)), "^/", "")
    keep = ~F.concat(F.lit("/"), below).rlike(r"/\.")
    if max_depth is not None:
        keep &= F.size(F.split(below, "/")) <= max_depth + 1
    for pattern in blocked:
        keep &= ~F.col("path").rlike("^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$")
    f = f.filter(keep)
    name = F.substring_index("path", "/", -1)

    def rows(x: DataFrame, content: Column, known: Column) -> DataFrame:
        return x.select(F.col("path").alias("url"), F.col("modificationTime").alias("modtime"), F.col("length").alias("size"), known.alias("type"), content.alias("content"))

    whole = rows(f.filter(f["length"] <= max_size), F.col("content"), mime_type(name, F.col("content"), overrides=overrides))
    return whole.unionByName(rows(f.filter(f["length"] > max_size), F.lit(None).cast("binary"), mime_type(name, overrides=overrides)))
