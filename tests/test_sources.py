"""Filters on damaged and unusual documents, charsets, crawls, and streams of changes."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import tarfile
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions.mime import ancestors
from quarry.sources.charset import decoded, to_utf8
from quarry.sources.filters import apply_filters, crawl, html_page, mail_date, one_part, reduce_document, robots_allow
from quarry.streaming.moves import pair_moves_stream


def tar(mode: str, **files: bytes) -> bytes:
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode=mode) as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return buf.getvalue()


def rows(mime: str, data: bytes) -> list[tuple]:
    return [(r[1], r[2], r[3], r[4]) for r in reduce_document("u", mime, data)]


def test_damaged_documents_do_no_harm(spark):
    whole = tar("w:gz", a=b"one " * 9000, b=bytes(range(256)) * 4000)
    deep = b"[" * 100_000 + b'"x"' + b"]" * 100_000
    for mime, data in [("application/gzip", whole[: len(whole) // 2]), ("application/x-tar", whole[:50]), ("application/json", deep), ("application/json", b"{"), ("application/x-bzip2", b"BZh9xx"), ("text/html", b"<p" * 10_000), ("application/x-archive", b"!<arch>\nbad"), ("application/mbox", b"\xff\xfe"), ("text/xml", None), ("", b"x")]:
        list(reduce_document("u", mime, data))
    files = spark.createDataFrame([("a", "application/gzip", whole[:500]), ("b", "application/json", deep), ("c", "text/plain", b"ok"), ("d", None, None)], "url string, type string, content binary")
    assert {r["url"]: r["text"] for r in apply_filters(files).collect()}["c"] == "ok"


def test_json_order():
    data = {"a": ["x", {"b": "y"}], "c": 1, "d": None, "e": True, "f": "z"}
    assert rows("application/json", json.dumps(data).encode())[0][3] == "x y 1 true z"


def test_mail():
    box = b"From a@b Mon Jan  1 00:00:00 2024\nSubject: one\n\nhello\nFrom here on, text\n\nFrom the start of a line\n\nFrom c@d Mon Jan  1 00:00:00 2024\nX-Evolution: 00000001-0002\nSubject: gone\n\nx\n\nFrom e@f Mon Jan  1 00:00:00 2024\nSubject: two\nContent-Type: text/plain; charset=iso-8859-1\n\ncaf\xe9\n"
    got = rows("application/mbox", box)
    assert [g[1] for g in got] == ["one", "two"] and "From the start" in got[0][3] and got[1][3].strip() == "café"
    assert one_part("u", "application/mbox", box, got[1][0]).decode().strip() == "café"
    import email
    from email import policy

    msg = lambda *h: email.message_from_string("\n".join(h) + "\n\nx", policy=policy.default)
    assert mail_date(msg("Date: Mon, 01 Jan 2024 10:00:00 +0000")).startswith("2024-01-01T10:00:00")
    assert mail_date(msg("Received: by x; Tue, 02 Jan 2024 10:00:00 +0000")).startswith("2024-01-02") and mail_date(msg("Subject: s")) == ""


def test_archives_and_paths():
    inner = tar("w", **{"deep.html": b"<p>hi</p>"})
    data = tar("w:bz2", **{"in.tar": inner, "x.json": b'{"k":"v"}'})
    got = {g[0]: g[3] for g in rows("application/x-bzip2", data)}
    assert got == {"f=x.json&next&": "v", "f=in.tar&next&f=deep.html": "hi"} or set(got.values()) == {"v", "hi"}
    assert one_part("u", "application/x-bzip2", data, "f=in.tar&next&f=deep.html") == b"<p>hi</p>"
    with pytest.raises(KeyError):
        one_part("u", "application/x-bzip2", data, "f=none")
    assert rows("application/gzip", gzip.compress(b"plain words"))[0][3] == "plain words" == rows("application/x-bzip2", bz2.compress(b"plain words"))[0][3]
    member = lambda name, body: name.ljust(16).encode() + b"0".ljust(12) + b"0".ljust(6) + b"0".ljust(6) + b"100644".ljust(8) + str(len(body)).ljust(10).encode() + b"`\n" + body + b"\n" * (len(body) % 2)
    deb = b"!<arch>\n" + member("debian-binary/", b"2.0") + member("b.txt/", b"words")
    assert [g[3] for g in rows("application/vnd.debian.binary-package", deb)] == ["2.0", "words"]


def test_nested_size(monkeypatch):
    data = tar("w", small=b"s", large=b"l" * 100)
    monkeypatch.setenv("QUARRY_MAXIMUM_NESTED_SIZE", "50")
    assert [g[0] for g in rows("application/x-tar", data)] == ["f=small"]


def test_pages():
    latin = '<html><head><meta charset="iso-8859-1"><meta name="robots" content="NOINDEX, follow"><title>T</title></head><body>café <a href="/1">one</a> a long stretch of text <a href="/2">two</a> short</body></html>'.encode("latin-1")
    assert rows("text/html", latin)[0][3] == "café one a long stretch of text two short" and not robots_allow(latin) and robots_allow(b"<p>x")
    assert html_page(latin).abstract() == "a long stretch of text"
    frames = b'<frameset><frame src="a.html" name="f"></frameset>'
    assert html_page(frames).links == [("a.html", "f")]
    assert rows("text/html; charset=iso-8859-1", b"<p>\xe9t\xe9")[0][3] == "été"


def test_parent_types():
    assert rows("application/rss+xml", b"<rss><a>x</a> y</rss>")[0][3].split() == ["x", "y"]
    assert rows("text/x-python", b"print(1)")[0][3] == "print(1)" and ancestors("text/x-chdr") == ["text/x-csrc", "text/plain"]


@pytest.mark.parametrize("data, charset, want", [(b"caf\xe9", "iso-8859-1", "café"), (b"caf\xe9", "ISO_8859-1", "café"), (b"a\xff\xfeb\xffc", "utf-8", "a?b?c"), (b"x", "no-such", "x"), ("я".encode("koi8-r"), "koi8_r", "я"), (b"", "", ""), (b"\xff" * 40, "ascii", "�" * 40)])
def test_charsets(data, charset, want):
    assert to_utf8(data, charset) == want


def test_charset_column(spark):
    df = spark.createDataFrame([(bytearray(b"caf\xe9"), "latin-1"), (None, "x")], "d binary, c string")
    assert [r[0] for r in df.select(decoded("d", "c")).collect()] == ["café", None]


def test_crawl_to_index(spark, tmp_path):
    root = tmp_path / ".hidden" / "root"
    (root / "sub" / "deeper").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / "a.html").write_bytes(b"<title>T</title><p>some words")
    (root / "noext").write_bytes(b"%PDF-1.4")
    (root / ".dot").write_bytes(b"x")
    (root / ".git" / "x.txt").write_bytes(b"x")
    (root / "sub" / "b.json").write_bytes(b'{"k": "value here"}')
    (root / "sub" / "deeper" / "c.txt").write_bytes(b"plain")
    found = crawl(spark, str(root))
    name = lambda df: {r["url"].rsplit("/", 1)[1]: r["type"] for r in df.collect()}
    assert name(found) == {"a.html": "text/html", "noext": "application/pdf", "b.json": "application/json", "c.txt": "text/plain"}
    assert set(name(crawl(spark, str(root), max_depth=1))) == {"a.html", "noext", "b.json"} and set(name(crawl(spark, str(root), blocked=["*.json", "*/deeper/*"]))) == {"a.html", "noext"}
    texts = {r["url"].rsplit("/", 1)[1]: r["text"] for r in apply_filters(found).collect()}
    assert texts["a.html"] == "some words" and texts["b.json"] == "value here" and texts["c.txt"] == "plain"


def test_streamed_moves_without_cookies(spark, tmp_path):
    events = [("2024-01-01 00:00:00", "MOVED_FROM", "/a", 1), ("2024-01-01 00:00:01", "MOVED_FROM", "/b", 1), ("2024-01-01 00:00:02", "MOVED_TO", "/c", 1), ("2024-01-01 00:00:03", "MOVED_TO", "/d", None), ("2024-01-01 00:00:04", "MOVED_FROM", "/e", None), ("2024-01-01 00:00:05", "CREATED", "/f", None)]
    e = spark.createDataFrame(events, "ts string, kind string, location string, cookie long").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = pair_moves_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("cookieless").outputMode("append").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.sql("SELECT * FROM cookieless").count() < 5:
            time.sleep(1)
        got = {(r.kind, r.location, r.previous) for r in spark.sql("SELECT * FROM cookieless").collect()}
        assert got == {("DELETED", "/a", None), ("MOVED", "/c", "/b"), ("CREATED", "/d", None), ("DELETED", "/e", None), ("CREATED", "/f", None)}
    finally:
        q.stop()


def test_stopwords_and_lists(spark):
    from quarry.functions.language import stopwords
    from quarry.operators import results

    assert stopwords(spark.createDataFrame([("# c",), (" The ",), ("",), ("of",)], "value string")) == {"the", "of"}
    r = spark.createDataFrame([(1, "B", "http://b/", 2.0), (2, "a", "http://a/", 1.0)], "doc_id long, title string, url string, score double")
    assert [x["title"] for x in results.ordered(r, "title").collect()] == ["a", "B"] == [x["title"] for x in results.ordered(r, "score").collect()]
    page, n = results.page(r, 1, 1)
    assert n == 2 and page.first()["doc_id"] == 2
    with pytest.raises(ValueError):
        results.ordered(r, "size")


def test_engine_paging():
    from quarry.catalog_index import PLUGIN
    from quarry.sources.feeds import paged, parse_plugin, plugin_url

    p = parse_plugin(PLUGIN)
    assert (p["name"], p["user"], p["inputs"], p["next"]) == ("Own", "q", {"src": "a b"}, ("start", 2))
    assert plugin_url(p, "x y") == "http://e.example/find?src=a+b&q=x+y" and plugin_url(p, "x", 2) == "http://e.example/find?src=a+b&q=x&start=4"
    pages = [["a", "b", "c"], ["c", "d", "e", "f"], ["g"], ["h", "i", "j"]]
    asked = []
    fetch = lambda url: asked.append(url) or pages[url]
    parse = lambda page: [(x, x, "", 0) for x in page]
    assert [r[0] for r in paged(fetch, parse, lambda k: k, 20)] == list("abcdefg") and asked == [0, 1, 2]
    assert [(r[0], r[3]) for r in paged(fetch, parse, lambda k: k, 2)] == [("a", 100), ("b", 99)]
    assert [r[0] for r in paged(fetch, parse, lambda k: 0 if k == 0 else None, 20)] == list("abc")
