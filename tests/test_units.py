"""Literal rows for functions, filters, the parser and streams."""

from __future__ import annotations

import io
import tarfile
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions import url as u
from quarry.plans.query import parse
from quarry.sources.filters import reduce_document
from quarry.streaming.moves import pair_moves, pair_moves_stream


def one(spark, c, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [("end. U.S.A. ... x,y", ["end", "u.s.a.", "x", "y"]), ("", []), (None, []), ("École—naïve", ["école", "naïve"])])
def test_tokens(spark, text, want):
    assert one(spark, tx.tokens(F.col("t")), t=text) == want


def test_cjkv(spark):
    assert one(spark, tx.cjkv_grams(F.col("t")), t="你好") == ["你", "你好", "好"]
    assert one(spark, tx.has_cjkv(F.col("t")), t="a 你") and not one(spark, tx.has_only_cjkv(F.col("t")), t="a 你")
    assert one(spark, tx.strip_accents(F.col("t")), t="éèàç") == "eeac"


@pytest.mark.parametrize("url, want", [("http://Host.example/a/b.html?x=1", ("http", "Host.example", "a", "b.html", "x=1")), ("/home/u/f.txt", ("file", "localhost", "/home/u", "f.txt", "")), ("ftp://u:p@h:21/", ("ftp", "h:21", "", "", ""))])
def test_url_parts(spark, url, want):
    assert tuple(one(spark, u.parts(F.col("t")), t=url)) == want


def test_url_functions(spark):
    assert one(spark, u.canonical(F.col("t")), t="http://HOST.com/dir/") == "http://host.com/dir"
    assert one(spark, u.canonical(F.col("t")), t="http://host.com/") == "http://host.com/"
    assert one(spark, u.escape(F.col("t")), t="a b/é") == "a%20b/%C3%A9" and one(spark, u.unescape(F.col("t")), t="a%20b/%C3%A9+") == "a b/é+"
    assert one(spark, u.reduce_host(F.col("t"), 2), t="a.b.com") == "b.com"
    assert "a size 3 b" in one(spark, u.record(F.lit("u"), F.col("t"), F.lit("text/plain"), F.lit(3)), t="a size=3 b")


def test_filters():
    page = b"junk<!DOCTYPE html><title>T &amp; U</title><meta name=keywords content='k1 k2'><script>no</script><p>a&lt;b</p><a href='/x'>one  two</a>"
    ((_, ipath, title, kind, text, links),) = list(reduce_document("u", "text/html; charset=utf-8", page))
    assert (ipath, title, kind, text) == ("", "T & U", "text/plain", "a<b one two k1 k2") and links == [{"url": "/x", "name": "one  two".replace("  ", " ")}]
    assert next(reduce_document("u", "application/json", b'{"a":"x","b":{"c":"y"},"d":1}'))[4] == "x y 1"
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w") as t:
        for name, data in (("a.txt", b"plain"), ("d/b.html", b"<p>hi</p>")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    got = list(reduce_document("u", "application/x-tar", buf.getvalue()))
    assert [(g[1], g[4]) for g in got] == [("f=a.txt", "plain"), ("f=d/b.html", "hi")]
    mbox = b"From a\nSubject: one\n\nhello\n\nFrom b\nX-Mozilla-Status: 0008\nSubject: gone\n\nx\n"
    assert [(g[2], g[4].strip()) for g in reduce_document("u", "application/mbox", mbox)] == [("one", "hello")]
    assert list(reduce_document("u", "application/x-tar", b"not a tar")) == []


def test_parser():
    assert parse("a b OR c") == ("or", [("and", [("word", "a"), ("word", "b")]), ("word", "c")])
    assert parse('type:text/html AND (tcp NEAR ip)') == ("and", [("filter", "type:text/html"), ("near", "tcp", "ip")])
    assert parse("-x y*") == ("and", [("not", ("word", "x")), ("prefix", "y*")])
    with pytest.raises(ValueError):
        parse("  ")


def test_moves(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "MOVED_FROM", "/a", 1), ("2024-01-01 00:00:05", "MOVED_TO", "/b", 1), ("2024-01-01 00:00:06", "MOVED_TO", "/c", 2), ("2024-01-01 00:00:07", "MOVED_FROM", "/d", 3), ("2024-01-01 00:00:08", "WRITE_CLOSED", "/e", 4)]
    e = spark.createDataFrame(rows, "ts string, kind string, location string, cookie long").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {("MOVED", "/b", "/a"), ("CREATED", "/c", None), ("WRITE_CLOSED", "/e", None)}
    assert {(r.kind, r.location, r.previous) for r in pair_moves(e).collect()} == want | {("DELETED", "/d", None)}
    e.write.parquet(str(tmp_path / "in"))
    q = pair_moves_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("moves").outputMode("append").start()
    try:
        end = time.time() + 60  # with a processing-time timeout batches never stop
        while time.time() < end and spark.sql("SELECT * FROM moves").count() < 3:
            time.sleep(1)
        assert {(r.kind, r.location, r.previous) for r in spark.sql("SELECT * FROM moves").collect()} == want
    finally:
        q.stop()


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("generalizations", "gener"), ("electricity", "electr"), ("hopefulness", "hope"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controlling", "control"), ("yes", "ye"), ("été", "été"), ("a1s", "a1s")])
def test_stem(word, want):
    from quarry.functions.language import stem_word

    assert stem_word(word) == want


def test_languages(spark):
    from quarry.functions.language import languages, stem_language

    assert one(spark, languages(F.col("t")), t="The cat and the dog; le chat") == ["en", "fr"]
    assert one(spark, languages(F.col("t")), t=None) == ["unknown"]
    assert one(spark, stem_language(F.col("t"), F.array(F.lit("fr"), F.lit("en"))), t="") == "en"
    assert one(spark, stem_language(F.col("t"), F.array(F.lit("fr"))), t="") == "unknown"


def test_extracts(spark):
    from quarry.functions.extract import highlight, snippet

    assert one(spark, highlight(F.col("t"), ["cat", "a"]), t="A cat <a cat> category") == "<b>A</b> <b>cat</b> &lt;<b>a</b> <b>cat</b>&gt; category"
    assert one(spark, snippet(F.col("t"), ["end"]), t="x " * 500 + "end z") == ("x " * 500 + "end z")[939:]
    assert one(spark, snippet(F.col("t"), ["none"]), t="abc") == "abc"


def test_feeds_and_saved_queries():
    from quarry.sources.feeds import DEFAULT_QUERIES, fill_template, load_queries, more_like, normalize_query, parse_description, parse_feed, without_filters

    rss = "<rss><channel><item><title>A</title><link>http://a/</link><description>one</description></item><item><title>B</title><link>http://b/</link></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>C</title><link rel="self" href="http://s/"/><link href="http://c/"/><summary>s</summary></entry></feed>'
    assert parse_feed(rss) == [("A", "http://a/", "one", 100), ("B", "http://b/", "", 99)]
    assert parse_feed(atom, "application/atom+xml") == [("C", "http://c/", "s", 100)]
    assert parse_feed(rss, "text/html") == [] == parse_feed("<rss", "text/xml")
    d = parse_description('<OpenSearchDescription><ShortName>N</ShortName><Url type="text/html" template="h"/><Url type="application/rss+xml" template="http://e/?q={searchTerms}&amp;n={count?}"/></OpenSearchDescription>')
    assert d["name"] == "N" and fill_template(d["template"], "a b", 5) == "http://e/?q=a+b&n=5"
    q = load_queries("<conf><storedquery><name>n</name><and>a b</and><phrase>c d</phrase><any>e f</any><not>g</not><language>en</language><maxresults>3</maxresults></storedquery></conf>")[0]
    assert (q.text, q.max_results) == ('a b "c d" (e OR f) -g lang:en', 10)
    for x in [q, *DEFAULT_QUERIES]:
        parse(x.text)
    assert normalize_query(" a-\r\nb\nc ") == "ab c" and without_filters("a lang:en 1..2b b") == "a b"
    assert more_like("x", ["y", "z"]) == "(x) OR y OR z"


def test_service_and_exports(spark, data, tmp_path):
    from quarry.service import SearchIndex
    from quarry.sources import exports
    from quarry.sources import tables as src

    x = SearchIndex(src.doc_info(spark, data), src.doc_labels(spark, data))
    n = x.documents_count()
    page = x.query("with lang:en", limit=5).collect()
    assert 0 < len(page) <= 5 and all(r["language"] == "en" and "with" in r["extract"].lower() for r in page)
    assert [r["score"] for r in page] == sorted((r["score"] for r in page), reverse=True)
    i = page[0]["doc_id"]
    assert x.has_document(page[0]["url"]) == i and x.has_document("no") == 0 and x.terms_count(i) > 0
    y = x.set_labels([i], ["Mine", "X-a"]).set_labels([i], [], ["Mine", "X-a"])
    assert "X-a" in y.document_labels(i) and "Mine" not in y.document_labels(i)
    assert y.query("label:X-a").count() == 1 and y.documents_count("X-a") == 1
    assert x.unindex([i]).documents_count() == n - 1 and x.search_within("with", [i]).count() == 1
    with pytest.raises(ValueError):
        x.query("  ")
    r = x.docs.filter(F.col("doc_id") == i).select(F.lit('a"b').alias("query"), F.lit("e").alias("engine"), F.lit("<b>t</b>").alias("caption"), "url", "type", "language", F.col("datetime_key").alias("modtime"), "size", F.lit(None).alias("abstract"))
    assert exports.write_csv(r, f"{tmp_path}/o") and not exports.write_csv(r.limit(0), f"{tmp_path}/p") and not (tmp_path / "p").exists()
    lines = next((tmp_path / "o").glob("*.csv")).read_text().splitlines()
    assert lines[0] == ";".join(f'"{c}"' for c in exports.COLUMNS) and lines[1].startswith('"a""b";"e";" t ";"file:///')
    assert "<title> t </title>" in exports.to_rss(r, "q", "e")
