"""Queries over scalar functions: whole tables where SQL can say the same, literal rows with results worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import INFO
from quarry.functions import language as la
from quarry.functions import mime as mi
from quarry.functions import strings as st
from quarry.functions import text as tx
from quarry.functions import times as ti
from quarry.functions import url as u
from quarry.registry import query
from quarry.sources import tables as src


def literal(rows: list[tuple], *names: str) -> str:
    """Rows as SQL that both engines read; no backslashes."""
    cell = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


def frame(spark, rows: list[tuple], schema: str):
    return spark.createDataFrame(rows, schema)


def by_hand(name: str, cases: list[tuple], build, arguments: str = "x string"):
    """Registers build over literal rows; the last value of each case is its result."""
    sql = literal([(k, c[-1]) for k, c in enumerate(cases)], "id", "y").replace("SELECT *", "SELECT id::BIGINT AS id, y")

    @query(sql, name)
    def run(spark, sf):
        df = frame(spark, [(k, *c[:-1]) for k, c in enumerate(cases)], f"id long, {arguments}")
        return df.select("id", build().alias("y"))


@query("SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, CASE WHEN contains(url, '://') AND contains(split_part(url, '://', 2), '/') THEN split_part(split_part(url, '://', 2), '/', 1) ELSE '' END AS host, CASE WHEN regexp_matches(url, '[?#]') THEN regexp_extract(url, '^([^?#]*)', 1) ELSE '' END AS head FROM pages")
def extract_field(spark, sf):
    c = F.col("url")
    return src.table(spark, sf, "pages").select("page_id", st.extract_field(c, "://", "").alias("rest"), st.extract_field(c, "://", "/").alias("host"), st.extract_field(c, "", "?#", True).alias("head"))


@query("SELECT item_id, replace(text, 'th', '--') AS replaced, regexp_replace(' ' || text || chr(9) || ' ', '^[ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+$', '', 'g') AS trimmed FROM benchmark")
def replace_and_trim(spark, sf):
    b = src.table(spark, sf, "benchmark")
    return b.select("item_id", st.replace_substring(F.col("text"), "th", "--").alias("replaced"), st.trim_spaces(F.concat(F.lit(" "), F.col("text"), F.lit("\t "))).alias("trimmed"))


by_hand("remove_quotes", [('"a b" c', "a b"), ("'x' y", "x"), ('"open', ""), ("one two", "one"), ("", ""), ("plain", "plain")], lambda: st.remove_quotes(F.col("x")))

BYTES = "list_transform(range(1, octet_length(encode({0})) + 1), lambda i: ('0x' || substr(hex(encode({0})), (2 * i - 1)::INT, 2))::BIGINT)"
HASHED = "list_reduce(list_prepend(1::BIGINT, {0}), lambda h, b: (h * 33 + b) & 4294967295)"
DIGITS = "array_to_string(list_transform(range(0, 6), lambda k: CASE WHEN {0} = 0 OR ({0} >> (6 * k)::INT) > 0 THEN chr(((({0} >> (6 * k)::INT) & 63) + 33)::INT) ELSE ' ' END), '')"


@query(f"SELECT page_id, {DIGITS.format('h')} AS hashed FROM (SELECT page_id, {HASHED.format(BYTES.format('url'))} AS h FROM pages)")
def hash_string(spark, sf):
    return src.table(spark, sf, "pages").select("page_id", st.hash_string(F.col("url")).alias("hashed"))


@query(f"SELECT page_id, CASE WHEN strlen(url) <= 24 THEN url ELSE substr(url, 1, 18) || {DIGITS.format('h')} END AS short, CASE WHEN strlen(url) > 230 THEN substr(url, 1, 230) ELSE url END AS cut FROM (SELECT page_id, url, {HASHED.format(BYTES.format('substr(url, 19)'))} AS h FROM pages)")
def hash_to_length(spark, sf):
    return src.table(spark, sf, "pages").select("page_id", st.hash_to_length(F.col("url"), 24).alias("short"), st.limit_term(F.col("url")).alias("cut"))


by_hand("limit_term", [("x" * 230, "x" * 230), ("x" * 231, "x" * 230), ("é" * 116, "é" * 115), ("x" + "é" * 120, "x" + "é" * 114), ("", "")], lambda: st.limit_term(F.col("x")))

by_hand(
    "prettify_url",
    [
        ("http://h.com/a/b.html", "http://h.com/a/b.html"),
        ("http://www.example.com/a/long/directory/file.html", "http://www.exam...ctory/file.html"),
        ("http://www.example.com/a/name_of_file.htm", "http://www.exam...ame_of_file.htm"),
        ("http://h.com/" + "d" * 20 + "/f.html", "http://h.com/" + "d" * 7 + ".../f.html"),
        ("http://h.com/" + "x" * 60, "http://h.com//x..." + "x" * 16),
    ],
    lambda: u.prettify(F.col("x"), 30),
)

by_hand(
    "resolve_path",
    [("/a/b", "c", "/a/b/c"), ("/a/b", "../c", "/a/c"), ("/a/b", "./c/d", "/a/b/c/d"), ("/a/b", "..", "/a"), ("/a", "../x/", "/x"), ("/a/b", "../../..", "/"), ("", "c", ""), ("a", "..", ".")],
    lambda: u.resolve_path(F.col("x"), F.col("r")),
    "x string, r string",
)

by_hand(
    "result_url",
    [
        ("http://search.example.com/q?x=1", "/hit", "http://search.example.com/hit"),
        ("http://search.example.com/q", "./hit/a", "http://search.example.com/hit/a"),
        ("http://search.example.com/q", "hit.html", "http://search.example.com/hit.html"),
        ("http://search.example.com/q", "http://Other.org/a/", "http://other.org/a"),
        ("http://search.example.com/q", "http://r.example.com/go?u=http%3A//Dest.net/p&amp;k=1", "http://dest.net/p"),
        ("http://search.example.com/q", "http://elsewhere.com/go?u=http://dest.net/p", "http://elsewhere.com/go?u=http://dest.net/p"),
        ("http://search.example.com/q", "", ""),
    ],
    lambda: u.result_url(F.col("q"), F.col("x")),
    "q string, x string",
)

by_hand("url_credentials", [("ftp://u:p@h:21/", "u|p"), ("http://h.com/", "|"), ("http://u@h/", "u|"), ("http://h/a@b", "|")], lambda: F.concat_ws("|", u.credentials(F.col("x"))["user"], u.credentials(F.col("x"))["password"]))
by_hand("host_without_user", [("http://u:p@Host.com/x", "host.com"), ("http://host.com?x=a@b", "host.com"), ("file:///x", "")], lambda: u.host_of(F.col("x")))


@query("SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS mail, strftime(ts, '%A, %d %B %Y %H:%M:%S +0000') AS long_day, strftime(ts, '%Y-%m-%d %a %H:%M:%S +0000') AS short_day, strftime(ts, '%Y%m%d') AS date_key, strftime(ts, '%H%M%S') AS time_key, epoch(date_trunc('second', ts))::BIGINT AS again, epoch(date_trunc('day', ts))::BIGINT AS midnight, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INT AS seconds FROM events")
def time_formats(spark, sf):
    """Times to text and back, over all events."""
    ts = F.col("ts").cast("timestamp")
    e = src.table(spark, sf, "events").select("event_id", ti.to_rfc822(ts).alias("mail"), ti.display(ts, True).alias("long_day"), ti.display(ts).alias("short_day"), ti.to_date_key(ts).alias("date_key"), ti.to_time_key(ts).alias("time_key"))
    return e.select("*", F.unix_timestamp(ti.from_rfc822(F.col("mail"))).alias("again"), F.unix_timestamp(ti.from_date_key(F.col("date_key"))).alias("midnight"), ti.from_time_key(F.col("time_key")).alias("seconds"))


by_hand("mail_dates", [("Mon, 01 Jan 2024 10:00:00 +0100", 1704099600), ("1 Jan 2024 09:00:00 GMT", 1704099600), ("Tue, 02 Jan 2024 00:00:00 UT", 1704153600), ("no date", None), ("", None)], lambda: F.unix_timestamp(ti.from_rfc822(F.col("x"))))
by_hand("time_keys", [("000000", 0), ("235959", 86399), ("240000", None), ("12", None)], lambda: ti.from_time_key(F.col("x")))


@query(r"SELECT doc_id, regexp_matches(substr(hex(encode(text)), 1, 200), '^(?:..)*?[89A-F]') AS is_binary, contains('text/plain', 'x-directory') AS is_directory, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::INT AS segments, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}\p{M}]+'), lambda x: x <> '')[1] AS first_word FROM documents")
def text_shape(spark, sf):
    """Binary or not, and the two other ways of cutting a text, over whole texts."""
    d = src.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", st.is_binary(F.col("text")).alias("is_binary"), st.is_directory(F.lit("text/plain")).alias("is_directory"), F.size(st.segments(F.col("text"))).alias("segments"), F.get(st.words_default(F.col("text")), F.lit(0)).alias("first_word"))


by_hand("directory_types", [("inode/directory", False), ("x-directory/normal", True), ("application/x-directory; charset=binary", True)], lambda: st.is_directory(F.col("x")))


@query(f"WITH {INFO} SELECT doc_id, title AS again, url AS url_again, size::VARCHAR AS size_again FROM doc")
def serialize_round_trip(spark, sf):
    """Documents as key=value text, and read back."""
    d = src.doc_info(spark, sf).select("doc_id", st.serialize({"url": F.col("url"), "title": F.col("title"), "size": F.col("size")}).alias("x"))
    return d.select("doc_id", st.deserialize(F.col("x"), "title").alias("again"), st.deserialize(F.col("x"), "url").alias("url_again"), st.deserialize(F.col("x"), "size").alias("size_again"))


by_hand("record_fields", [("url=u\nipath=\ncaption=a=b\nsize=3", "a=b"), ("caption=x", "x"), ("url=u", ""), ("", "")], lambda: st.record_field(F.col("x"), "caption"))
by_hand(
    "record_of_nulls",
    [("t", "url=\nipath=\nsample=\ncaption=t\ntype=\nsize=3"), (None, "url=\nipath=\nsample=\ncaption=\ntype=\nsize=3"), ("a size=3 b", "url=\nipath=\nsample=\ncaption=a size 3 b\ntype=\nsize=3")],
    lambda: u.record(F.lit(None), F.col("x"), F.lit(None), F.lit(3)),
)

FILES = [
    ("a.txt", "file", "", "text/plain"), ("A.HTML", "file", "", "text/html"), ("b.tar.gz", "file", "", "application/gzip"), ("x.unknown", "file", "", mi.UNKNOWN), ("page", "http", "", "text/html"),
    ("noext", "file", "%PDF-1.4 x", "application/pdf"), ("noext", "file", "<!DOCTYPE html><p>", "text/html"), ("noext", "file", "<?xml version='1.0'?>", "application/xml"), ("noext", "file", "just words", "text/plain"),
    ("noext", "file", "From a@b Mon Jan 1 2024", "application/mbox"), ("own.special", "file", "", "application/x-own"), ("noext", "file", "GIF89a", "image/gif"), ("noext", "file", "!<arch>\n", "application/x-archive"),
]


@query(literal([(k, f[3]) for k, f in enumerate(FILES)], "id", "mime").replace("SELECT *", "SELECT id::BIGINT AS id, mime"))
def mime_types(spark, sf):
    df = frame(spark, [(k, *f[:3]) for k, f in enumerate(FILES)], "id long, file string, protocol string, content string")
    return df.select("id", mi.mime_type(F.col("file"), F.encode("content", "UTF-8"), F.col("protocol"), {".special": "application/x-own"}).alias("mime"))


@query("SELECT page_id, CASE WHEN regexp_matches(regexp_extract(url, '^[^?#]*/([^/?#]*)', 1), '(?i)\\.html?$') THEN 'text/html' WHEN regexp_matches(regexp_extract(url, '^[^?#]*/([^/?#]*)', 1), '(?i)\\.pdf$') THEN 'application/pdf' WHEN starts_with(lower(ltrim(html)), '<!doctype html') OR starts_with(lower(ltrim(html)), '<html') THEN 'text/html' ELSE 'other' END AS mime FROM pages")
def page_mime(spark, sf):
    """Types of all pages, by name and by content."""
    p = src.table(spark, sf, "pages")
    name = F.regexp_extract("url", r"^[^?#]*/([^/?#]*)", 1)
    found = mi.mime_type(name, F.encode("html", "UTF-8"))
    return p.select("page_id", F.when(found.isin("text/html", "application/pdf"), found).otherwise("other").alias("mime"))


by_hand("mime_parents", [("text/x-chdr", "text/x-csrc,text/plain"), ("application/rss+xml", "application/xml,text/plain"), ("text/html", "text/plain"), ("image/png", "")], lambda: F.array_join(mi.parents(F.col("x")), ","))

by_hand("language_codes", [("English", "en"), ("eng", "en"), ("german", "de"), ("Norwegian", "nn"), ("unknown", ""), ("Klingon", "Klingon"), ("", "")], lambda: la.language_code(F.col("x")))
by_hand("language_names", [("en", "English"), ("nn", "Norwegian"), ("xx", "Unknown"), ("", "Unknown")], lambda: la.language_name(F.col("x")))

by_hand("cjkv_grams", [("你好吗", "你 你好 好 好吗 吗"), ("한국", "한 한국 국"), ("カ", "カ"), ("", "")], lambda: F.array_join(tx.cjkv_grams(F.col("x")), " "))
by_hand("cjkv_scripts", [("a 你", "true false"), ("你 好", "true true"), ("abc", "false false"), ("ひらがな", "true true"), ("한a", "true false")], lambda: F.concat_ws(" ", tx.has_cjkv(F.col("x")).cast("string"), tx.has_only_cjkv(F.col("x")).cast("string")))
by_hand("stems_of_words", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("été", "été"), ("be", "be")], lambda: la.stem(F.col("x")))


def _accents():
    from quarry.operators.store import plain_terms

    return plain_terms(F.col("x"))


by_hand("unaccented_words", [("école", "ecole"), ("naïve", "naive"), ("über", "uber"), ("ÅNGSTRÖM", "ANGSTROM"), ("piñata", "pinata"), ("plain", "plain"), ("čšž", "csz")], _accents)
