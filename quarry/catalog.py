"""The registered queries and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import extract as ex
from quarry.functions import language as la
from quarry.functions import text as tx
from quarry.functions import url as u
from quarry.operators import analytics as an
from quarry.operators import history as hi
from quarry.operators.store import StoredIndex, index_of, runs
from quarry.registry import ORACLES, QUERIES, query
from quarry.sources import exports
from quarry.sources import tables as src

TOKENS = r"""list_filter(list_transform(string_split(regexp_replace(lower(replace(text, '.', chr(57344))), '[\p{P}\p{S}\p{Z}\s]+', ' ', 'g'), ' '),
  lambda w: CASE WHEN contains(regexp_replace(replace(w, chr(57344), '.'), '\.+$', ''), '.') THEN replace(w, chr(57344), '.') ELSE regexp_replace(replace(w, chr(57344), '.'), '\.+$', '') END), lambda t: t <> '')"""
TOK = f"tk AS (SELECT doc_id, {TOKENS} AS t FROM documents), occ AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM tk), tf AS (SELECT doc_id, term, count(*) AS wdf FROM occ GROUP BY ALL)"
INFO = """info AS (SELECT doc_id, 'file:///' || source || '/' || lang || '/' || doc_id || '.txt' AS url, split_part(text, chr(10), 1) AS title, 'text/plain' AS type, lang AS language, strlen(text)::BIGINT AS size,
  TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * doc_id AS modtime, '/' || source || '/' || lang AS dir, doc_id || '.txt' AS file, source AS site, text FROM documents),
doc AS (SELECT *, strftime(modtime, '%Y%m%d') AS date_key, strftime(modtime, '%H%M%S') AS time_key, strftime(modtime, '%Y%m%d%H%M%S') AS datetime_key FROM info)"""
CLICKS = "clicks AS (SELECT 'q' || (user_id % 10) AS query_name, 'engine' || (user_id % 3) AS engine_name, 'http://h' || (event_id % 17) || '.example/p' AS url, value AS score, epoch_us(ts) AS date, event_id FROM events WHERE event_type = 'click')"
CRAWL = "crawl AS (SELECT 'file:///u' || user_id || '/' || event_id AS url, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'TO_CRAWL' WHEN 'purchase' THEN 'CRAWLED' WHEN 'view' THEN 'CRAWLING' ELSE 'LINK' END AS status, user_id AS source_id, epoch_us(ts) AS date FROM events)"


def stored(spark, sf) -> StoredIndex:
    """The index of the documents, with their labels."""
    return index_of(spark, sf, lambda: src.labelled_docs(spark, sf))


def docs(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id", "text")


def bm25_sql(terms: list[str], every: bool) -> str:
    names = ", ".join(f"'{t}'" for t in terms)
    return f"""WITH {TOK}, len AS (SELECT doc_id, len(t) AS dl FROM tk), c AS (SELECT count(*) AS n, avg(dl) AS a FROM len),
w AS (SELECT term, count(*) AS df FROM tf WHERE term IN ({names}) GROUP BY term)
SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * wdf * 2.0 / (wdf + (0.5 + 0.5 * dl / a))), 6) AS score
FROM tf JOIN w USING (term) JOIN len USING (doc_id), c GROUP BY doc_id HAVING count(*) >= {len(terms) if every else 1}"""


@query(f"WITH {TOK} SELECT doc_id, term, count(*) AS wdf, min(pos) AS first_pos, max(pos) AS last_pos FROM occ GROUP BY ALL")
def term_postings(spark, sf):
    p = runs(docs(spark, sf), tx.tokens(F.col("text")), ["doc_id"])
    return p.select("doc_id", "term", F.size("positions").cast("long").alias("wdf"), F.element_at("positions", 1).cast("long").alias("first_pos"), F.element_at("positions", -1).cast("long").alias("last_pos"))


@query(f"WITH {TOK} SELECT term, count(*) AS df, sum(wdf)::BIGINT AS cf FROM tf GROUP BY term")
def term_statistics(spark, sf):
    return stored(spark, sf).terms().filter("field = 'body'").select("term", "df", "cf")


@query(f"SELECT * FROM ({bm25_sql(['the', 'with'], True)}) ORDER BY score DESC, doc_id LIMIT 10")
def bm25_and_top10(spark, sf):
    return stored(spark, sf).bm25(["the", "with"]).orderBy(F.desc("score"), "doc_id").limit(10)


@query(bm25_sql(["thing", "verlich", "with"], False))
def or_match(spark, sf):
    return stored(spark, sf).bm25(["thing", "verlich", "with"], every=False)


@query(f"SELECT doc_id, score, round(100 * score / max(score) OVER (), 4) AS percent FROM ({bm25_sql(['the', 'with'], True)})")
def score_percent(spark, sf):
    s = stored(spark, sf).bm25(["the", "with"])
    return s.join(F.broadcast(s.agg(F.max("score").alias("best")))).select("doc_id", "score", F.round(100 * F.col("score") / F.col("best"), 4).alias("percent"))


def matched(text: str, sql: str, default: str = "AND"):
    full = f"WITH tk0 AS (SELECT doc_id, {TOKENS} AS t FROM documents), {INFO} SELECT doc_id FROM doc JOIN tk0 USING (doc_id) WHERE {sql}"
    return full, lambda spark, sf: stored(spark, sf).match(text, default)


PARSED = {
    "not_match": ("the -with", "list_contains(t, 'the') AND NOT list_contains(t, 'with')"),
    "bracket_match": ("(the OR und) AND NOT in", "(list_contains(t, 'the') OR list_contains(t, 'und')) AND NOT list_contains(t, 'in')"),
    "phrase_match": ('"of the"', "contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')"),
    "wildcard_match": ("thin* AND was", "len(list_filter(t, lambda x: starts_with(x, 'thin'))) > 0 AND list_contains(t, 'was')"),
    "near_match": ("with NEAR was", "len(list_filter(range(len(t)), lambda i: t[i + 1] = 'with' AND list_contains(t[greatest(i - 8, 1):i + 10], 'was'))) > 0"),
    "filter_lang_type": ("type:text/plain lang:fr lang:de", "type = 'text/plain' AND language IN ('fr', 'de')"),
    "filter_site": ("site:src3 AND lang:en", "site = 'src3' AND language = 'en'"),
    "filter_dir_recursive": ("dir:/src1", "dir = '/src1' OR starts_with(dir, '/src1/')"),
    "filter_file": ('file:"7.txt"', "file = '7.txt'"),
    "filter_title": ("title:the lang:en", f"list_contains({TOKENS.replace('text', 'title')}, 'the') AND language = 'en'"),
    "filter_path": ("path:src3", "site = 'src3'"),
    "filter_inurl": ("inurl:file:///src1/en", "starts_with(url, 'file:///src1/en')"),
    "filter_tokens": ("tokens:CJKV", f"regexp_matches(text, '{tx.CJKV}')"),
    "filter_class": ("class:text", "starts_with(type, 'text/')"),
    "size_range": ("100..2000b", "size BETWEEN 100 AND 2000"),
    "date_range": ("20240105..20240110", "date_key BETWEEN '20240105' AND '20240110'"),
    "time_range": ("09:00:00..120000", "time_key BETWEEN '090000' AND '120000'"),
    "default_or": ("und with", "list_contains(t, 'und') OR list_contains(t, 'with')", "OR"),
}
for _name, _args in PARSED.items():
    ORACLES[_name], QUERIES[_name] = matched(*_args)


def sorted_query(name: str, order_sql: str, order):
    @query(f"WITH {INFO} SELECT doc_id, size, datetime_key FROM doc WHERE language = 'en' ORDER BY {order_sql} LIMIT 20")
    def run(spark, sf):
        return src.doc_info(spark, sf).filter("language = 'en'").select("doc_id", "size", "datetime_key").orderBy(*order()).limit(20)

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


sorted_query("sort_date_desc", "datetime_key DESC, doc_id", lambda: [F.desc("datetime_key"), "doc_id"])
sorted_query("sort_date_asc", "datetime_key, doc_id", lambda: ["datetime_key", "doc_id"])
sorted_query("sort_size_desc", "size DESC, doc_id", lambda: [F.desc("size"), "doc_id"])


@query(f"WITH s AS ({bm25_sql(['the'], True)}), r AS (SELECT doc_id, score, source, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS r FROM s JOIN documents USING (doc_id)) SELECT source, doc_id, score FROM r WHERE r = 1")
def collapse_by_source(spark, sf):
    s = stored(spark, sf).bm25(["the"]).join(stored(spark, sf).docs().select("doc_id", F.col("site").alias("source")), "doc_id")
    return an.collapse(s, "source").select("source", "doc_id", "score")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25 OFFSET 50")
def list_documents(spark, sf):
    return docs(spark, sf).select("doc_id").orderBy("doc_id").offset(50).limit(25)


@query(f"WITH {TOK} SELECT DISTINCT term FROM occ WHERE starts_with(term, 'tha') ORDER BY term LIMIT 10")
def close_terms(spark, sf):
    return stored(spark, sf).wanted([], ["tha"], kind="terms").select("term").orderBy("term").limit(10)


@query(f"WITH {TOK} SELECT term, levenshtein(regexp_replace(term, '[^ -~]', '?', 'g'), 'thung')::INT AS distance, count(*) AS freq FROM occ WHERE length(term) BETWEEN 3 AND 7 AND levenshtein(regexp_replace(term, '[^ -~]', '?', 'g'), 'thung') <= 2 GROUP BY ALL")
def spelling_candidates(spark, sf):
    t = stored(spark, sf).terms().filter("field = 'body' AND length(term) BETWEEN 3 AND 7")  # two edits from five letters
    return t.withColumn("distance", F.levenshtein("term", F.lit("thung"), 2)).filter("distance >= 0").select("term", "distance", F.col("cf").alias("freq"))


@query(f"""WITH {TOK}, s AS ({bm25_sql(['the', 'with'], True)}), rset AS (SELECT doc_id FROM s ORDER BY score DESC, doc_id LIMIT 5), n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), r AS (SELECT term, count(*) AS r FROM tf SEMI JOIN rset USING (doc_id) GROUP BY term)
SELECT term, r, df, round(r * ln((n + 1.0) / df), 6) AS weight FROM r JOIN df USING (term), n WHERE df > 1 AND length(term) >= 3 AND term NOT IN ('the', 'with') ORDER BY weight DESC, term LIMIT 10""")
def expand_terms(spark, sf):
    """The terms that tell most of the five best results of a query, by whole-collection frequencies."""
    x = stored(spark, sf)
    best = x.bm25(["the", "with"]).orderBy(F.desc("score"), "doc_id").limit(5).select("doc_id")
    r = x.postings().filter("field = 'body'").join(best, "doc_id", "left_semi").groupBy("term").agg(F.count("*").alias("r"))
    df = x.terms().filter("field = 'body' AND df > 1 AND length(term) >= 3 AND term NOT IN ('the', 'with')")
    weight = F.round(F.col("r") * F.log((F.lit(x.size()[0]) + 1.0) / F.col("df")), 6)
    return r.join(df, "term").select("term", "r", "df", weight.alias("weight")).orderBy(F.desc("weight"), "term").limit(10)


@query("SELECT index_id, count(*) AS docs FROM (SELECT 'documents' AS index_id FROM documents UNION ALL SELECT 'pages' FROM pages) GROUP BY index_id")
def merged_index_count(spark, sf):
    both = src.table(spark, sf, "documents").select(F.lit("documents").alias("index_id")).unionByName(src.table(spark, sf, "pages").select(F.lit("pages").alias("index_id")))
    return both.groupBy("index_id").agg(F.count("*").alias("docs"))


@query("SELECT label, count(*) AS docs FROM (SELECT doc_id, unnest(list_filter([CASE WHEN quality = 1 THEN 'Good' END, CASE WHEN toxic = 1 THEN 'Toxic' END], lambda x: x IS NOT NULL)) AS label FROM labels) GROUP BY label")
def labels_doc_count(spark, sf):
    return src.doc_labels(spark, sf).select("doc_id", F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("docs"))


@query("SELECT doc_id, array_to_string(list_sort(list_filter(['Seen', CASE WHEN quality = 1 THEN 'Good' END], lambda x: x IS NOT NULL)), ',') AS labels FROM labels")
def set_labels(spark, sf):
    return an.set_labels(src.doc_labels(spark, sf), ["Seen"], ["Toxic", "X-SOURCE1"]).select("doc_id", F.array_join("labels", ",").alias("labels"))


@query(f"WITH {CRAWL} SELECT status, count(*) AS items FROM crawl GROUP BY status")
def crawl_status_counts(spark, sf):
    return src.crawl_history(spark, sf).groupBy("status").agg(F.count("*").alias("items"))


@query(f"WITH {CRAWL} SELECT url, source_id, date FROM crawl WHERE status = 'CRAWLED' AND source_id = 5 AND date > 1704500000000000 ORDER BY date, url LIMIT 20 OFFSET 2")
def crawl_items_page(spark, sf):
    c = src.crawl_history(spark, sf).filter("status = 'CRAWLED' AND source_id = 5 AND date > 1704500000000000")
    return c.select("url", "source_id", "date").orderBy("date", "url").offset(2).limit(20)


@query(f"WITH {CRAWL} SELECT source_id, count(*) AS items, sum((status IN ('CRAWLED', 'CRAWLING', 'TO_CRAWL'))::INT)::BIGINT AS crawled FROM crawl GROUP BY source_id")
def crawl_statistics(spark, sf):
    return src.crawl_history(spark, sf).groupBy("source_id").agg(F.count("*").alias("items"), F.sum(F.col("status").isin("CRAWLED", "CRAWLING", "TO_CRAWL").cast("long")).alias("crawled"))


@query(f"WITH {CRAWL} SELECT url, date FROM crawl WHERE status = 'TO_CRAWL' ORDER BY date DESC, url LIMIT 5")
def queue_pop(spark, sf):
    return an.queue_pop(src.crawl_history(spark, sf).filter("status = 'TO_CRAWL'").select("url", "date"), 5)


@query(f"WITH {CRAWL}, s AS (SELECT DISTINCT source_id FROM crawl WHERE status = 'ERROR') SELECT url FROM crawl WHERE status = 'CRAWLED' AND source_id NOT IN (SELECT source_id FROM s)")
def crawl_leftovers_anti(spark, sf):
    c = src.crawl_history(spark, sf)
    return an.leftovers(c.filter("status = 'CRAWLED'"), c.filter("status = 'ERROR'"), "source_id").select("url")


@query(f"WITH {CLICKS}, r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS previous FROM clicks WINDOW w AS (PARTITION BY query_name, engine_name, url ORDER BY date DESC, event_id DESC)) SELECT query_name, engine_name, url, score, coalesce(score - previous, 666.0) AS diff FROM r WHERE rn = 1")
def query_rank_diff(spark, sf):
    return an.rank_diff(src.query_history(spark, sf))


@query(f"WITH {CLICKS} SELECT query_name, engine_name, max(date) AS last_run, count(DISTINCT date) AS runs FROM clicks GROUP BY ALL")
def query_latest_runs(spark, sf):
    return an.latest_runs(src.query_history(spark, sf))


@query(f"WITH {CLICKS} SELECT query_name, engine_name, date, event_id FROM (SELECT *, dense_rank() OVER (PARTITION BY query_name, engine_name ORDER BY date DESC) AS r FROM clicks) WHERE r <= 2")
def last_two_runs(spark, sf):
    return an.last_two_runs(src.query_history(spark, sf)).select("query_name", "engine_name", "date", "event_id")


@query("SELECT user_id, count(*) AS views, count(DISTINCT event_id) AS urls FROM events WHERE event_type = 'view' GROUP BY user_id")
def view_counts(spark, sf):
    return src.table(spark, sf, "events").filter("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("views"), F.countDistinct("event_id").alias("urls"))


@query(f"WITH {CLICKS} SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, count(*) AS results, floor(avg(score))::BIGINT AS group_score FROM clicks GROUP BY host")
def group_by_host_avg(spark, sf):
    return an.group_by_host(src.query_history(spark, sf))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^(\w+)://', 1)) AS protocol, split_part(split_part(regexp_replace(url, '^\w+://', ''), '?', 1), '/', 1) AS host,
  regexp_replace(p, '/?[^/]*$', '') AS location, regexp_extract(p, '([^/]*)$', 1) AS file, CASE WHEN contains(url, '?') THEN substr(url, instr(url, '?') + 1) ELSE '' END AS parameters
FROM (SELECT *, CASE WHEN contains(b, '/') THEN regexp_replace(b, '^[^/]*/', '') ELSE '' END AS p FROM (SELECT *, split_part(regexp_replace(url, '^\w+://', ''), '?', 1) AS b FROM pages))""")
def url_parse(spark, sf):
    return src.table(spark, sf, "pages").select("page_id", u.parts(F.col("url")).alias("p")).select("page_id", "p.*")


@query(r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(\w+://[^/?]*)', 1)) || regexp_replace(url, '^\w+://[^/?]*', ''), '^(\w+://[^/]+/.+)/$', '\1') AS url FROM pages")
def url_canonical(spark, sf):
    return src.table(spark, sf, "pages").select("page_id", u.canonical(F.col("url")).alias("url"))


@query(r"SELECT page_id, array_to_string(h[greatest(len(h) - 1, 1):len(h)], '.') AS site FROM (SELECT page_id, string_split(lower(regexp_extract(url, '^\w+://([^/?#]*)', 1)), '.') AS h FROM pages)")
def host_reduce(spark, sf):
    return src.table(spark, sf, "pages").select("page_id", u.reduce_host(u.host_of(F.col("url")), 2).alias("site"))


ESCAPED = "url_encode(text)"
for _c in u.SAFE:
    ESCAPED = f"replace({ESCAPED}, '%{ord(_c):02X}', '{_c * 2 if _c == chr(39) else _c}')"


@query(f"SELECT item_id, {ESCAPED} AS escaped FROM benchmark")
def url_escape(spark, sf):
    return src.table(spark, sf, "benchmark").select("item_id", u.escape(F.col("text")).alias("escaped"))


@query(f"WITH {INFO} SELECT split_part(type, '/', 1) AS class, 'txt' AS ext, count(*) AS docs, sum(size)::BIGINT AS bytes FROM doc GROUP BY ALL")
def mime_class(spark, sf):
    d = src.doc_info(spark, sf)
    return d.groupBy(u.mime_class(F.col("type")).alias("class"), u.extension(F.col("file")).alias("ext")).agg(F.count("*").alias("docs"), F.sum("size").alias("bytes"))


@query(f"WITH {INFO} SELECT doc_id, 'url=' || url || chr(10) || 'ipath=' || chr(10) || 'sample=' || chr(10) || 'caption=' || CASE WHEN regexp_matches(title, '(?i)(url|ipath|sample|caption|type|modtime|language|size)=') THEN replace(title, '=', ' ') ELSE title END || chr(10) || 'type=' || type || chr(10) || 'size=' || size AS record FROM doc")
def record_encode(spark, sf):
    return src.doc_info(spark, sf).select("doc_id", u.record(F.col("url"), F.col("title"), F.col("type"), F.col("size")).alias("record"))


@query("SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') AS text FROM pages")
def strip_markup(spark, sf):
    return src.table(spark, sf, "pages").select("page_id", u.strip_markup(F.col("html")).alias("text"))


@query(f"SELECT doc_id, regexp_matches(text, '{tx.CJKV}') AS cjkv, strlen(translate(lower(text), '{tx.ACCENTED}', '{tx.PLAIN}'))::INT AS plain_bytes FROM documents")
def cjkv_flag(spark, sf):
    return docs(spark, sf).select("doc_id", tx.has_cjkv(F.col("text")).alias("cjkv"), F.octet_length(tx.strip_accents(F.lower("text"))).alias("plain_bytes"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS leaves FROM events")
def json_leaves(spark, sf):
    return src.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("leaves"))


@query("""WITH e AS (SELECT event_id // 2 AS cookie, ts, CASE WHEN event_id % 2 = 0 THEN 'F' ELSE 'T' END AS half, user_id FROM events),
a AS (SELECT * FROM e WHERE half = 'F'), b AS (SELECT * FROM e WHERE half = 'T'),
j AS (SELECT a.user_id AS ua, b.user_id AS ub, a.ts AS ta, b.ts AS tb FROM a FULL JOIN b USING (cookie))
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN ub IS NULL THEN 'DELETED' WHEN ua IS NULL THEN 'CREATED' WHEN tb <= ta + INTERVAL 60 SECOND THEN 'MOVED' ELSE 'CREATED' END AS kind FROM j
UNION ALL SELECT 'DELETED' FROM j WHERE tb > ta + INTERVAL 60 SECOND) GROUP BY kind""")
def move_pairing(spark, sf):
    from quarry.streaming.moves import pair_moves

    e = src.table(spark, sf, "events").select("ts", F.when(F.col("event_id") % 2 == 0, "MOVED_FROM").otherwise("MOVED_TO").alias("kind"), F.concat(F.lit("/u"), F.col("user_id").cast("string")).alias("location"), F.expr("event_id div 2").alias("cookie"))
    return pair_moves(e).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {CLICKS}, v AS (SELECT DISTINCT 'http://h' || (event_id % 17) || '.example/p' AS url FROM events WHERE event_type = 'view') SELECT event_id, v.url IS NOT NULL AS viewed FROM clicks LEFT JOIN v USING (url)")
def viewed_flags(spark, sf):
    v = src.table(spark, sf, "events").filter("event_type = 'view'").select(F.concat(F.lit("http://h"), (F.col("event_id") % 17).cast("string"), F.lit(".example/p")).alias("url")).distinct().withColumn("seen", F.lit(True))
    return src.query_history(spark, sf).join(v, "url", "left").select("event_id", F.col("seen").isNotNull().alias("viewed"))


@query()
def html_extract(spark, sf):
    """Title, text and links of raw pages; no SQL says this."""
    from quarry.sources.filters import apply_filters

    p = src.table(spark, sf, "pages").select("url", F.lit("text/html").alias("type"), F.encode("html", "UTF-8").alias("content"))
    return apply_filters(p).select("url", "title", "type", F.length("text").alias("chars"), F.size("links").alias("links"))


@query(f"WITH {TOK}, p AS (SELECT doc_id, pos, min(term) AS term FROM occ GROUP BY ALL) SELECT doc_id, md5(string_agg(term, ' ' ORDER BY pos)) AS text_md5 FROM p GROUP BY doc_id")
def text_reconstruction(spark, sf):
    o = stored(spark, sf).postings().filter("field = 'body'").select("doc_id", F.explode("positions").alias("pos"), "term")
    o = o.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("t"))
    return o.select("doc_id", F.md5(F.array_join(F.transform("t", lambda x: x["term"]), " ").cast("binary")).alias("text_md5"))


@query("SELECT conv_id, count(*) AS messages, sum(length(text))::BIGINT AS chars, max(CASE WHEN turn = 0 THEN role END) AS first_role FROM conversations GROUP BY conv_id")
def mailbox_threads(spark, sf):
    c = src.table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"), F.max(F.when(F.col("turn") == 0, F.col("role"))).alias("first_role"))


@query(f"WITH {INFO}, x AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY datetime_key DESC, doc_id) AS r FROM doc) SELECT site, doc_id, 101 - r AS pseudo_score FROM x WHERE r <= 5")
def web_pseudo_scores(spark, sf):
    d = src.doc_info(spark, sf).select("site", "doc_id", "datetime_key")
    r = d.withColumn("r", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("datetime_key"), "doc_id")))
    return r.filter("r <= 5").select("site", "doc_id", (F.lit(101).cast("long") - F.col("r")).alias("pseudo_score"))


SCORES = ", ".join(f"{{'n': -len(list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in ws)}))), 'c': '{c}'}}" for c, ws in la.WORDS.items())


@query(f"WITH t AS (SELECT doc_id, {TOKENS} AS t FROM (SELECT doc_id, left(text, 1000) AS text FROM documents)), b AS (SELECT doc_id, list_transform(list_filter(list_sort([{SCORES}]), lambda x: x.n < 0), lambda x: x.c) AS c FROM t) SELECT doc_id, coalesce(c[1], 'unknown') AS language, greatest(len(c), 1)::INT AS candidates FROM b")
def language_detect(spark, sf):
    c = docs(spark, sf).select("doc_id", la.languages(F.col("text")).alias("c"))
    return c.select("doc_id", F.element_at("c", 1).alias("language"), F.size("c").alias("candidates"))


@query()
def term_stems(spark, sf):
    """Every distinct term with its stem; the stemmer is held against known stems in the tests."""
    return la.stems(stored(spark, sf).terms().filter("field = 'body'"))


HIT = r"(with|was)([^\p{L}\p{N}<>]|$)"
SNIP = rf"snip AS (SELECT doc_id, substr(text, greatest(length(regexp_extract(text, '(?is)^(.*?)(?:^|[^\p{{L}}\p{{N}}<>])(?:with|was)(?:[^\p{{L}}\p{{N}}<>]|$)', 1)) - 60, 0) + 1, 300) AS extract FROM documents)"


@query(f"WITH {SNIP} SELECT * FROM snip")
def snippet_window(spark, sf):
    return docs(spark, sf).select("doc_id", ex.snippet(F.col("text"), ["with", "was"]).alias("extract"))


@query(rf"WITH {SNIP} SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(extract, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)(^|[^\p{{L}}\p{{N}}<>]){HIT}', '\1<b>\2</b>\3', 'g'), '(?i)(^|[^\p{{L}}\p{{N}}<>]){HIT}', '\1<b>\2</b>\3', 'g') AS marked FROM snip")
def highlight_terms(spark, sf):
    return snippet_window(spark, sf).select("doc_id", ex.highlight(F.col("extract"), ["with", "was"]).alias("marked"))


@query(f"WITH {CLICKS} SELECT DISTINCT url FROM clicks WHERE starts_with(url, 'http://h1') ORDER BY url LIMIT 10")
def autocomplete_urls(spark, sf):
    return hi.autocomplete(src.query_history(spark, sf), "http://h1")


@query(f"WITH {CLICKS} SELECT url, score, date FROM clicks WHERE query_name = 'q3' AND engine_name = 'engine1' ORDER BY date DESC, score DESC, event_id LIMIT 15")
def history_results(spark, sf):
    return hi.history_results(src.query_history(spark, sf), "q3", "engine1", 15).select("url", "score", "date")


@query(f"WITH {CLICKS} SELECT DISTINCT query_name, engine_name FROM clicks")
def engines_used(spark, sf):
    return src.query_history(spark, sf).select("query_name", "engine_name").distinct()


@query(f"WITH {CLICKS} SELECT query_name, engine_name, url, event_id AS extract FROM (SELECT *, row_number() OVER (PARTITION BY query_name, engine_name, url ORDER BY date DESC, event_id DESC) AS r FROM clicks) WHERE r = 1")
def latest_extracts(spark, sf):
    return hi.latest_extract(src.query_history(spark, sf).withColumn("extract", F.col("event_id")))


@query(f"WITH {CRAWL} SELECT url, CASE status WHEN 'CRAWLED' THEN 'TO_CRAWL' ELSE status END AS status, source_id FROM crawl WHERE status NOT IN ('ERROR', 'LINK', 'CRAWLING')")
def crawl_start(spark, sf):
    return hi.start_crawl(src.crawl_history(spark, sf)).select("url", "status", "source_id")


@query(f"WITH {CRAWL} SELECT url, CASE WHEN status = 'ERROR' AND source_id = 7 THEN 'TO_CRAWL' ELSE status END AS status FROM crawl")
def crawl_bulk_status(spark, sf):
    return hi.set_status(src.crawl_history(spark, sf), "ERROR", "TO_CRAWL", 7).select("url", "status")


@query(f"WITH {CRAWL} SELECT url FROM crawl WHERE NOT (starts_with(url, 'file:///u1') AND date < 1705500000000000 AND status = 'LINK')")
def crawl_expire(spark, sf):
    return hi.delete_items(src.crawl_history(spark, sf), "file:///u1", 1705500000000000, F.col("status") == "LINK").select("url")


@query("SELECT n_nationkey::BIGINT AS source_id, n_name AS url FROM nation UNION ALL SELECT max(n_nationkey)::BIGINT + 1, 'file:///new' FROM nation")
def source_insert(spark, sf):
    s = src.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("source_id"), F.col("n_name").alias("url"))
    return hi.add_source(s, "file:///new")


def metadata(spark, sf):
    x = src.table(spark, sf, "labels").withColumn("url", F.concat(F.lit("file:///"), F.col("doc_id").cast("string")))
    return x.select("url", F.explode(F.create_map(F.lit("label.quality"), F.col("quality").cast("string"), F.lit("label.toxic"), F.col("toxic").cast("string"))).alias("name", "value"))


@query("SELECT 'file:///' || doc_id AS url, max(quality)::VARCHAR AS quality, max(toxic)::VARCHAR AS toxic FROM labels GROUP BY doc_id")
def metadata_attributes(spark, sf):
    a = hi.attributes(metadata(spark, sf), "label.")
    return a.select("url", F.col("attributes")["quality"].alias("quality"), F.col("attributes")["toxic"].alias("toxic"))


@query("SELECT DISTINCT 'file:///' || doc_id AS url FROM labels WHERE starts_with('file:///' || doc_id, 'file:///1') ORDER BY url LIMIT 20 OFFSET 5")
def metadata_page(spark, sf):
    return metadata(spark, sf).filter(F.col("url").startswith("file:///1")).select("url").distinct().orderBy("url").offset(5).limit(20)


@query("SELECT event_id, 'INDEX' AS action FROM events WHERE event_type = 'click' AND NOT (user_id::VARCHAR LIKE '1%') UNION ALL SELECT event_id, 'UNINDEX' FROM events WHERE event_type = 'error' AND NOT (user_id::VARCHAR LIKE '1%')")
def event_routing(spark, sf):
    kind = F.when(F.col("event_type") == "click", "WRITE_CLOSED").when(F.col("event_type") == "error", "DELETED").otherwise("EXISTS")
    e = src.table(spark, sf, "events").select("event_id", kind.alias("kind"), F.concat(F.lit("/u"), F.col("user_id").cast("string"), F.lit("/f")).alias("location"))
    return hi.route_events(e, ["/u1*"]).select("event_id", "action")


@query(f"WITH {TOK}, {INFO} SELECT count(*) AS documents, sum(size)::BIGINT AS bytes, sum(len(t))::BIGINT AS terms FROM doc JOIN tk USING (doc_id)")
def index_statistics(spark, sf):
    x = stored(spark, sf)
    terms = x.terms().filter("field = 'body'").agg(F.sum("cf").alias("terms"))
    return x.docs().agg(F.count("*").alias("documents"), F.sum("size").alias("bytes")).join(F.broadcast(terms))


@query(f"""WITH {INFO} SELECT 'all' AS query, coalesce(site, '') AS engine,
  replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(title, ''), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') AS caption,
  coalesce(url, '') AS url, type, coalesce(language, '') AS language, coalesce(datetime_key, '') AS modtime, coalesce(size::VARCHAR, '') AS size, '' AS abstract FROM doc""")
def export_list(spark, sf):
    d = src.doc_info(spark, sf)
    return exports.export_rows(d.select(F.lit("all").alias("query"), F.col("site").alias("engine"), F.col("title").alias("caption"), "url", "type", "language", F.col("datetime_key").alias("modtime"), "size", F.lit(None).alias("abstract")))


from quarry import catalog_functions, catalog_index  # noqa: E402, F401
