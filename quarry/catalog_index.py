"""Queries over the stored index, result lists, and what maintains documents and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import CLICKS, CRAWL, INFO, TOK, TOKENS, bm25_sql, docs, stored
from quarry.catalog_functions import frame, literal
from quarry.functions import text as tx
from quarry.functions import url as u
from quarry.operators import history as hi
from quarry.operators import maintenance as ma
from quarry.operators import results as re_
from quarry.operators.store import index_of
from quarry.registry import query
from quarry.sources import tables as src

LABELS = "lab AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS bad FROM labels GROUP BY doc_id)"


def found(name: str, text: str, sql: str, default: str = "AND", **how):
    """Registers a search; sql is its condition over doc, with t the document's terms and v their variants."""
    variants = "list_distinct(flatten(list_transform(t, lambda x: [x, strip_accents(x)] || CASE WHEN contains(x, '.') THEN string_split(x, '.') ELSE [] END)))"
    full = f"WITH tk0 AS (SELECT *, {variants} AS v FROM (SELECT doc_id, {TOKENS} AS t FROM documents)), {INFO}, {LABELS} SELECT doc_id FROM doc JOIN tk0 USING (doc_id) LEFT JOIN lab USING (doc_id) WHERE {sql}"
    query(full, name)(lambda spark, sf: stored(spark, sf).match(text, default, **how))


found("filter_label", "label:Toxic lang:en", "bad AND language = 'en'")
found("filter_label_not", "label:Good -label:Toxic", "good AND NOT coalesce(bad, false)")
found("filter_ext", "ext:txt site:src1", "site = 'src1'")
found("filter_url", "url:" + " url:".join(f'"file:///src{k}/{c}/12.txt"' for k in range(40) for c in ("en", "de", "fr", "es")), "doc_id = 12")
found("adj_match", "the ADJ of", "len(list_filter(range(len(t)), lambda i: t[i + 1] = 'the' AND list_contains(t[i + 2:i + 10], 'of'))) > 0")
found("love_match", "with +was thing", "list_contains(t, 'was')", "OR")
found("hate_match", "+the -with -was", "list_contains(t, 'the') AND NOT list_contains(t, 'with') AND NOT list_contains(t, 'was')", "OR")
found("open_date_range", "20240110..", "date_key >= '20240110'")
found("open_size_range", "..500b", "size <= 500")
found("open_time_range", "the ..09:30:00", "list_contains(t, 'the') AND time_key <= '093000'")
found("nested_brackets", "((the OR und) -(with was)) lang:en", "(list_contains(t, 'the') OR list_contains(t, 'und')) AND NOT (list_contains(t, 'with') AND list_contains(t, 'was')) AND language = 'en'")
found("broken_word", "of-the", "contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')")
found("unaccented_match", "est", "list_contains(v, 'est')", variants=True)
found("dotted_part_match", "example", "list_contains(v, 'example')", variants=True)
found("short_prefix", "w*", "len(list_filter(t, lambda x: starts_with(x, 'w'))) > 0")
found("pure_not", "NOT the", "NOT list_contains(t, 'the')")


@query(f"WITH {TOK}, h AS (SELECT DISTINCT doc_id FROM tf WHERE term = 'with') SELECT count(*) AS estimated FROM h")
def estimated_total(spark, sf):
    return stored(spark, sf).match("with").agg(F.count("*").alias("estimated"))


@query(f"WITH {TOK}, h AS (SELECT DISTINCT doc_id FROM tf WHERE term = 'with') SELECT doc_id FROM h SEMI JOIN labels USING (doc_id)")
def limited_to_set(spark, sf):
    """A search within a set of documents."""
    return stored(spark, sf).match("with").join(src.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


@query(f"WITH {INFO}, {LABELS} SELECT doc_id, url, title, CASE WHEN type = '' THEN 'text/html' ELSE type END AS type FROM doc JOIN lab USING (doc_id) WHERE good ORDER BY doc_id LIMIT 15 OFFSET 3")
def list_by_label(spark, sf):
    d = stored(spark, sf).docs().filter(F.array_contains("labels", "Good"))
    kind = F.when(F.col("type") == "", "text/html").otherwise(F.col("type"))
    return d.select("doc_id", "url", "title", kind.alias("type")).orderBy("doc_id").offset(3).limit(15)


@query(f"WITH {INFO} SELECT doc_id, url FROM doc WHERE dir = '/src1/en' ORDER BY doc_id LIMIT 20")
def list_by_directory(spark, sf):
    return stored(spark, sf).docs().filter("dir = '/src1/en'").select("doc_id", "url").orderBy("doc_id").limit(20)


@query(f"WITH {INFO} SELECT max(doc_id) AS last_id, count(*) AS documents FROM doc")
def last_document(spark, sf):
    return stored(spark, sf).docs().agg(F.max("doc_id").alias("last_id"), F.count("*").alias("documents"))


@query(f"WITH {TOK}, {INFO}, s AS (SELECT doc_id, term, wdf FROM tf JOIN doc USING (doc_id) WHERE site <> 'src1') SELECT term, count(*) AS df, sum(wdf)::BIGINT AS cf FROM s GROUP BY term")
def unindexed_statistics(spark, sf):
    """Terms after a directory's documents have left the index."""
    x = stored(spark, sf).unindex(ma.under(F.col("url"), "file:///src1"))
    return x.terms().filter("field = 'body'").select("term", "df", "cf")


@query(bm25_sql(["the", "renewed"], False).replace("FROM documents)", "FROM (SELECT doc_id, CASE WHEN source = 'src2' THEN 'renewed ' || text ELSE text END AS text FROM documents))"))
def updated_scores(spark, sf):
    """Scores after the documents of a source were indexed anew with other texts."""
    new = src.labelled_docs(spark, sf).filter("site = 'src2'").withColumn("text", F.concat(F.lit("renewed "), F.col("text")))
    return stored(spark, sf).add(new).bm25(["the", "renewed"], every=False)


@query(f"WITH {TOK}, {INFO} SELECT site, type, count(*) AS documents, sum(dl)::BIGINT AS terms FROM (SELECT CASE WHEN site = 'src1' THEN 'moved' ELSE site END AS site, CASE WHEN language = 'en' THEN 'text/x-english' ELSE type END AS type, len(t) AS dl FROM doc JOIN tk USING (doc_id)) GROUP BY ALL")
def updated_properties(spark, sf):
    """Other values in columns of some documents, the terms untouched."""
    x = stored(spark, sf).update_properties(F.col("site") == "src1", site=F.lit("moved")).update_properties(F.col("language") == "en", type=F.lit("text/x-english"))
    dl = x.postings().filter("field = 'body'").groupBy("doc_id").agg(F.sum("wdf").alias("dl"))
    return x.docs().join(dl, "doc_id", "left").groupBy("site", "type").agg(F.count("*").alias("documents"), F.coalesce(F.sum("dl"), F.lit(0)).alias("terms"))


PAGE_TEXT = "(SELECT page_id AS doc_id, replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') AS text FROM pages)"


def page_docs(spark, sf):
    p = src.table(spark, sf, "pages")
    return p.select(F.col("page_id").alias("doc_id"), "url", F.lit("").alias("title"), F.lit("text/html").alias("type"), F.lit("").alias("language"), u.strip_markup(F.col("html")).alias("text"))


@query(f"WITH a AS (SELECT doc_id * 2 - 1 AS doc_id, {TOKENS} AS t FROM documents), b AS (SELECT doc_id * 2 AS doc_id, {TOKENS} AS t FROM {PAGE_TEXT}), o AS (SELECT doc_id, unnest(t) AS term FROM (FROM a UNION ALL FROM b)) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM o GROUP BY term")
def merged_terms(spark, sf):
    """The terms of one index made of two, of documents and of pages."""
    from quarry.sources.shared import shared_dir

    import uuid

    pages = index_of(spark, f"{sf}#pages", lambda: page_docs(spark, sf))
    both = stored(spark, sf).merged(pages, f"{shared_dir(spark)}/merged-{uuid.uuid4().hex}")
    return both.terms().filter("field = 'body'").select("term", "df", "cf")


@query(f"WITH {INFO} SELECT doc_id, CASE WHEN site = 'src1' THEN replace(url, 'file:///src1/', 'file:///else/src1/') ELSE url END AS url, title FROM doc")
def moved_documents(spark, sf):
    return ma.moved(src.doc_info(spark, sf), "file:///src1", "file:///else/src1/").select("doc_id", "url", "title")


@query(literal([(1, "file:///b/x.txt", "x.txt"), (2, "file:///b/d/y", "own"), (3, "file:///ab/z", "z"), (4, "file:///b", "b")], "id", "url", "title").replace("SELECT *", "SELECT id::BIGINT AS id, url, title"))
def moved_titles(spark, sf):
    """A title that was the file's name moves with it."""
    d = frame(spark, [(1, "file:///a/x.txt", "x.txt"), (2, "file:///a/d/y", "own"), (3, "file:///ab/z", "z"), (4, "file:///a", "a")], "id long, url string, title string")
    return ma.moved(d, "file:///a", "file:///b")


@query(f"WITH {CRAWL} SELECT url, status FROM crawl WHERE NOT starts_with(url, 'file:///u7/')")
def deleted_directory(spark, sf):
    return ma.deleted(src.crawl_history(spark, sf), "file:///u7").select("url", "status")


@query(f"WITH {CRAWL} SELECT url, source_id FROM crawl WHERE source_id IN (SELECT n_nationkey FROM nation)")
def configured_sources_only(spark, sf):
    sources = src.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("source_id"))
    return ma.drop_sources(src.crawl_history(spark, sf), sources).select("url", "source_id")


@query(f"WITH {CRAWL}, h AS (SELECT url, max(date - CASE status WHEN 'CRAWLED' THEN 1 ELSE 0 END) AS date FROM crawl WHERE status <> 'TO_CRAWL' GROUP BY url) SELECT c.url FROM crawl c LEFT JOIN h USING (url) WHERE h.date IS NULL OR h.date < c.date")
def incremental_crawl(spark, sf):
    """Files that are new, or newer than history says."""
    c = src.crawl_history(spark, sf)
    old = c.filter("status != 'TO_CRAWL'").select("url", (F.col("date") - F.when(F.col("status") == "CRAWLED", 1).otherwise(0)).alias("date"))
    return ma.changed(c, old).select("url")


@query(f"WITH {CRAWL}, mine AS (SELECT url FROM crawl WHERE source_id = 5 AND status NOT IN ('ERROR', 'LINK', 'CRAWLING')), seen AS (SELECT url FROM crawl WHERE source_id = 5 AND status IN ('CRAWLED', 'ERROR')) SELECT 'gone' AS what, count(*) AS items FROM mine ANTI JOIN seen USING (url) UNION ALL SELECT 'crawled', count(*) FROM seen UNION ALL SELECT 'others', count(*) FROM crawl WHERE source_id <> 5")
def crawl_of_a_source(spark, sf):
    """History after one crawl, and what it no longer found."""
    c = src.crawl_history(spark, sf)
    now, gone = ma.crawl_history(c, c.filter("source_id = 5 AND status IN ('CRAWLED', 'ERROR')"), 5)
    kind = F.when(F.col("source_id") == 5, "crawled").otherwise("others")
    return now.groupBy(kind.alias("what")).agg(F.count("*").alias("items")).unionByName(gone.agg(F.count("*").alias("items")).select(F.lit("gone").alias("what"), "items"))


@query("WITH a AS (SELECT 'q' || (user_id % 3) AS queue_id, 'file:///' || user_id AS url, event_type AS type, epoch_us(ts) AS date FROM events) SELECT queue_id, url, type, date FROM (SELECT *, row_number() OVER (PARTITION BY queue_id, url ORDER BY date DESC, type DESC) AS r FROM a) WHERE r = 1")
def queue_push(spark, sf):
    """A queue after all events are pushed: the last of a queue and URL stays."""
    e = src.table(spark, sf, "events").select(F.concat(F.lit("q"), (F.col("user_id") % 3).cast("string")).alias("queue_id"), F.concat(F.lit("file:///"), F.col("user_id").cast("string")).alias("url"), F.col("event_type").alias("type"), F.unix_micros(F.col("ts").cast("timestamp")).alias("date"))
    return ma.queued(e.filter("type = 'view'"), e.filter("type != 'view'"))


@query("WITH a AS (SELECT 'file:///' || user_id AS url, min(epoch_us(ts)) AS date FROM events WHERE event_type <> 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-05') GROUP BY user_id) SELECT url, date, row_number() OVER (ORDER BY date, url) <= 7 AS now FROM a")
def queue_admission(spark, sf):
    """What starts at once when seven slots are free, and what waits; what is in progress is left out."""
    e = src.table(spark, sf, "events").select("event_type", F.concat(F.lit("file:///"), F.col("user_id").cast("string")).alias("url"), F.unix_micros(F.col("ts").cast("timestamp")).alias("date"))
    return ma.admitted(e.filter("event_type != 'error'"), e.filter("event_type = 'signup' AND date < 1704412800000000"), 7)


@query("SELECT type, count(*) AS items FROM (SELECT event_type AS type FROM events WHERE event_type <> 'view' OR ts >= TIMESTAMP '2024-01-10') GROUP BY type")
def queue_counts_after_expiry(spark, sf):
    e = src.table(spark, sf, "events").select(F.col("event_type").alias("type"), F.col("ts").cast("timestamp").alias("ts"), F.lit("").alias("url"), F.unix_micros(F.col("ts").cast("timestamp")).alias("date"))
    kept = hi.delete_items(e, before=1704844800000000, where=F.col("type") == "view")
    return kept.groupBy("type").agg(F.count("*").alias("items"))


@query(f"WITH {CLICKS} SELECT query_name, engine_name, split_part(split_part(url, '://', 2), '/', 1) AS host, score, date, event_id FROM clicks WHERE date >= 1704500000000000")
def history_with_host(spark, sf):
    """Query history with each result's host, without what is older than a date."""
    h = hi.delete_items(src.query_history(spark, sf), before=1704500000000000)
    return h.select("query_name", "engine_name", u.host_of(F.col("url")).alias("host"), "score", "date", "event_id")


@query("SELECT user_id, count(*) AS views FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-08' AND user_id <> 5 GROUP BY user_id")
def views_after_expiry(spark, sf):
    v = src.table(spark, sf, "events").filter("event_type = 'view'").select("user_id", F.concat(F.lit("file:///"), F.col("user_id").cast("string")).alias("url"), F.unix_micros(F.col("ts").cast("timestamp")).alias("date"))
    kept = ma.deleted(hi.delete_items(v, before=1704672000000000), "file:///5")
    return kept.groupBy("user_id").agg(F.count("*").alias("views"))


@query("SELECT 'file:///' || doc_id AS url, 'label.' || k AS name, CASE WHEN k = 'quality' THEN '9' ELSE v END AS value FROM (SELECT doc_id, 'quality' AS k, max(quality)::VARCHAR AS v FROM labels GROUP BY doc_id UNION ALL SELECT doc_id, 'toxic', max(toxic)::VARCHAR FROM labels GROUP BY doc_id) WHERE NOT (k = 'toxic' AND v = '0')")
def metadata_set_and_delete(spark, sf):
    """One attribute set for every document, another deleted where it says nothing."""
    x = src.table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    rows = x.select(F.concat(F.lit("file:///"), F.col("doc_id").cast("string")).alias("url"), F.explode(F.create_map(F.lit("label.quality"), F.col("q").cast("string"), F.lit("label.toxic"), F.col("t").cast("string"))).alias("name", "value"))
    new = rows.select("url").distinct().select("url", F.lit("label.quality").alias("name"), F.lit("9").alias("value"))
    return hi.set_attributes(rows, new).filter(~((F.col("name") == "label.toxic") & (F.col("value") == "0")))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(['Kept', CASE WHEN quality = 1 THEN 'Good' END], lambda x: x IS NOT NULL))), ',') AS labels, CASE WHEN toxic = 1 THEN 'flagged' ELSE 'title' END AS title FROM (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)")
def restored_metadata(spark, sf):
    """Labels and titles that were kept for documents come back."""
    x = src.table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    url = F.concat(F.lit("file:///"), F.col("doc_id").cast("string"))
    d = x.select("doc_id", url.alias("url"), F.array(F.lit("Kept")).alias("labels"), F.lit("title").alias("title"), F.lit("text/plain").alias("type"))
    a = x.filter("q = 1").select(url.alias("url"), F.lit("label.Good").alias("name"), F.lit("").alias("value")).unionByName(x.filter("t = 1").select(url.alias("url"), F.lit("title").alias("name"), F.lit("flagged").alias("value")))
    return ma.restored(d, a).select("doc_id", F.array_join("labels", ",").alias("labels"), "title")


@query("SELECT 'file:///u' || user_id || '/' || event_id AS url, 'X-SOURCE' || user_id AS label FROM events")
def source_labels(spark, sf):
    return ma.source_labels(src.crawl_history(spark, sf)).select("url", F.get("labels", F.lit(0)).alias("label"))


GATE = [("text/html; charset=x", "CONTENT"), ("text/x-chdr", "CONTENT"), ("image/png", "METADATA"), ("application/rss+xml", "CONTENT"), ("", "METADATA")]


@query(literal([(k, g[1]) for k, g in enumerate(GATE)], "id", "index_as").replace("SELECT *", "SELECT id::BIGINT AS id, index_as"))
def mime_gate(spark, sf):
    return ma.gated(frame(spark, [(k, g[0]) for k, g in enumerate(GATE)], "id long, type string"), ["text/plain", "text/html", "application/xml"]).select("id", "index_as")


@query(literal([("a.tar", "f=new", 1), ("b.txt", "", 2)], "url", "ipath", "size").replace("SELECT *", "SELECT url, ipath, size::BIGINT AS size"))
def nested_documents(spark, sf):
    """A container read again replaces everything that came from it."""
    s = "url string, ipath string, size long"
    return ma.nested_replaced(frame(spark, [("a.tar", "f=old", 5), ("a.tar", "f=older", 6), ("b.txt", "", 2)], s), frame(spark, [("a.tar", "f=new", 1)], s))


HISTORY = [("/a/x", "CRAWLED", 5), ("/a/y", "ERROR", 5), ("/ab", "CRAWLED", 5), ("/c/d/e", "TO_CRAWL", 5), ("/f", "CRAWLED", 50)]
EVENTS = [("DELETED", "/a", None, 9), ("MOVED", "/n", "/c/d", 9), ("CREATED", "/new", None, 9), ("WRITE_CLOSED", "/f", None, 9), ("CREATED", "/gone", None, 8), ("DELETED", "/gone", None, 9)]


@query(literal([("/ab", "CRAWLED", 5), ("/n/e", "TO_CRAWL", 5), ("/f", "CRAWLED", 50), ("/new", "CRAWLED", 9)], "url", "status", "date").replace("SELECT *", "SELECT url, status, date::BIGINT AS date"))
def applied_changes(spark, sf):
    """History after file events: written, deleted and moved, folders with what is below them."""
    return ma.apply_events(frame(spark, HISTORY, "url string, status string, date long"), frame(spark, EVENTS, "kind string, location string, previous string, date long"))


@query(f"WITH {CRAWL}, gone AS (SELECT DISTINCT 'file:///u' || user_id || '/' AS folder FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-01 06:00:00') SELECT url, status FROM crawl WHERE NOT starts_with(status, 'TO_') AND regexp_extract(url, '^(.*/)[^/]*$', 1) NOT IN (SELECT folder FROM gone)")
def purged_folders(spark, sf):
    """Crawl history after the folders of every user who signed up on the first morning were deleted."""
    c = src.crawl_history(spark, sf)
    gone = c.filter("status = 'TO_CRAWL' AND date < 1704088800000000").select(F.lit("DELETED").alias("kind"), F.regexp_replace("url", "/[^/]*$", "").alias("location"), F.lit(None).cast("string").alias("previous"), "date")
    return ma.apply_events(c.filter("status != 'TO_CRAWL'").select("url", "status", "date"), gone).select("url", "status")


RESULTS = "res AS (SELECT 'http://h' || (event_id % 17) || '.example/p' || (event_id % 40) AS url, value AS score, 'engine' || (user_id % 3) AS engine, CASE WHEN user_id % 2 = 0 THEN 'docs' ELSE 'pages' END AS idx, 'q' || (user_id % 4) AS query_name, event_id FROM events WHERE event_type = 'click')"


def result_list(spark, sf):
    e = src.table(spark, sf, "events").filter("event_type = 'click'")
    url = F.concat(F.lit("http://h"), (F.col("event_id") % 17).cast("string"), F.lit(".example/p"), (F.col("event_id") % 40).cast("string"))
    engine = F.concat(F.lit("engine"), (F.col("user_id") % 3).cast("string"))
    return e.select(url.alias("url"), F.col("value").alias("score"), F.array(engine).alias("engines"), F.array(F.when(F.col("user_id") % 2 == 0, "docs").otherwise("pages")).alias("indexes"), F.concat(F.lit("q"), (F.col("user_id") % 4).cast("string")).alias("query_name"), engine.alias("engine_name"), "event_id")


@query(f"WITH {RESULTS} SELECT url, max(score) AS score, array_to_string(list_sort(list_distinct(list(engine))), ',') AS engines, array_to_string(list_sort(list_distinct(list(idx))), ',') AS indexes, count(*) AS times FROM res GROUP BY url")
def folded_results(spark, sf):
    r = re_.folded(result_list(spark, sf))
    return r.select("url", "score", F.array_join("engines", ",").alias("engines"), F.array_join("indexes", ",").alias("indexes"), "times")


@query(f"WITH {RESULTS}, x AS (SELECT url, score, engine AS grp FROM res UNION ALL SELECT url, score, idx FROM res), o AS (SELECT grp, url, max(score) AS score FROM x GROUP BY ALL) SELECT grp, count(*) AS results, floor(avg(score))::BIGINT AS group_score FROM o GROUP BY grp")
def results_by_engine(spark, sf):
    return re_.grouped(result_list(spark, sf), "engine")


@query(f"WITH {RESULTS}, o AS (SELECT split_part(split_part(url, '://', 2), '/', 1) AS grp, url, max(score) AS score FROM res GROUP BY ALL) SELECT grp, count(*) AS results, floor(avg(score))::BIGINT AS group_score FROM o GROUP BY grp")
def results_by_host(spark, sf):
    return re_.grouped(re_.folded(result_list(spark, sf)), "host")


INDEXED = "web AS (SELECT url, min(event_id) AS doc_id FROM res WHERE idx = 'pages' AND event_id % 3 = 0 GROUP BY url), own AS (SELECT url, min(event_id) AS doc_id FROM res WHERE idx = 'docs' AND event_id % 5 = 0 GROUP BY url)"


def known_indexes(spark, sf):
    r = result_list(spark, sf).withColumn("doc_id", F.col("event_id"))
    return {"web": r.filter(F.array_contains("indexes", "pages") & (F.col("event_id") % 3 == 0)).select("url", "doc_id"), "own": r.filter(F.array_contains("indexes", "docs") & (F.col("event_id") % 5 == 0)).select("url", "doc_id")}


@query(f"WITH {RESULTS}, {INDEXED} SELECT event_id, CASE WHEN web.url IS NOT NULL THEN 'web' WHEN own.url IS NOT NULL THEN 'own' END AS index_id, coalesce(web.doc_id, own.doc_id, 0) AS doc_id FROM res LEFT JOIN web USING (url) LEFT JOIN own USING (url)")
def indexed_flags(spark, sf):
    """Results that some index has, web pages first."""
    return re_.mark_indexed(result_list(spark, sf), known_indexes(spark, sf)).select("event_id", "index_id", "doc_id")


@query(f"WITH {RESULTS}, {INDEXED}, m AS (SELECT res.*, coalesce(web.doc_id, own.doc_id, 0) AS doc_id FROM res LEFT JOIN web USING (url) LEFT JOIN own USING (url)), h AS (SELECT DISTINCT query_name, engine, url FROM res WHERE event_id < 5000) SELECT event_id, CASE WHEN h.url IS NULL AND doc_id = 0 THEN 'INDEX' WHEN h.url IS NOT NULL AND doc_id > 0 THEN 'LABEL' END AS action FROM m LEFT JOIN h USING (query_name, engine, url)")
def indexing_policy(spark, sf):
    """New results that aren't indexed are to be; old ones that are get the label."""
    r = re_.mark_indexed(result_list(spark, sf), known_indexes(spark, sf))
    return re_.indexing_policy(r, result_list(spark, sf).filter("event_id < 5000"), "NEW").select("event_id", "action")


@query(f"WITH {CLICKS}, a AS (SELECT *, date // 86400000000 AS run FROM clicks), k AS (SELECT *, dense_rank() OVER (PARTITION BY query_name, engine_name ORDER BY run DESC) AS r FROM a), b AS (SELECT query_name, engine_name, url, max(score) AS before FROM k WHERE r = 2 GROUP BY ALL) SELECT event_id, coalesce(score - before, 666.0) AS diff FROM k LEFT JOIN b USING (query_name, engine_name, url) WHERE r = 1")
def live_rerank(spark, sf):
    """Days as runs: the last one against the one before it."""
    h = src.query_history(spark, sf).withColumn("date", F.expr("date div 86400000000"))
    last = h.agg(F.max("date")).first()[0]
    return re_.rerank(h.filter(F.col("date") < last), h.filter(F.col("date") == last)).select("event_id", "diff")


NAMED = [("a", "", "", "No title", "en", "index://localhost/docs/1"), ("b", "T", "fr", "T", "fr", "http://b/"), ("c", None, None, "No title", "en", "index://localhost/docs/3")]


@query(literal([(k + 1, *n[3:]) for k, n in enumerate(NAMED)], "id", "title", "language", "url").replace("SELECT *", "SELECT id::BIGINT AS id, title, language, url"))
def named_results(spark, sf):
    """Titles, languages and locations for results that have none."""
    df = frame(spark, [(k + 1, n[1], n[2], "http://b/" if n[0] == "b" else "") for k, n in enumerate(NAMED)], "id long, title string, language string, url string")
    return re_.named(df, "en").withColumn("url", re_.pseudo_url(F.col("url"), "docs", F.col("id"))).select("id", "title", "language", "url")


CJKV_TEXTS = [(1, "你好 world"), (2, "好吗? hello"), (3, "plain été text v1.beta.x"), (4, "the running dogs")]


def small_index(spark, sf):
    def build():
        d = frame(spark, CJKV_TEXTS, "doc_id long, text string")
        return d.select("doc_id", F.concat(F.lit("file:///t/"), F.col("doc_id").cast("string")).alias("url"), F.lit("").alias("title"), F.lit("text/plain").alias("type"), F.lit("en").alias("language"), "text")

    return index_of(spark, "literal rows", build)


def searched(name: str, text: str, ids: list[int], **how):
    """Registers a two-step search over literal rows; ids are worked out by hand."""
    query(f"SELECT unnest({ids})::BIGINT AS doc_id", name)(lambda spark, sf: small_index(spark, sf).search(text, **how))


searched("cjkv_search", "你好", [1])
searched("cjkv_unigram_search", "好", [1, 2])
searched("cjkv_filter", "tokens:CJKV", [1, 2])
searched("accented_search", "ete", [3])
searched("accents_stripped_search", "wörld", [1])
searched("dotted_search", "beta", [3])
searched("stemmed_search", "dog runs", [4], language="en")
searched("stopped_search", "an dog", [4], language="en", stop=frozenset({"an"}))


@query(literal([("runing dogs", "running dogs"), ("the running", ""), ("zzzzzzzz", "")], "asked", "corrected"))
def corrected_queries(spark, sf):
    """Spelling, only for queries that find nothing."""
    x = small_index(spark, sf)
    return frame(spark, [(q, x.corrected(q)) for q in ("runing dogs", "the running", "zzzzzzzz")], "asked string, corrected string")


PLUGIN = """# comment
<search name="Own" description="An engine" action="http://e.example/find" method=get>
<input name="q" user><input name="src" value="a b"><inputnext name="start" factor="2">
<interpret resultListStart="<ul class='r'>" resultListEnd="</ul>" resultItemStart="<li>" resultItemEnd="</li>"></search>"""
PLUGIN_PAGE = '<p><a href="http://no/">no</a><ul class="r"><li><a href="http://a/1">One</a> first text</li><li>no link</li><li><a href="/2">Two</a></li></ul><li><a href="http://late/">x</a></li>'


@query(literal([("One", "http://a/1", "One first text", 100), ("Two", "/2", "Two", 99)], "title", "url", "extract", "score").replace("SELECT *", "SELECT title, url, extract, score::INT AS score"))
def plugin_results(spark, sf):
    """Results of an engine in the older plug-in format."""
    from quarry.sources import feeds

    return frame(spark, feeds.plugin_results(feeds.parse_plugin(PLUGIN), PLUGIN_PAGE), "title string, url string, extract string, score int")


@query(f"WITH {TOK} SELECT term, strip_accents(term) AS plain FROM (SELECT DISTINCT term FROM occ WHERE regexp_matches(term, '[à-öø-ÿ]')) WHERE strip_accents(term) <> term")
def plain_terms(spark, sf):
    """Terms of the index that stand there without their accents too."""
    from quarry.operators.store import plain_terms as plain

    t = stored(spark, sf).terms().filter("field = 'body'").filter(F.col("term").rlike("[à-öø-ÿ]"))
    return t.select("term", plain("term").alias("plain")).filter("plain != term")


@query(f"WITH {TOK}, p AS (SELECT doc_id, strip_accents(term) AS term, wdf FROM tf WHERE strip_accents(term) <> term) SELECT term, count(*) AS df, sum(wdf)::BIGINT AS cf FROM p GROUP BY term")
def plain_term_statistics(spark, sf):
    t = stored(spark, sf).postings().filter("field = 'plain'")
    return t.groupBy("term").agg(F.count("*").alias("df"), F.sum("wdf").alias("cf"))


@query(f"WITH {TOK}, p AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split(term, '.'), lambda x: x <> ''))) AS term, wdf FROM tf WHERE contains(term, '.')) SELECT term, sum(wdf)::BIGINT AS cf FROM p GROUP BY term")
def dotted_parts(spark, sf):
    t = stored(spark, sf).terms().filter("field = 'part'")
    return t.select("term", "cf")
