"""What happens to documents and crawl history as files change, move and go. Tables in, tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed(listing: DataFrame, history: DataFrame) -> DataFrame:
    """Files that a crawl must read: those that history doesn't hold, or holds with an older date. Both: url, date."""
    known = history.groupBy("url").agg(F.max("date").alias("_date"))
    return listing.join(known, "url", "left").filter(F.col("_date").isNull() | (F.col("_date") < F.col("date"))).drop("_date")


def under(url: Column, folder: str) -> Column:
    """Whether a URL is that of a file or folder, or below it."""
    return (url == folder.rstrip("/")) | url.startswith(folder.rstrip("/") + "/")


def moved(docs: DataFrame, old: str, new: str) -> DataFrame:
    """Documents after a file or folder has moved: locations begin with the new name, and a title that was the file's name
    is its new name."""
    here = under(F.col("url"), old)
    url = F.concat(F.lit(new.rstrip("/")), F.substr("url", F.lit(len(old.rstrip("/")) + 1)))
    name = lambda c: F.substring_index(c, "/", -1)
    title = F.when(here & (F.col("title") == name(F.col("url"))), name(url)).otherwise(F.col("title"))
    return docs.withColumn("title", title).withColumn("url", F.when(here, url).otherwise(F.col("url")))


def deleted(rows: DataFrame, gone: str) -> DataFrame:
    """Documents, or history, after a file or folder is deleted."""
    return rows.filter(~under(F.col("url"), gone))


def drop_sources(items: DataFrame, configured: DataFrame) -> DataFrame:
    """History without the items of sources that are configured no longer."""
    return items.join(configured.select("source_id"), "source_id", "left_semi")


def restored(docs: DataFrame, attributes: DataFrame) -> DataFrame:
    """Documents with the labels, titles and types that were kept for them. attributes: url, name, value; a name that begins
    with label. is a label."""
    label = F.when(F.col("name").startswith("label."), F.substr("name", F.lit(7)))
    pick = lambda k: F.max(F.when(F.col("name") == k, F.col("value")))
    kept = attributes.groupBy("url").agg(F.array_sort(F.collect_set(label)).alias("_labels"), pick("title").alias("_title"), pick("type").alias("_type"))
    out = docs.join(kept, "url", "left")
    labels = F.array_sort(F.array_union(F.coalesce("labels", F.array().cast("array<string>")), F.coalesce("_labels", F.array().cast("array<string>"))))
    return out.withColumn("labels", labels).withColumn("title", F.coalesce("_title", "title")).withColumn("type", F.coalesce("_type", "type")).drop("_labels", "_title", "_type")


def source_labels(files: DataFrame) -> DataFrame:
    """Crawled documents with the label of their source."""
    return files.withColumn("labels", F.array(F.concat(F.lit("X-SOURCE"), F.col("source_id").cast("string"))))


def gated(files: DataFrame, supported: list[str], refuse: bool = False) -> DataFrame:
    """index_as: CONTENT for types that a filter reads (or of which a parent is read), else METADATA, or refused."""
    from quarry.functions.mime import parents

    mime = F.substring_index("type", ";", 1)
    reads = F.lit(False)
    for t in supported:
        reads |= (mime == t) | F.array_contains(parents(mime), t)
    return files.withColumn("index_as", F.when(reads, "CONTENT").otherwise("REFUSED" if refuse else "METADATA"))


def nested_replaced(docs: DataFrame, fresh: DataFrame) -> DataFrame:
    """Documents after a container was read again: everything that came from it goes, then its parts come. Both: url,
    ipath; parts of a container have its url."""
    return docs.join(fresh.select("url").distinct(), "url", "left_anti").unionByName(fresh, allowMissingColumns=True)


def crawl_history(history: DataFrame, listing: DataFrame, source_id: int) -> tuple[DataFrame, DataFrame]:
    """One crawl of a source: its history after it, and the items that it no longer found. Errors, links and unfinished
    items are forgotten first; what was crawled is expected again; what is listed is crawled."""
    mine = F.col("source_id") == source_id
    old = history.filter(mine & ~F.col("status").isin("ERROR", "LINK", "CRAWLING"))
    gone = old.join(listing.select("url"), "url", "left_anti")
    now = listing.select("url", F.lit("CRAWLED").alias("status"), F.lit(source_id).cast(history.schema["source_id"].dataType).alias("source_id"), "date")
    return history.filter(~mine).unionByName(now), gone


def queued(queue: DataFrame, actions: DataFrame) -> DataFrame:
    """A queue after more actions are pushed: of one queue and URL the last one stays. Both: queue_id, url, type, date."""
    whole = queue.unionByName(actions)
    cols = [c for c in whole.columns if c not in ("queue_id", "url")]
    last = whole.groupBy("queue_id", "url").agg(F.max(F.struct("date", *[c for c in cols if c != "date"])).alias("_x"))
    return last.select("queue_id", "url", *[F.col(f"_x.{c}").alias(c) for c in cols])


def admitted(actions: DataFrame, busy: DataFrame, slots: int) -> DataFrame:
    """now: whether an action starts at once. What is in progress already (by URL) isn't started again and is left out; as
    many as there are free slots start, the oldest first, the others wait."""
    fresh = actions.join(busy.select("url"), "url", "left_anti").groupBy("url").agg(F.min("date").alias("date"))
    first = fresh.orderBy("date", "url").limit(max(slots, 0)).select("url", F.lit(True).alias("now"))
    return fresh.join(first, "url", "left").withColumn("now", F.coalesce("now", F.lit(False)))


def _ancestors(url: Column) -> Column:
    """A URL and every folder above it."""
    parts = F.split(url, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def apply_events(history: DataFrame, events: DataFrame) -> DataFrame:
    """History (url, status, date) after a batch of file events (kind, location, previous, date; MOVED has a previous
    location). Of several events of a location the last counts. What was created or written is CRAWLED, unless history holds
    it with a newer date; what was deleted goes with everything below it; what moved is rewritten with everything below
    it. URLs meet events by their folders, so that a folder's event needs no scan for each row."""
    last = events.groupBy("location").agg(F.max_by(F.struct("kind", "previous", "date"), "date").alias("e")).select("location", "e.*")
    above = history.select("url", F.explode(_ancestors(F.col("url"))).alias("_folder"))
    gone = above.join(last.filter("kind = 'DELETED'").select(F.col("location").alias("_folder")), "_folder", "left_semi").select("url").distinct()
    moves = last.filter("kind = 'MOVED'").select(F.col("previous").alias("_folder"), F.col("location").alias("_to"))
    new = above.join(moves, "_folder").groupBy("url").agg(F.max_by(F.struct("_folder", "_to"), F.length("_folder")).alias("_m"))
    kept = history.join(gone, "url", "left_anti").join(new, "url", "left")
    url = F.coalesce(F.concat(F.col("_m._to"), F.expr("substr(url, length(_m._folder) + 1)")), F.col("url"))
    kept = kept.select(url.alias("url"), "status", "date")
    fresh = last.filter("kind IN ('CREATED', 'WRITE_CLOSED')").select(F.col("location").alias("url"), F.lit("CRAWLED").alias("status"), "date")
    both = kept.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    best = both.groupBy("url").agg(F.max(F.struct("date", "_new", "status")).alias("x"))
    return best.select("url", "x.status", "x.date")
