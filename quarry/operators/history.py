"""Bookkeeping tables as DataFrames: crawl sources and items, queues, query history, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_source(sources: DataFrame, url: str) -> DataFrame:
    """One more source, numbered after the largest."""
    return sources.unionByName(sources.agg((F.coalesce(F.max("source_id"), F.lit(0)) + 1).cast("long").alias("source_id")).withColumn("url", F.lit(url)))


def set_status(items: DataFrame, old: str, new: str, source: int | None = None) -> DataFrame:
    wanted = F.col("status") == old
    if source is not None:
        wanted &= F.col("source_id") == source
    return items.withColumn("status", F.when(wanted, new).otherwise(F.col("status")))


def start_crawl(items: DataFrame) -> DataFrame:
    """What a new crawl begins from: errors, links and unfinished items go; crawled ones are to be met again."""
    return set_status(items.filter(~F.col("status").isin("ERROR", "LINK", "CRAWLING")), "CRAWLED", "TO_CRAWL")


def delete_items(items: DataFrame, prefix: str | None = None, before: int | None = None, where: Column | None = None) -> DataFrame:
    """Without the rows under a URL prefix, older than a date, or of any other condition; all that are given hold."""
    gone = F.lit(True) if where is None else where
    if prefix is not None:
        gone &= F.col("url").startswith(prefix)
    if before is not None:
        gone &= F.col("date") < before
    return items.filter(~F.coalesce(gone, F.lit(False)))


def autocomplete(history: DataFrame, prefix: str, n: int = 10) -> DataFrame:
    return history.filter(F.col("url").startswith(prefix)).select("url").distinct().orderBy("url").limit(n)


def history_results(history: DataFrame, name: str, engine: str, n: int) -> DataFrame:
    found = history.filter((F.col("query_name") == name) & (F.col("engine_name") == engine))
    return found.orderBy(F.desc("date"), F.desc("score"), "event_id").limit(n)


def latest_extract(history: DataFrame) -> DataFrame:
    return history.groupBy("query_name", "engine_name", "url").agg(F.max_by("extract", F.struct("date", "event_id")).alias("extract"))


def attributes(rows: DataFrame, prefix: str = "") -> DataFrame:
    """url to a map of its attributes, the prefix cut off; of a repeated name the largest value."""
    kept = rows.filter(F.col("name").startswith(prefix)).groupBy("url", F.substr("name", F.lit(len(prefix) + 1)).alias("name")).agg(F.max("value").alias("value"))
    return kept.groupBy("url").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("attributes"))


def route_events(events: DataFrame, blocked: list[str]) -> DataFrame:
    """File events that lead to work: hidden files, directories' writes and blacklisted patterns are left out."""
    name = F.element_at(F.split("location", "/"), -1)
    keep = ~name.startswith(".")
    for pattern in blocked:
        keep &= ~F.col("location").like(pattern.replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_"))
    action = F.when(F.col("kind").isin("CREATED", "WRITE_CLOSED"), "INDEX").when(F.col("kind") == "DELETED", "UNINDEX").when(F.col("kind") == "MOVED", "MOVE")
    return events.filter(keep).withColumn("action", action).filter(F.col("action").isNotNull())


def set_attributes(rows: DataFrame, new: DataFrame) -> DataFrame:
    """url, name, value after some are set: a URL has one value of a name."""
    return rows.join(new.select("url", "name"), ["url", "name"], "left_anti").unionByName(new)
