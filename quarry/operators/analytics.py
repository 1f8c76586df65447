"""History and result analytics, and index maintenance, DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank_diff(history: DataFrame) -> DataFrame:
    """The latest score of a result against the run before; 666 marks a result that has none."""
    w = Window.partitionBy("query_name", "engine_name", "url").orderBy(F.desc("date"), F.desc("event_id"))
    rows = history.withColumn("rn", F.row_number().over(w)).withColumn("previous", F.lead("score").over(w)).filter("rn = 1")
    return rows.select("query_name", "engine_name", "url", "score", F.coalesce(F.col("score") - F.col("previous"), F.lit(666.0)).alias("diff"))


def latest_runs(history: DataFrame) -> DataFrame:
    return history.groupBy("query_name", "engine_name").agg(F.max("date").alias("last_run"), F.countDistinct("date").alias("runs"))


def last_two_runs(history: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_name", "engine_name").orderBy(F.desc("date"))
    return history.withColumn("r", F.dense_rank().over(w)).filter("r <= 2").drop("r")


def group_by_host(history: DataFrame) -> DataFrame:
    """Results by host; a group's score is the truncated mean."""
    from quarry.functions.url import host_of

    return history.groupBy(host_of(F.col("url")).alias("host")).agg(F.count("*").alias("results"), F.floor(F.avg("score")).cast("long").alias("group_score"))


def queue_pop(queue: DataFrame, n: int = 1) -> DataFrame:
    return queue.orderBy(F.desc("date"), "url").limit(n)


def leftovers(indexed: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """What the last crawl no longer found."""
    return indexed.join(seen.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def set_labels(labels: DataFrame, add: list[str], drop: list[str]) -> DataFrame:
    """Reserved labels, which begin with X-, are never dropped."""
    gone = F.array(*[F.lit(x) for x in drop if not x.startswith("X-")]).cast("array<string>")
    return labels.withColumn("labels", F.array_sort(F.array_union(F.array_except("labels", gone), F.array(*[F.lit(x) for x in add]).cast("array<string>"))))


def collapse(results: DataFrame, key: str) -> DataFrame:
    """The best result of each key."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "doc_id")
    return results.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
