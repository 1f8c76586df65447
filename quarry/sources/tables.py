"""The indexed documents and the bookkeeping tables, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, url, title, type, language, size, modtime, date_key, time_key, datetime_key, dir, file, ext."""
    d = table(spark, sf_dir, "documents")
    when = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)
    file = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    folder = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"))
    return d.select("doc_id", F.concat(F.lit("file://"), folder, F.lit("/"), file).alias("url"), F.substring_index("text", "\n", 1).alias("title"), F.lit("text/plain").alias("type"), F.col("lang").alias("language"), F.octet_length("text").cast("long").alias("size"), when.alias("modtime"), F.date_format(when, "yyyyMMdd").alias("date_key"), F.date_format(when, "HHmmss").alias("time_key"), F.date_format(when, "yyyyMMddHHmmss").alias("datetime_key"), folder.alias("dir"), file.alias("file"), F.lit("txt").alias("ext"), F.col("source").alias("site"), "text")


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and its label set, sorted and distinct; documents without labels have none."""
    x = table(spark, sf_dir, "labels")
    return x.select("doc_id", F.array_compact(F.array(F.when(F.col("quality") == 1, "Good"), F.when(F.col("toxic") == 1, "Toxic"))).alias("labels"))


def query_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'click'")
    return e.select(F.concat(F.lit("q"), (F.col("user_id") % 10).cast("string")).alias("query_name"), F.concat(F.lit("engine"), (F.col("user_id") % 3).cast("string")).alias("engine_name"), F.concat(F.lit("http://h"), (F.col("event_id") % 17).cast("string"), F.lit(".example/p")).alias("url"), F.col("value").alias("score"), F.unix_micros(F.col("ts").cast("timestamp")).alias("date"), "event_id")


def crawl_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "TO_CRAWL").when(F.col("event_type") == "purchase", "CRAWLED").when(F.col("event_type") == "view", "CRAWLING").otherwise("LINK")
    return e.select(F.concat(F.lit("file:///u"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string")).alias("url"), status.alias("status"), F.col("user_id").alias("source_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("date"))


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_info with the labels of each document, none as an empty array."""
    sets = doc_labels(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"))
    return doc_info(spark, sf_dir).join(sets, "doc_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
