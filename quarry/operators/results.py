"""Lists of results: grouping, enrichment from indexes, what of them is to be indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.url import canonical, host_of

NO_TITLE = "No title"


def named(results: DataFrame, language: str = "") -> DataFrame:
    """A title for results that have none, and the query's language for those without one."""
    title = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", F.lit(NO_TITLE)).otherwise(F.col("title"))
    own = F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit(language))
    return results.withColumn("title", title).withColumn("language", own)


def pseudo_url(url: Column, index: str, doc_id: Column) -> Column:
    """What stands for the location of a result that has none."""
    return F.when(F.coalesce(url, F.lit("")) != "", url).otherwise(F.concat(F.lit(f"index://localhost/{index}/"), doc_id.cast("string")))


def ordered(results: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Results by one of the columns a user may sort by."""
    if column not in ("score", "title", "url", "modtime"):
        raise ValueError(f"results aren't sorted by {column}")
    by = F.lower(column) if column in ("title", "url") else F.col(column)
    return results.orderBy(by.desc() if descending else by.asc(), "url")


def folded(results: DataFrame) -> DataFrame:
    """One row a URL: the best score, every engine and index that has it, and how many rows it was."""
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return results.groupBy("url").agg(F.max("score").alias("score"), every("engines").alias("engines"), every("indexes").alias("indexes"), F.count("*").alias("times"))


def grouped(results: DataFrame, by: str) -> DataFrame:
    """grp, results, group_score (the truncated mean). By engine a result stands under every engine and index that has it,
    by host under its URL's host; a URL counts once in a group, with its best score."""
    if by == "host":
        rows = results.withColumn("grp", host_of(F.col("url")))
    else:
        rows = results.withColumn("grp", F.explode(F.array_union("engines", "indexes")))
    once = rows.groupBy("grp", "url").agg(F.max("score").alias("score"))
    return once.groupBy("grp").agg(F.count("*").alias("results"), F.floor(F.avg("score")).cast("long").alias("group_score"))


def mark_indexed(results: DataFrame, indexes: dict[str, DataFrame]) -> DataFrame:
    """index_id and doc_id of the first of some indexes (in order) that has a result's canonical URL; null and 0 if none
    has. Only the results' URLs are looked for."""
    out = results.withColumn("_url", canonical(F.col("url")))
    ids, names = [], []
    for k, (name, docs) in enumerate(indexes.items()):
        known = docs.select(canonical(F.col("url")).alias("_url"), F.col("doc_id").alias(f"_d{k}")).groupBy("_url").agg(F.min(f"_d{k}").alias(f"_d{k}"))
        out = out.join(known, "_url", "left")
        ids.append(F.col(f"_d{k}"))
        names.append(F.when(F.col(f"_d{k}").isNotNull(), F.lit(name)))
    out = out.withColumn("index_id", F.coalesce(*names)).withColumn("doc_id", F.coalesce(*ids, F.lit(0)))
    return out.drop("_url", *[f"_d{k}" for k in range(len(indexes))])


def indexing_policy(results: DataFrame, history: DataFrame, policy: str) -> DataFrame:
    """action of every result: INDEX, LABEL (it is indexed, and only gets the query's label) or null. policy: NOTHING,
    NEW (what the query's history doesn't hold) or ALL. results: query_name, engine_name, url, doc_id."""
    keys = ["query_name", "engine_name", "url"]
    seen = history.select(keys).distinct().withColumn("_seen", F.lit(True))
    out = results.join(seen, keys, "left")
    wanted = {"NOTHING": F.lit(False), "ALL": F.lit(True), "NEW": F.col("_seen").isNull()}[policy]
    action = F.when(F.lit(policy == "NOTHING"), F.lit(None)).when(wanted & (F.col("doc_id") == 0), "INDEX").when(~wanted & (F.col("doc_id") > 0), "LABEL")
    return out.withColumn("action", action).drop("_seen")


def page(results: DataFrame, offset: int, limit: int) -> tuple[DataFrame, int]:
    """A page of results by score, and how many there are."""
    return results.orderBy(F.desc("score"), "doc_id").offset(offset).limit(limit), results.count()


def rerank(history: DataFrame, run: DataFrame) -> DataFrame:
    """A query's history with one more run of it, of which the last two runs stay, and the difference of each result's
    scores between them (666 for what is new)."""
    whole = history.unionByName(run)
    w = Window.partitionBy("query_name", "engine_name").orderBy(F.desc("date"))
    kept = whole.withColumn("_r", F.dense_rank().over(w)).filter("_r <= 2")
    last = kept.filter("_r = 1").drop("_r")
    before = kept.filter("_r = 2").groupBy("query_name", "engine_name", "url").agg(F.max("score").alias("_before"))
    return last.join(before, ["query_name", "engine_name", "url"], "left").withColumn("diff", F.coalesce(F.col("score") - F.col("_before"), F.lit(666.0))).drop("_before")
