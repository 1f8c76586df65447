"""Exact duplicates by a heavy-hitter split.

Misra-Gries summaries, one a task and merged by their sums, hold every digest that more than 1 / COUNTERS of the
rows have. The few candidates are counted exactly; those that are truly frequent, at most COUNTERS rows, are
broadcast with the row that stays, and their other rows go map-side. All other rows meet in an ordinary shuffle
by digest. Only ids and digests move, unless whole documents are asked for.

Defined cases: null text counts as empty; null doc_id sorts below any other; of repeated rows (equal doc_id and
text) one stays, any one if their other columns differ; very long texts are digested whole; an empty table gives no
rows; columns besides doc_id and text are ignored or carried along unchanged, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import as_struct, materialize, once, release, text_of, without, written

COUNTERS = 1024


def misra_gries(keys: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fold weighted keys into at most k counters; each is low by no more than total / (k + 1)."""
    keys, at = np.unique(keys, return_inverse=True)
    counts = np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)
    if len(keys) > k:
        counts = counts - np.partition(counts, len(counts) - k - 1)[len(counts) - k - 1]
        keys, counts = keys[counts > 0], counts[counts > 0]
    return keys, counts


def _summary(batches):
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for b in batches:
        new = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        keys, counts = misra_gries(np.concatenate([keys, new]), np.concatenate([counts, np.ones(len(new), np.int64)]), COUNTERS)
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["k", "n"])


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and digest of every row, written once so that texts are read once."""
    return materialize(docs.select("doc_id", digest(text_of(docs)).alias("h")), "digests")


def heavy(dig: DataFrame) -> DataFrame:
    """h, n, keep_id of the digests that more than 1 / COUNTERS of the rows have (and at least two): counted
    exactly, at most COUNTERS rows."""
    summaries = dig.select(F.xxhash64("h").alias("k")).mapInArrow(_summary, "k long, n long")
    candidates = summaries.groupBy("k").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k").limit(COUNTERS).select("k")
    exact = dig.withColumn("k", F.xxhash64("h")).join(F.broadcast(candidates), "k", "left_semi").groupBy("h").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"))
    least = max(2, dig.count() // COUNTERS)
    return materialize(exact.filter(F.col("n") >= least), "heavy")


def _loses(keep: Column) -> Column:
    return F.coalesce(F.col("doc_id").isNull() | (F.col("doc_id") < keep), F.lit(False))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, h (SHA-256 of the text, binary). Rows of heavy
    digests are settled map-side; those of them that carry the winner's id (more than one if rows repeat) are counted
    before they meet."""
    dig = digests(docs)
    winners = heavy(dig).withColumnsRenamed({"n": "group_size", "keep_id": "winner"})
    marked = dig.join(F.broadcast(winners), "h", "left")
    often, cols = F.col("group_size").isNotNull(), ["doc_id", "keep_id", "group_size", "kept", "h"]
    lost = often & F.col("winner").isNotNull() & _loses(F.col("winner"))
    lost_rows = marked.filter(lost).select("doc_id", F.col("winner").alias("keep_id"), "group_size", F.lit(False).alias("kept"), "h")
    best = marked.filter(often & ~lost).groupBy("doc_id", "winner", "group_size", "h").agg(F.count("*").alias("times"))
    best_rows = best.select("doc_id", F.col("winner").alias("keep_id"), "group_size", F.explode(F.expr("transform(sequence(1L, times), i -> i = 1)")).alias("kept"), "h")
    w = Window.partitionBy("h")
    rest = marked.filter(~often).select("doc_id", F.max("doc_id").over(w).alias("keep_id"), F.count("*").over(w).alias("group_size"), (F.row_number().over(w.orderBy(F.desc_nulls_last("doc_id"))) == 1).alias("kept"), "h")
    return rest.select(cols).unionByName(best_rows.select(cols)).unionByName(lost_rows.select(cols))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, whole and unchanged. Ids and digests decide; texts meet the ids of the rows that go,
    and are shuffled only if those are too many for Spark to broadcast."""
    since = written()
    dig = digests(docs)
    winners = heavy(dig)
    rare = dig.join(F.broadcast(winners.select("h")), "h", "left_anti").groupBy("h", "doc_id").agg(F.count("*").alias("times"))
    ranked = rare.withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy(F.desc_nulls_last("doc_id"))))
    ranked = materialize(ranked.filter("rank > 1 OR times > 1"), "rare")
    best = winners.join(dig, (dig["h"] == winners["h"]) & dig["doc_id"].eqNullSafe(winners["keep_id"])).groupBy(winners["h"], "doc_id").agg(F.count("*").alias("times"))
    again = materialize(ranked.filter("rank = 1").select("h", "doc_id").unionByName(best.filter("times > 1").select("h", "doc_id")), "again")
    release(since, keep=(winners, ranked, again))
    whole = docs.select(as_struct(docs), F.col("doc_id"), digest(text_of(docs)).alias("h"))
    marked = whole.join(F.broadcast(winners.select("h", F.col("keep_id").alias("winner"))), "h", "left")
    kept = marked.filter(~(F.col("winner").isNotNull() & _loses(F.col("winner")))).drop("winner")
    kept = without(kept, ranked.filter("rank > 1"), "h")
    return once(kept, again, "h").select("doc.*")
