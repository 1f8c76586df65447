"""Mixing sources to target weights by systematic sampling.

Targets share SHARE of all words by the sources' weights; none is above CAP times its source's size, and what is cut
off is shared again by weight among the others until none is above. Within a source every document expects
target / size copies. Documents stand in the order of their length (equal lengths by a digest of doc_id); the running
sum of expected copies, with one random offset a source, emits a document once for each integer that it crosses, so a
source's words follow its target at all lengths. Ranks come from counts of small cells plus a rank inside the cell: a
cell is a range of (length, digest), cut in proportion to its rows, so that the order is the same however it is cut and
no source, length or cell is sorted in one task.

Defined cases: null text has no words; a null source is a source, ordered last; empty documents get copies at their
source's rate but add no words; a source without words has target 0 and rate 0; very long texts are counted whole; rows of
equal length and doc_id are ties, any order of which gives the same rows; repeated rows are documents of their own; an
empty table gives no rows; other columns are ignored or carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import as_struct, materialize, release, text_of, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = 42
#: Rows that a part of a cell is meant to hold.
CELL = 1_024


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict:
    """Water-filling over the sources, in plain numbers; source_targets() says the same of a table."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > cap * sizes[s]]
        if not over:
            out |= {s: unit * weight[s] for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
        left = max(left, 0.0)
    return out


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes: source, n (rows), source_size. With target, rate and offset. Sources are sorted by the share at which they
    reach their cap; the first of them that stays below ends the capped ones. One row a source: the windows
    over all sources hold their names and numbers only."""
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    rows = sizes.withColumn("w", F.get(weights, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS)))))
    full = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every) * F.lit(SHARE)
    left = total - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rows = rows.withColumn("unit", left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    rows = rows.withColumn("free", F.col("unit") * F.col("w") <= CAP * F.col("source_size"))
    unit = F.min_by("unit", F.when(F.col("free"), F.struct(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.encode("source", "UTF-8")))).over(every)
    rows = rows.withColumn("level", unit)
    target = F.when(F.col("level").isNull() | (F.col("level") * F.col("w") > CAP * F.col("source_size")), CAP * F.col("source_size")).otherwise(F.col("level") * F.col("w"))
    rows = rows.withColumn("target", target.cast("double"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return rows.select("source", "source_size", "target", rate.alias("rate"), offset(F.col("source"), SEED).alias("offset"))


def offset(source: Column, seed: int) -> Column:
    """In [0, 1), of 20 bits so that sums stay exact."""
    name = F.when(source.isNull(), F.lit(f"{seed}:")).otherwise(F.concat(F.lit(f"{seed}:s"), source))
    return F.conv(F.substring(F.sha2(name, 256), 1, 5), 16, 10).cast("double") / (1 << 20)


def _digest(doc_id: Column) -> Column:
    """Hex digits that order documents of equal length."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def _length_cell(size: Column) -> Column:
    """Sizes up to 64 one by one, then 32 cells for each doubling; grows with size."""
    return (_octave(size) * 64 + size / F.pow(F.lit(2), _octave(size))).cast("long")


def _octave(size: Column) -> Column:
    return F.greatest(F.floor(F.log2(F.greatest(size, F.lit(1)))) - 5, F.lit(0)).cast("int")


def _place(size: Column, digest: Column) -> Column:
    """Where (size, digest) stands within its cell, in [0, 1): grows with size, then with the digest."""
    width = F.pow(F.lit(2.0), _octave(size))
    return (F.pmod(size, width.cast("long")) + F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / (1 << 32)) / width


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (xxhash64 of the text), size, source_size, target, copies of every row, copies 0 included."""
    key = F.xxhash64(text_of(docs)).alias("key")
    slim = materialize(docs.select("doc_id", "source", key, words(text_of(docs)).alias("size"), _digest(F.col("doc_id")).alias("digest")), "sizes")
    plan = materialize(source_targets(slim.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))), "plan")
    # a few hundred cells a source, whatever the number of rows
    cells = slim.groupBy("source", _length_cell(F.col("size")).alias("cell")).agg(F.count("*").alias("n"))
    cells = materialize(cells.select(F.col("source").alias("_s"), F.col("cell").alias("_c"), F.ceil(F.col("n") / CELL).alias("parts")), "cells")

    def celled(df: DataFrame) -> DataFrame:
        df = df.withColumn("cell", _length_cell(F.col("size")))
        df = df.join(cells, df["source"].eqNullSafe(cells["_s"]) & (df["cell"] == cells["_c"]))
        return df.withColumn("part", F.floor(_place(F.col("size"), F.col("digest")) * F.col("parts"))).drop("_s", "_c", "parts")

    counts = celled(slim).groupBy("source", "cell", "part").agg(F.count("*").alias("n"))
    before = counts.select(F.col("source").alias("_s"), F.col("cell").alias("_c"), F.col("part").alias("_t"), (F.sum("n").over(Window.partitionBy("source").orderBy("cell", "part")) - F.col("n")).alias("before"))
    before = materialize(before, "before")
    ranked = celled(slim).withColumn("rank", F.row_number().over(Window.partitionBy("source", "cell", "part").orderBy("size", "digest", "doc_id", "key")))
    ranked = ranked.join(before, ranked["source"].eqNullSafe(before["_s"]) & (ranked["cell"] == before["_c"]) & (ranked["part"] == before["_t"]))
    plan = plan.withColumnRenamed("source", "_source")
    ranked = ranked.join(plan, ranked["source"].eqNullSafe(plan["_source"]))
    at = F.col("before") + F.col("rank")
    copies = F.floor(at * F.col("rate") + F.col("offset")) - F.floor((at - 1) * F.col("rate") + F.col("offset"))
    return ranked.select("doc_id", "source", "key", "size", "source_size", "target", F.least(copies.cast("long"), F.lit(int(CAP))).alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Ids, keys and copies are ranked and shuffled; texts meet their
    numbers of copies, and are shuffled only if those are too many for Spark to broadcast. Of rows that agree in doc_id,
    source and text one stands for all."""
    since = written()
    taken = mix(docs).groupBy("doc_id", "source", "key").agg(F.sum("copies").alias("copies"), F.count("*").alias("times"))
    taken = materialize(taken.filter("copies > 0").withColumnsRenamed({"doc_id": "_id", "source": "_source", "key": "_key"}), "taken")
    release(since, last=1)
    rows = docs.select(as_struct(docs), "doc_id", "source", F.xxhash64(text_of(docs)).alias("key"))
    rows = rows.join(taken, rows["doc_id"].eqNullSafe(taken["_id"]) & rows["source"].eqNullSafe(taken["_source"]) & (rows["key"] == taken["_key"]))
    single = rows.filter("times = 1").select("doc", "copies")
    if not taken.filter("times > 1").isEmpty():
        one = rows.filter("times > 1").groupBy("_id", "_source", "_key", "copies").agg(F.first("doc").alias("doc"))
        single = single.unionByName(one.select("doc", "copies"))
    return single.select("doc", F.explode(F.expr("sequence(1L, copies)"))).select("doc.*")
