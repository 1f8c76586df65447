"""Stages delete what they wrote as soon as nothing needs it."""

from __future__ import annotations

import glob
import time

import pytest

pytest.importorskip("xxhash")

import corpus_pipeline  # noqa: E402
from quarry.llm import common  # noqa: E402


@pytest.mark.parametrize(("stage", "most"), [("exact_dedup", 3), ("simhash_near_dedup", 2), ("mix_sources", 1)])
def test_stage_leaves_only_what_its_result_reads(spark, stage, most):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    since = common.written()
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, "/root/testdata/sf0.001")
    assert common.written() - since <= most
    assert 0 < out.count()
    common.release(since)


def test_written_tables_leave_no_shuffles(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in folders for f in glob.glob(f"{d.getPath()}/*/shuffle_*")}
    before = files()
    df = common.materialize(spark.range(10_000).selectExpr("id % 1000 AS k").groupBy("k").count(), "shuffled")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and df.count() == 1000
    assert spark.conf.get(common.CLEANUP) == "false"


def test_texts_that_no_decision_concerns_do_not_move(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.struct("id").alias("doc"), F.when(F.col("id") % 1000 != 7, F.col("id")).alias("doc_id"), F.xxhash64(F.col("id") % 5000).alias("key"))
    gone = rows.filter("doc.id % 10 = 7").select("doc_id", "key").distinct()
    possible, others = common.split(rows, gone, "key")
    near, far = ({r[0] for r in x.select("doc.id").collect()} for x in (possible, others))
    want = {i for i in range(20_000) if i % 10 == 7}
    assert want <= near and len(near) < 3_000 and near | far == set(range(20_000)) and not near & far
    kept = sorted(r[0] for r in common.without(rows, gone, "key").select("doc.id").collect())
    assert kept == sorted(set(range(20_000)) - want)
