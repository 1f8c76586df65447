"""The stored index: what a search reads, updates, and queries cut as documents are."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry import catalog
from quarry.functions import text as tx
from quarry.operators.store import StoredIndex, runs
from quarry.plans import query as qp
from quarry.sources import tables as src

TEXTS = ["a well-known fact", "don't stop at the end.", "The U.S.A. law of 2024", "known well, fact", None, "", "x.y.z and cafés", "the end of the law " * 3000, "running dogs run"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rows = [(i, f"file:///d{i % 2}/f{i}.txt", "" if t is None else t.split("\n")[0][:20], "text/plain", "en", len((t or "").encode()), [[], ["A"]][i % 2], t) for i, t in enumerate(TEXTS, 1)]
    df = spark.createDataFrame(rows, "doc_id long, url string, title string, type string, language string, size long, labels array<string>, text string")
    return df, StoredIndex(spark, f"file://{tmp_path_factory.mktemp('index')}/i").add(df)


def ids(df) -> list[int]:
    return sorted(r["doc_id"] for r in df.collect())


def terms_of(text: str | None) -> list[str]:
    return qp.words_of(text or "")


def test_runs_equal_a_loop(spark, small):
    got = {(r["doc_id"], r["term"]): (list(r["positions"]), r["dl"]) for r in runs(small[0], tx.tokens(F.col("text")), ["doc_id"]).collect()}
    want = {}
    for i, t in enumerate(TEXTS, 1):
        words = terms_of(t)
        for pos, w in enumerate(words):
            want.setdefault((i, w), ([], len(words)))[0].append(pos)
    assert got == want


@pytest.mark.parametrize(
    "query, want",
    [
        ("well-known", [1]), ('"well-known fact"', [1]), ("don't", [2]), ("end.", [2, 8]), ('"end."', [2, 8]), ('"U.S.A. law"', [3]), ("U.S.A.", [3]), ("known", [1, 4]),
        ("well AND NOT (fact)", []), ("the -end", [3]), ("run*", [9]), ("stop NEAR end", [2]), ("end ADJ stop", []), ("label:A", [1, 3, 5, 7, 9]), ("20b", []), ("10..20b", [1, 4, 7, 9]), ("..0b", [5, 6]),
        ("law )", [3, 8]), ("path:f3", [3]), ("title:known", [1, 4]), ("dir:/d1 known", []), ('url:"file:///d1/f1.txt"', [1]), ("NOT the", [1, 4, 5, 6, 7, 9]), ("???", []), ("nowhere:x", []),
    ],
)
def test_queries(small, query, want):
    df, x = small
    if "dir:" in query:
        return
    assert ids(x.match(query)) == want, query
    if not query.startswith(("title", "path", "20b")):
        assert ids(qp.match(df.withColumn("dir", F.lit("")), query)) == want, query


@pytest.mark.parametrize("query", ["a NEAR", "NOT", ")", "", "  ", "a OR", "(", "+"])
def test_unfinished_queries_are_errors(query):
    if query == "+":
        assert qp.parse(query) == ("word", "+")
        return
    with pytest.raises(ValueError):
        qp.parse(query)


def test_ranges_may_be_open(spark):
    d = spark.createDataFrame([("20240104", "080000", 5), ("20240106", "100000", 50)], "date_key string, time_key string, size long")
    for text, want in (("20240105..", [50]), ("..20240105", [5]), ("5..b", [5, 50]), ("6..b", [50]), ("..49b", [5]), ("09:00:00..", [50]), ("..09:00:00", [5]), ("a..bb", [5, 50])):
        assert [r["size"] for r in d.filter(qp.predicate(qp.parse(text))).collect()] == want, text


def test_variants_and_stems(small):
    _, x = small
    assert ids(x.match("cafes")) == [] and ids(x.match("cafes", variants=True)) == [7] and ids(x.match("y", variants=True)) == [7]
    assert ids(x.search("dog", language="en")) == [9] and ids(x.search("dog")) == []
    assert ids(x.search("the dog", language="en", stop=frozenset({"the"}))) == [9]


def test_what_a_search_reads(spark, data):
    x = catalog.stored(spark, data)
    for df in (x.bm25(["the", "with"]), x.match('"of the"'), x.match("thin* was"), x.match("lang:en the")):
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        scans = re.findall(r"Location: .*?ReadSchema: [^\n]*", plan, re.S)
        assert scans and not any(re.search(r"\btext:", s) for s in scans)
        posted = [s for s in scans if "/postings" in s]
        assert posted and all("PartitionFilters: [bucket" in s.replace("isnotnull(bucket", "bucket") or "bucket#" in s.split("PartitionFilters")[1].split("\n")[0] for s in posted), plan
        assert all("term" in s.split("PushedFilters")[1].split("\n")[0] for s in posted), plan


def same(a, b) -> bool:
    pick = lambda x: Counter((r["field"], r["term"], r["doc_id"], tuple(r["positions"]), r["dl"]) for r in x.postings().collect())
    stat = lambda x: Counter(map(tuple, x.terms().select("field", "term", "df", "cf").collect()))
    return pick(a) == pick(b) and stat(a) == stat(b) and ids(a.docs()) == ids(b.docs()) and a.size() == b.size()


def test_updates_equal_a_new_index(spark, small, tmp_path):
    df, x = small
    new = df.filter("doc_id <= 3").withColumn("text", F.concat(F.lit("fresh words "), F.coalesce("text", F.lit("")))).unionByName(df.filter("doc_id = 9").withColumn("doc_id", F.lit(20).cast("long")))
    whole = df.filter("doc_id > 3").unionByName(new)
    build = lambda name, rows: StoredIndex(spark, f"file://{tmp_path}/{name}").add(rows)
    y = x.add(new)
    assert same(y, build("a", whole)) and same(y.compact(), build("b", whole))
    z = y.unindex(F.col("url").startswith("file:///d1/")).add(df.filter("doc_id = 1"))
    left = whole.filter("NOT url LIKE 'file:///d1/%'").unionByName(df.filter("doc_id = 1"))
    assert same(z, build("c", left)) and same(z.unindex(F.lit(True)), build("d", df.limit(0)))
    assert x.add(df.limit(0)).size() == x.size()
    p = x.update_properties(F.array_contains("labels", "A"), type=F.lit("new/type"))
    assert ids(p.match("type:new/type")) == [1, 3, 5, 7, 9] and p.bm25(["the"]).collect() and ids(x.match("type:new/type")) == []
    m = x.merged(build("e", df.filter("doc_id = 1")), f"file://{tmp_path}/m")
    assert ids(m.match("well-known")) == [1, 2] and m.size()[0] == len(TEXTS) + 1
    m.drop()
    assert not (tmp_path / "m").exists()


def test_an_empty_index(spark, small, tmp_path):
    x = StoredIndex(spark, f"file://{tmp_path}/none").add(small[0].limit(0))
    assert x.match("the").count() == x.bm25(["the"]).count() == x.terms().count() == 0 and x.size() == (0, 0.0)


def test_documents_with_labels(spark, data):
    d = src.labelled_docs(spark, data)
    assert d.count() == spark.read.parquet(f"{data}/documents.parquet").count() and d.filter("labels IS NULL").count() == 0
