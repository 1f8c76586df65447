"""The near-copy stage of the pipeline against brute force: five-word Jaccard of 0.8 or more."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("xxhash")

import corpus_pipeline  # noqa: E402


def shingle_set(text: str) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute_kept(rows: list[tuple]) -> set:
    """rows: unique doc_id, text. The smallest id of each group."""
    sets, parent, held = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for g in s:
            held.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in held.values() for k, a in enumerate(ids) for b in ids[:k]}
    for a, b in pairs:
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i for i in parent if find(i) == i}


def planted() -> list[tuple]:
    """Copies of a few texts with 1 to 8 replaced words, a chain, a crowd, short and blank texts, texts of shared lines."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    texts = []
    for size in (30, 100, 300):
        for _ in range(12):
            base = [word() for _ in range(size)]
            texts.append(base)
            for k in (1, 1, 2, 4, 6, 8):
                copy = list(base)
                for at in rnd.sample(range(size), k):
                    copy[at] = word()
                texts.append(copy)
    crowd = [word() for _ in range(120)]
    for _ in range(150):
        copy = list(crowd)
        copy[rnd.randrange(120)] = word()
        copy[rnd.randrange(120)] = word()
        texts.append(copy)
    lines = [[word() for _ in range(12)] for _ in range(6)]
    for _ in range(60):
        texts.append([w for x in rnd.sample(lines, 3) for w in x] + [word() for _ in range(rnd.randrange(6))])
    out = [" ".join(t) for t in texts] + ["", " ", "\n\n", "one two", "One  two", "a b c d e", "a b c d E", "a b c d e f"]
    return list(enumerate(dict.fromkeys(out), 1))


def test_stage_finds_every_near_copy(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_kept(rows)


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    once = docs.dropDuplicates(["text"]).select("doc_id", "text").collect()
    df = spark.createDataFrame(once, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert got == brute_kept([tuple(r) for r in once])


def test_stage_keeps_one_row(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, long, "a"), (3, long + " x", "b"), (None, "p q", "c"), (None, "P q", "d"), (4, "same", "e"), (4, "same", "e"), (5, None, "f"), (3, "other", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.drop_near_copies(spark, df, "")
    got = sorted((r["doc_id"] or 0, (r["text"] or "").split()[:1]) for r in out.collect())
    assert out.columns == df.columns and got == [(0, ["P"]), (3, ["other"]), (3, ["w0"]), (4, ["same"]), (5, [])] or got == [(0, ["p"]), (3, ["other"]), (3, ["w0"]), (4, ["same"]), (5, [])]
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), "").count() == 0
