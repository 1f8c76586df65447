"""The inverted index as DataFrames: postings, term statistics, document lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokens

K1, B = 1.0, 0.5


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, pos, term: one row a token, positions from 0."""
    return docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "term"))


def postings(docs: DataFrame) -> DataFrame:
    return occurrences(docs).groupBy("doc_id", "term").agg(F.count("*").alias("wdf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def frequencies(docs: DataFrame) -> DataFrame:
    """doc_id, term, wdf, without positions: partial sums before the shuffle."""
    return occurrences(docs).groupBy("doc_id", "term").agg(F.count("*").alias("wdf"))


def term_stats(docs: DataFrame) -> DataFrame:
    return frequencies(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("wdf").alias("cf"))


def _times(word: str) -> Column:
    return F.size(F.filter("t", lambda x: x == word))


def bm25(docs: DataFrame, terms: list[str], every: bool = True) -> DataFrame:
    """doc_id, score of the documents with every (or any) of the terms. One pass over the texts counts lengths and
    wanted terms inside each row, so that nothing but two numbers a document is aggregated."""
    terms = sorted(set(terms))
    toks = docs.select("doc_id", tokens(F.col("text")).alias("t"))
    counted = toks.select("doc_id", F.size("t").alias("dl"), *[_times(w).alias(f"tf{i}") for i, w in enumerate(terms)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))])
    score, hit = F.lit(0.0), None
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1) * tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * F.col("dl") / F.col("avgdl")))
        hit = tf > 0 if hit is None else (hit & (tf > 0) if every else hit | (tf > 0))
    return counted.filter(hit).join(F.broadcast(stats)).select("doc_id", F.round(score, 6).alias("score"))


def phrase(docs: DataFrame, words: list[str]) -> DataFrame:
    """doc_ids whose tokens hold the words one after another."""
    t = tokens(F.col("text"))
    joined = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    return docs.filter(F.contains(joined, F.lit(f" {' '.join(words)} "))).select("doc_id")


def near(docs: DataFrame, a: str, b: str, window: int = 10) -> DataFrame:
    """doc_ids where both words stand within the window, either way round."""
    t = docs.select("doc_id", tokens(F.col("text")).alias("t"))
    at = lambda w: F.filter(F.transform("t", lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())
    p = t.select("doc_id", at(a).alias("a"), at(b).alias("b"))
    return p.filter(F.exists("a", lambda i: F.exists("b", lambda j: F.abs(i - j) < window))).select("doc_id")
