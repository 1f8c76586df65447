"""One index as an object: document lookups, labels, searches, suggestions, and desktop-search answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.extract import snippet
from quarry.functions.text import tokens
from quarry.operators import analytics as an
from quarry.operators import index as ix
from quarry.plans import query as qp
from quarry.sources.feeds import normalize_query, without_filters

ORDERS = {"DATE_DESC": [F.desc, "datetime_key"], "DATE_ASC": [F.asc, "datetime_key"], "SIZE_DESC": [F.desc, "size"]}


class SearchIndex:
    """docs: doc_info() columns, text included. labels: doc_id and a label array. Updates give a new index."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        self.docs, self.label_sets = docs, labels

    def document_info(self, doc_id: int) -> DataFrame:
        return self.docs.filter(F.col("doc_id") == doc_id).drop("text")

    def has_document(self, url: str) -> int:
        """The document's id, 0 if there is none."""
        row = self.docs.filter(F.col("url") == url).agg(F.min("doc_id").alias("i")).first()
        return row["i"] or 0

    def document_terms(self, doc_id: int) -> DataFrame:
        return ix.postings(self.docs.filter(F.col("doc_id") == doc_id).select("doc_id", "text"))

    def terms_count(self, doc_id: int) -> int:
        return self.document_terms(doc_id).count()

    def labels(self) -> DataFrame:
        return self.label_sets.select(F.explode("labels").alias("label")).distinct()

    def document_labels(self, doc_id: int) -> list[str]:
        row = self.label_sets.filter(F.col("doc_id") == doc_id).first()
        return list(row["labels"]) if row else []

    def set_labels(self, doc_ids: list[int], add: list[str], drop: list[str] = ()) -> SearchIndex:
        mine = F.col("doc_id").isin(doc_ids)
        have = self.docs.filter(mine).select("doc_id").join(self.label_sets.filter(mine), "doc_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
        return SearchIndex(self.docs, self.label_sets.filter(~mine).unionByName(an.set_labels(have, list(add), list(drop))))

    def delete_label(self, label: str) -> SearchIndex:
        return SearchIndex(self.docs, an.set_labels(self.label_sets, [], [label]))

    def documents_count(self, label: str = "") -> int:
        return self.label_sets.filter(F.array_contains("labels", label)).count() if label else self.docs.count()

    def list_documents(self, offset: int = 0, limit: int = 100) -> DataFrame:
        return self.docs.drop("text").orderBy("doc_id").offset(offset).limit(limit)

    def update(self, rows: DataFrame) -> SearchIndex:
        return SearchIndex(an.upsert(self.docs, rows, "doc_id"), self.label_sets)

    def unindex(self, doc_ids: list[int]) -> SearchIndex:
        gone = F.col("doc_id").isin(doc_ids)
        return SearchIndex(self.docs.filter(~gone), self.label_sets.filter(~gone))

    def close_terms(self, prefix: str) -> DataFrame:
        return ix.occurrences(self.docs).filter(F.col("term").startswith(prefix.lower())).select("term").distinct().orderBy("term").limit(10)

    def query(self, text: str, sort: str = "RELEVANCE", offset: int = 0, limit: int = 10) -> DataFrame:
        """A page of results with score (by the text's plain words) and extract. An empty text is an error."""
        text = normalize_query(text)
        if not text:
            raise ValueError("empty query")
        words = [w for w in without_filters(text).replace('"', " ").replace("(", " ").replace(")", " ").lower().split() if w not in ("and", "or", "not", "near", "adj") and w[0] not in "-"]
        words = sorted({w.lstrip("+").rstrip("*") for w in words} - {""})
        docs = self.docs.join(self.label_sets, "doc_id", "left") if "label:" in text else self.docs
        found = qp.match(docs, text).select(self.docs.columns)
        if words:
            scores = ix.bm25(self.docs.select("doc_id", "text"), words, every=False)
            found = found.join(scores, "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("extract", snippet(F.col("text"), words))
        else:
            found = found.withColumn("score", F.lit(0.0)).withColumn("extract", F.substring("text", 1, 300))
        first = [ORDERS[sort][0](ORDERS[sort][1])] if sort in ORDERS else []
        return found.drop("text").orderBy(*first, F.desc("score"), F.desc("datetime_key"), "doc_id").offset(offset).limit(limit)

    def search_within(self, text: str, doc_ids: list[int]) -> DataFrame:
        return SearchIndex(self.docs.filter(F.col("doc_id").isin(doc_ids)), self.label_sets).query(text)

    def result_metas(self, doc_ids: list[int]) -> DataFrame:
        return self.docs.filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "title", "url", "type")

    def statistics(self) -> DataFrame:
        return self.docs.agg(F.count("*").alias("documents"), F.sum("size").alias("bytes"), F.sum(F.size(tokens(F.col("text")))).alias("terms"))
