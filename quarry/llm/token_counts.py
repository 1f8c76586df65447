"""Token counts of a sentencepiece BPE model by a map-side two-tier lookup.

No piece of the model holds a space mark after another character, nor a line feed, so a text falls into words that
never merge with each other. Tier one is a compact table of the lengths of the corpus's frequent words (Misra-Gries
over all texts, at most TABLE words, so its size is bounded) that every worker gets; tier two encodes misses in
batches and keeps them in a bounded cache of the worker. No word is shuffled but those of the summaries.
Texts with uneven spaces, or with the space mark itself, are encoded whole, and so are words of models that
don't have the property above (it is tested when the model is loaded).

Defined cases: null text counts as empty and has no tokens; very long texts are counted whole; repeated rows are
counted alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import kept, text_of

TABLE = 32_768
LOCAL = 65_536
CACHE = 200_000
SLICE = 256
MARK = "▁"
UNEVEN = re.compile(rf"  |^[ \n]| $| \n|\n |{MARK}")


class WordCounter:
    def __init__(self, model: str):
        import public_tokenizers
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.splits = not any(re.search(rf"[^{MARK}]{MARK}|\n| ", p) for p in pieces) and self.sp.encode("a\nb") == self.sp.encode("a") + self.sp.encode("\nb")[1:]
        self.table: dict[str, int] = {}
        self.cache: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.sp.encode(texts, num_threads=1)]

    def words(self, text: str) -> list[str] | None:
        """Words, those that begin a line with the line feed before them; None if the text must be encoded whole."""
        if not text or not self.splits or UNEVEN.search(text):
            return None
        return text.replace("\n", " \n").split(" ")

    def word_lengths(self, words: list[str]) -> list[int]:
        """A word comes with a space mark of its own, which a line feed's word doesn't have in its text."""
        return [n - (w[0] == "\n") for w, n in zip(words, self.lengths(words))]

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.words(t) for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = list({w for x in cut if x for w in x if w not in self.table and w not in self.cache})
        self.cache.update(zip(new, self.word_lengths(new)))
        whole = iter(self.lengths([t for t, x in zip(texts, cut) if x is None]))
        table, cache = self.table, self.cache
        return [next(whole) if x is None else sum(table[w] if w in table else cache[w] for w in x) for x in cut]


def counter(model: str) -> WordCounter:
    return kept(("token_counts", model), lambda: WordCounter(model))


def _prune(seen: Counter, k: int) -> None:
    """Misra-Gries: lower all by the (k + 1)th count, keep what is above zero."""
    if len(seen) > k:
        low = sorted(seen.values(), reverse=True)[k]
        for w in [w for w, n in seen.items() if n <= low]:
            del seen[w]
        for w in seen:
            seen[w] -= low


def frequent_words(docs: DataFrame, model: str) -> list[str]:
    """At most TABLE words: those that stand out in the merged summaries of all texts."""

    def summary(batches):
        words_of, seen = counter(model).words, Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(words_of(t) or ())
                if len(seen) > 4 * LOCAL:
                    _prune(seen, LOCAL)
        _prune(seen, LOCAL)
        top = seen.most_common(TABLE)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["w", "n"])

    parts = docs.select(text_of(docs).alias("text")).mapInArrow(summary, "w string, n long")
    top = parts.filter(F.length("w") <= 64).groupBy("w").agg(F.sum("n").alias("n")).filter("n >= 8").orderBy(F.desc("n"), "w").limit(TABLE)
    return [r[0] for r in top.select("w").collect()]


def token_counts(docs: DataFrame, model: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    spark = docs.sparkSession
    words = frequent_words(docs, model)
    table = spark.sparkContext.broadcast(("\0".join(words).encode(), bytes(min(255, n) for n in counter(model).word_lengths(words))))

    def run(batches):
        own = counter(model)
        blob, lengths = table.value
        own.table = {w: n for w, n in zip(blob.decode().split("\0"), lengths) if n < 255}
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                part = b.slice(k, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(own.count(part.column(1).to_pylist()), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = text_of(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
