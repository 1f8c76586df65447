"""I-Match fingerprints over several randomised lexicons, in DataFrame functions only.

Terms are the lower-cased runs of letters and digits. A first pass counts in how many documents every term occurs; those
within a band of inverse document frequency make the lexicon. As every document holds few distinct terms, at most
(mean distinct terms of a document) / LOW_SHARE terms can occur in LOW_SHARE of the documents, whatever the
corpus's size, so the lexicon is bounded; it goes to the executors as a hash table of 64-bit term hashes in one
literal. Each of the randomised lexicons keeps a random part of it, from a half to a 256th; a document's terms in
it, distinct and sorted, are hashed to 32 bits. The fingerprint joins those hashes; two fingerprints are as alike as
the weighted share of equal ones among the lexicons of which either document has a term.

Defined cases: the band begins at two documents, and ends at four, where the shares are less; null text counts as empty; a
text without any term of the band uses all its terms; a text without
terms has the fingerprint of no terms, alike 1 to another such and 0 to the rest; very long texts are taken whole; null doc_ids come
after all others, and rows of equal doc_id sort by text; the next document of a single one is itself; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import materialize, text_of

LOW_SHARE, HIGH_SHARE = 0.002, 0.01
#: Lexicon i keeps a share of 2 ** -HALVINGS[i] of the terms.
HALVINGS = (1, 1, 2, 2, 3, 3, *[4] * 4, *[5] * 4, *[6] * 4, *[7] * 4, *[8] * 6)
LEXICONS = len(HALVINGS)
SEEDS = (1_000, 2_000)
#: The hash of no terms: XXH64 of an empty array is its seed.
EMPTY = 42


def terms(text: Column) -> Column:
    """Hashes of the distinct terms, sorted."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def lexicon(hashed: DataFrame) -> DataFrame:
    """h of the terms within the band. hashed: t, the sorted distinct hashes of each document."""
    n = hashed.count()  # counts rows only: no column is read
    df = hashed.select(F.explode("t").alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    return materialize(df.filter((F.col("df") >= max(2, int(n * LOW_SHARE))) & (F.col("df") <= max(4, int(n * HIGH_SHARE)))).select("h"), "lexicon")


def lookup(lex: DataFrame) -> tuple[int, Column]:
    """The lexicon as a mask and a hash table: an ARRAY<ARRAY<BIGINT>> literal of the hashes by their low bits, about two in
    a slot. A literal stays out of the rows, unlike a column of a joined table."""
    n = max(1, lex.count())
    slots = 1 << max(4, (n // 2).bit_length())
    table = [[] for _ in range(slots)]
    for (h,) in lex.orderBy("h").collect():
        table[h & (slots - 1)].append(h)
    return slots - 1, F.from_json(F.lit(json.dumps(table, separators=(",", ":"))), "array<array<bigint>>")


def in_band(df: DataFrame, t: str, lex: tuple[int, Column]) -> DataFrame:
    """df with its column t, of sorted hashes, cut down to the lexicon, unless nothing would be left."""
    mask, table = lex
    held = F.filter(t, lambda h: F.array_contains(F.element_at(table, (h.bitwiseAND(F.lit(mask)) + 1).cast("int")), h))
    return df.withColumn("_held", held).withColumn(t, F.when(F.size("_held") > 0, F.col("_held")).otherwise(F.col(t))).drop("_held")


def member(p: Column, i: int) -> Column:
    """Whether lexicon i keeps the term; p: its hash h and two more hashes, m0 and m1, of which i has its own 16 bits."""
    share = 1 << HALVINGS[i]
    field = F.shiftright(p[f"m{i // 4 % 2}"], i % 4 * 16).bitwiseAND(F.lit(share - 1))
    return field == (i * 37 + 11) % share


def hashes(kept: Column) -> Column:
    """ARRAY<BIGINT> of LEXICONS 32-bit hashes, EMPTY where the document has no term of the lexicon."""
    pairs = F.transform(kept, lambda h: F.struct(h.alias("h"), *[F.xxhash64(h, F.lit(s)).alias(f"m{k}") for k, s in enumerate(SEEDS)]))
    one = lambda i, ps: F.xxhash64(F.filter(ps, lambda p: member(p, i))).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.get(F.transform(F.array(pairs), lambda ps: F.array(*[one(i, ps) for i in range(LEXICONS)])), F.lit(0))


def fingerprint(hs: Column) -> Column:
    return F.array_join(F.transform(hs, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes where either has one, smaller lexicons weighing more by the terms that they leave out."""
    weights = F.lit([1 << k for k in HALVINGS])
    both = F.zip_with(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), weights, lambda p, w: F.struct(F.when((p["x"] == p["y"]) & (p["x"] != EMPTY), w).otherwise(0).alias("same"), F.when((p["x"] != EMPTY) | (p["y"] != EMPTY), w).otherwise(0).alias("any")))
    sums = F.aggregate(both, F.struct(F.lit(0).alias("same"), F.lit(0).alias("any")), lambda acc, x: F.struct((acc["same"] + x["same"]).alias("same"), (acc["any"] + x["any"]).alias("any")))
    return F.when(sums["any"] > 0, sums["same"] / sums["any"]).otherwise(F.lit(1.0)).cast("double")


def _bounds(docs: DataFrame) -> list[int]:
    """Cuts of doc_id into about even ranges, one a shuffle partition or more."""
    parts = 2 * max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / parts for i in range(1, parts)], 100 * parts)).first()[0]
    return sorted(set(cuts or []))


def _range_of(x: Column, cuts: list[int]) -> Column:
    """How many cuts are at most x, by two steps of about the square root of their number."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    upto = lambda a: F.size(F.filter(a, lambda c: c <= x))
    group = F.greatest(upto(F.lit([g[0] for g in groups]).cast("array<bigint>")) - 1, F.lit(0))
    inside = F.get(F.array(*[F.lit(g).cast("array<bigint>") for g in groups]), group)
    return group * step + upto(inside)


def with_next(docs: DataFrame, known) -> DataFrame:
    """doc_id, text, f and the same of the next document in descending doc_id (the first's for the last), as nxt.
    docs: doc_id, text; known adds f. Rows meet in ranges of doc_id; of every range only its first row goes to the
    range before it."""
    part = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_range_of(F.col("doc_id"), _bounds(docs)))
    rows = docs.withColumn("part", part)
    w = Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), "text")
    firsts = materialize(rows.groupBy("part").agg(F.min_by("text", F.struct(F.bitwise_not("doc_id"), "text")).alias("text")), "firsts")
    ring = Window.orderBy(F.desc("part"))  # one row a range
    after = firsts.select(F.col("part").alias("_p"), F.coalesce(F.lead("part").over(ring), F.max("part").over(Window.partitionBy())).alias("_follows"))
    heads = known(firsts).withColumnRenamed("part", "_first").join(after, F.col("_first") == F.col("_follows")).select("_p", F.struct("text", "f").alias("_head"))
    rows = known(rows).withColumn("nxt", F.lead(F.struct("text", "f")).over(w))
    rows = rows.join(heads, F.col("nxt").isNull() & (F.col("part") == F.col("_p")), "left")
    return rows.select("doc_id", "text", "f", F.coalesce("nxt", "_head").alias("nxt"))


def edited(text: Column, other: Column) -> Column:
    """The last half of text replaced by as many code points from the start of other, or all it has."""
    n = F.length(text)
    cut = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - cut), F.substr(other, F.lit(1), cut))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    lex = lookup(lexicon(rows.select(terms(F.col("text")).alias("t"))))

    def hashed(df: DataFrame, name: str, text: str) -> DataFrame:
        return in_band(df.withColumn("t", terms(F.col(text))), "t", lex).withColumn(name, hashes(F.col("t"))).drop("t")

    known = with_next(rows, lambda df: hashed(df, "f", "text")).withColumn("edited", edited(F.col("text"), F.col("nxt.text")))
    known = hashed(known, "fe", "edited")
    return known.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("f")).alias("fingerprint"), fingerprint(F.col("fe")).alias("edited_fingerprint"), likeness(F.col("f"), F.col("fe")).alias("near_edited"), likeness(F.col("f"), F.col("nxt.f")).alias("near_next"))
