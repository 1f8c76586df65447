"""Near copies by exact likeness: texts whose sets of five-word shingles have a Jaccard index of at least 0.8.

Fingerprints of op5 over five words, linked through its vantage-point trees, give the first candidates; likeness
confirms them. At 0.8 fingerprints lie about ten bits apart, far beyond a radius at which triangle bounds still prune, so a
join of the shingle sets finds the others. Of two such sets, each holds one of the other's first shingles: in any order common to all texts, among the first
n - ceil(0.8 n) + 1 of n. The order puts shingles that a sample holds often last, so that few texts meet without
need. Texts that meet are paired where their sizes and the places of the shared shingle leave 0.8 possible; pairs
whose parity sketches differ in more bits than alike sets can are dropped (a bit is the parity of the shingles that
fall on it, so that sets differ in as many members at least): first by 256 bits that go with each posting of a shingle that
several texts hold, before a pair is made, then by as many bits as the sets have members. The others are confirmed on the whole sets. Large groups are joined first along paths (a text meets two others a
shingle), and afterwards only pairs across groups are left to try. No pair is missed, whatever the sample.

Defined cases: words are cut and lower-cased as in op5_simhash; fewer than WORDS words are one shingle, texts without
words one empty shingle, so that they are copies of each other; null text counts as empty; null doc_ids are never the
smallest unless a group has no other; of equal rows one stays; an empty table gives no rows. Shingles and texts are
told apart by 64-bit XXH64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import first_of_groups, kept, materialize, release, text_of, tidied, tidy, written
from quarry.llm.components import connected_components
from quarry.llm.simhash import link_fingerprints, majority, shingle_hashes

WORDS = 5
SAMPLE = 4_096
COMMON = 131_072
SHARD_BYTES = 4_000_000
BLOCK = 1 << 17
SLICE = 128
POSTING = "shingle long, key long, pos int"
FOLD = ["f0", "f1", "f2", "f3"]


def shingles(text: str) -> np.ndarray:
    """Distinct XXH64 of the five-word shingles, sorted."""
    return np.unique(shingle_hashes(text, WORDS))


def alike(shared, a, b):
    """Jaccard >= 0.8 of sets of a and b members with so many shared, in whole numbers."""
    return 9 * shared >= 4 * (a + b)


def possible(n1, p1, n2, p2):
    """Whether sets whose first shared shingle is at these places can be alike."""
    n1, p1, n2, p2 = (np.asarray(x, np.int64) for x in (n1, p1, n2, p2))
    return (5 * np.minimum(n1, n2) >= 4 * np.maximum(n1, n2)) & alike(np.minimum(n1 - p1, n2 - p2), n1, n2)


def sketch(h: np.ndarray) -> bytes:
    """Parities by the low bits of the shingles, one bit a shingle at least, in a power of two."""
    bits = max(64, 1 << (len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def fold(h: np.ndarray) -> np.ndarray:
    """Parities in 256 bits, as four numbers: small enough to go with every posting."""
    return np.packbits(np.bincount((h & np.uint64(255)).astype(np.int64), minlength=256) & 1, bitorder="little").view(np.int64)


def folds_allow(f: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of postings a and b, which ones' folds differ in no more bits than alike sets of their sizes can."""
    differ = np.bitwise_count(f[a] ^ f[b]).sum(axis=1, dtype=np.int64)
    return 9 * differ <= n[a].astype(np.int64) + n[b]


def sketches_differ(one: bytes, two: bytes) -> int:
    """A lower bound of the members that two sets don't share."""
    a, b = (np.frombuffer(x, np.uint64) for x in (one, two))
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def first_shingles(h: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The n - ceil(0.8 n) + 1 first in the order; h and common sorted, rank beside common."""
    take = len(h) - (4 * len(h) + 4) // 5 + 1
    if not len(common):
        return h[:take]
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    often = common[at] == h
    last = h[often][np.argsort(rank[at[often]])]
    return np.concatenate([h[~often], last])[:take]


def _slices(batches):
    """Few texts at a time: a text makes many shingles."""
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)


def _common(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, sorted, and their ranks by count."""
    step = min(16, max(1, n // SAMPLE))

    def cut(batches):
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t) for t in b.column(0).to_pylist()]).view(np.int64))], names=["shingle"])

    seen = rows.filter(F.pmod("key", F.lit(step)) == 0).select("text").mapInArrow(tidied(cut), "shingle long")
    often = seen.groupBy("shingle").count().filter("count > 3").orderBy(F.desc("count"), "shingle").limit(COMMON).collect()
    h = np.array([r[0] for r in reversed(often)], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], order


def _run_bounds(shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.nonzero(np.r_[True, shingle[1:] != shingle[:-1]])[0] if len(shingle) else np.empty(0, np.int64)
    return starts, np.diff(np.r_[starts, len(shingle)])


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(c).to_numpy() for c in names]


def _folds(t: pa.Table) -> np.ndarray:
    return np.stack(_columns(t, *FOLD), axis=1).view(np.uint64)


def _shared(t: pa.Table) -> pa.Table:
    """Postings of shingles that two texts hold at least, once a text."""
    shingle, key = _columns(t, "shingle", "key")
    order = np.lexsort((key, shingle))
    s, k = shingle[order], key[order]
    order = order[np.r_[True, (s[1:] != s[:-1]) | (k[1:] != k[:-1])]]
    size = _run_bounds(shingle[order])[1]
    return t.take(pa.array(order[np.repeat(size, size) > 1]))


def _tidy(work):
    """A function over a group that gives memory back before the next group."""

    def wrapped(t: pa.Table) -> pa.Table:
        kept(__name__)
        out = work(t)
        tidy()
        return out

    return wrapped


def _pairs(a, b) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])


def _paths(t: pa.Table) -> pa.Table:
    """Each run's texts in an order of its own; pairs of neighbours."""
    shingle, key, n, pos = _columns(t, "shingle", "key", "n", "pos")
    mixed = (key ^ shingle).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.lexsort((mixed ^ (mixed >> np.uint64(29)), shingle))
    s, k, n, p = shingle[order], key[order], n[order], pos[order]
    at = np.nonzero((s[1:] == s[:-1]) & possible(n[1:], p[1:], n[:-1], p[:-1]))[0]
    at = at[folds_allow(_folds(t)[order], n, at, at + 1)]
    return pa.Table.from_batches([_pairs(k[at + 1], k[at])])


def _across(t: pa.Table) -> pa.Table:
    """All possible pairs of each run whose texts are in different groups."""
    shingle, key, n, pos, root = _columns(t, "shingle", "key", "n", "pos", "root")
    order = np.lexsort((root, shingle))
    s, k, n, p, r, f = (x[order] for x in (shingle, key, n, pos, root, _folds(t)))
    out = [_pairs(k[:0], k[:0])]
    for at, size in zip(*_run_bounds(s)):
        if r[at] == r[at + size - 1]:
            continue
        step = max(1, BLOCK // int(size))
        run = np.arange(at, at + size)
        for i in range(0, size, step):
            mine = run[i : i + step]
            x, y = np.nonzero((r[mine][:, None] < r[run][None, :]) & possible(n[mine][:, None], p[mine][:, None], n[run][None, :], p[run][None, :]))
            x, y = mine[x], run[y]
            near = folds_allow(f, n, x, y)
            if near.any():
                out.append(_pairs(k[x[near]], k[y[near]]))
    whole = pa.Table.from_batches(out)
    return pa.Table.from_batches([_pairs(*_columns(whole, "u", "v"))])


def _sketched(batches):
    for b in batches:
        n1, n2, s1, s2 = (b.column(i).to_pylist() for i in range(2, 6))
        keep = [9 * sketches_differ(x, y) <= i + j for i, j, x, y in zip(n1, n2, s1, s2)]
        yield pa.RecordBatch.from_arrays(b.columns[:2], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _confirmed(pairs: DataFrame, sketches: DataFrame, rows: DataFrame, tag: str) -> DataFrame:
    """The pairs u, v that are alike."""
    def both(p: DataFrame, t: DataFrame, *cols: str) -> DataFrame:
        for side, i in (("u", 1), ("v", 2)):
            p = p.join(t.select(F.col("key").alias(side), *[F.col(c).alias(f"{c}{i}") for c in cols]), side)
        return p.select("u", "v", *[f"{c}{i}" for c in cols for i in (1, 2)])

    def whole(batches):
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).view(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["key", "h"])

    since = written()
    p = materialize(both(pairs.distinct(), sketches, "n", "sketch").mapInArrow(tidied(_sketched), "u long, v long"), f"{tag}-pairs")
    wanted = materialize(p.select(F.explode(F.array("u", "v")).alias("key")).distinct(), f"{tag}-wanted")
    sets = rows.select("key", "text").join(wanted, "key", "left_semi").mapInArrow(tidied(whole), "key long, h array<long>").dropDuplicates(["key"])
    likeness = alike(F.size(F.array_intersect("h1", "h2")), F.size("h1"), F.size("h2"))
    links = materialize(both(p, materialize(sets, f"{tag}-sets"), "h").filter(likeness).select("u", "v"), f"{tag}-links")
    release(since, last=1)
    return links


def _fingerprint_pairs(firsts: DataFrame) -> DataFrame:
    """Pairs of keys that span the groups of fingerprints within op5's radius, by its vantage-point trees; equal
    fingerprints along a star."""
    points = materialize(firsts.groupBy("fp").agg(F.min("key").alias("rep")), "points")
    links = link_fingerprints(points.select("fp"))
    for side in ("u", "v"):
        links = links.join(points.select(F.col("fp").alias(side), F.col("rep").alias(f"{side}_rep")), side)
    equal = firsts.select("key", "fp").join(points, "fp").filter("key != rep").select(F.least("key", "rep").alias("u"), F.greatest("key", "rep").alias("v"))
    return links.select(F.least("u_rep", "v_rep").alias("u"), F.greatest("u_rep", "v_rep").alias("v")).unionByName(equal)


def near_roots(rows: DataFrame) -> DataFrame:
    """rows: key, text. key and root (the smallest key of its group) of every text that is not its group's root.
    Tables are deleted as soon as nothing needs them."""
    since = written()
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    common, rank = _common(rows, n)

    def read(batches):
        for b in _slices(batches):
            all_ = [shingle_hashes(t, WORDS) for t in b.column(1).to_pylist()]
            bits = np.array([majority(h) for h in all_], np.uint64)
            sets = [np.unique(h) for h in all_]
            first = [first_shingles(h, common, rank).view(np.int64) for h in sets]
            folds = np.stack([fold(h) for h in sets], axis=1)
            columns = [b.column(0), pa.array([len(h) for h in sets], pa.int32()), pa.array([sketch(h) for h in sets], pa.binary()), pa.array(first, pa.list_(pa.int64())), pa.array(bits.view(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, folds)], names=["key", "n", "sketch", "first", "fp", *FOLD])

    firsts = materialize(rows.select("key", "text").mapInArrow(tidied(read), "key long, n int, sketch binary, first array<long>, fp long, f0 long, f1 long, f2 long, f3 long"), "firsts")
    shard = F.pmod(F.xxhash64("shingle"), F.lit(int(max(1, size // SHARD_BYTES))))
    postings = firsts.select("key", F.posexplode("first").alias("pos", "shingle")).select("shingle", "key", "pos")
    runs = materialize(postings.groupBy(shard).applyInArrow(_tidy(_shared), POSTING), "shared")
    # most shingles are one text's alone: sizes and folds meet the others only
    runs = materialize(runs.join(firsts.select("key", "n", *FOLD).dropDuplicates(["key"]), "key"), "runs")
    sketches = firsts.select("key", "n", "sketch").join(runs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    sketches = materialize(sketches, "sketches")
    paths = runs.groupBy(shard).applyInArrow(_tidy(_paths), "u long, v long")
    links = _confirmed(_fingerprint_pairs(firsts).unionByName(paths), sketches, rows, "path")
    release(since, keep=(runs, sketches, links))
    roots = connected_components(links).withColumnRenamed("u", "key")
    rooted = runs.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    more = _confirmed(rooted.groupBy(shard).applyInArrow(_tidy(_across), "u long, v long"), sketches, rows, "across")
    release(since, keep=(links, more))
    roots = connected_components(links.unionByName(more)).withColumnRenamed("u", "key")
    release(since, last=1)
    return roots


def near_dedup(docs: DataFrame) -> DataFrame:
    """Of each group of near copies one row of docs: that with the smallest doc_id."""
    since = written()
    rows = docs.select(F.col("doc_id"), F.xxhash64(text_of(docs)).alias("key"), text_of(docs).alias("text"))
    roots = near_roots(rows.select("key", "text"))
    ids = rows.groupBy("doc_id", "key").agg(F.count("*").alias("times"))
    rooted = materialize(ids.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "rooted")
    release(since, last=1)
    out, mine = first_of_groups(docs, rooted), written() - since - 1
    release(since, last=mine)
    return out
