"""SimHash near-duplicates, linked exactly through vantage-point trees.

Equal fingerprints are one point. A tree over a bounded sample of points splits the space by Hamming distance from
vantage points into shards of about SHARD points; each point lives in one shard and also visits every shard with a
higher number that a ball of the radius around it overlaps (triangle bounds). Within a shard, dealt out in blocks, the
same pruning goes on down to small leaves, which are compared in blocks. A shard emits a spanning forest of its links rather than all
of them, and alternating stars join the forests. Whatever the sample, every pair within the radius meets.

Defined cases: null text counts as empty; texts without words have fingerprint zero and link like any other; very long
texts are read whole; repeated rows are rows of one group, of which near_dedup keeps one; null doc_ids are never the
smallest unless a component has no other; an empty table gives no rows; other columns are ignored or carried along.
Hot fingerprints and large components meet in joins on one key, which Spark's adaptive skew join splits.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import first_of_groups, materialize, text_of, tidied, tidy
from quarry.llm.components import connected_components

WORDS = 4
SEED = 42
RADIUS = 4
SHARD = 65_536
SAMPLE = 8_192
LEAF = 96
BLOCK = 1 << 21
#: Points of a shard, and points that ask it, that one task holds.
OWN, ASK = 65_536, 32_768
#: Characters that bytes.split() takes for white space: a text of nothing else has no words.
EMPTY = re.compile(r"[\x20\x09-\x0D]*")


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 of the shingles in order, repeats included: the whole sequence where it is shorter."""
    found = text.encode().lower().split()
    joined = b" ".join(found)
    xx = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([xx(joined, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends]
    return np.array([xx(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :])], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set where over half of the hashes have it."""
    ones, hashes = np.zeros(64, np.int64), hashes.astype("<u8", copy=False)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = WORDS) -> int:
    """The majority bits of a text's shingles; 0 without words."""
    return majority(shingle_hashes(text, words)) if not EMPTY.fullmatch(text) else 0


def _fingerprints(batches):
    for b in batches:
        fps = np.array([fingerprint(x or "") for x in b.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(tidied(_fingerprints), "doc_id long, fp long")


def distance(points: np.ndarray, v) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(v)).astype(np.int16)


def _vantage(points: np.ndarray, rng) -> tuple[int, int, np.ndarray]:
    """Of a few points, the one whose median shell has the fewest points near its boundary."""
    best = None
    for v in rng.choice(points, size=min(8, len(points)), replace=False):
        d = distance(points, v)
        mu = int(np.median(d))
        near = int(((d > mu - RADIUS) & (d <= mu + RADIUS)).sum())
        if best is None or near < best[0]:
            best = (near, int(v), mu, d)
    return best[1:]


def build_tree(sample: np.ndarray, shards: int) -> list[tuple]:
    """Nodes (vantage, mu, inner, outer), or (shard,) at leaves; node 0 is the root. sample: distinct uint64."""
    rng, nodes, count = np.random.default_rng(7), [], 0

    def grow(points: np.ndarray, want: int) -> int:
        nonlocal count
        at = len(nodes)
        nodes.append(None)
        if want > 1 and len(points) > 1:
            v, mu, d = _vantage(points, rng)
            if (d <= mu).any() and (d > mu).any():
                inner = grow(points[d <= mu], want // 2)
                nodes[at] = (v, mu, inner, grow(points[d > mu], want - want // 2))
                return at
        nodes[at] = (count,)
        count += 1
        return at

    grow(sample, shards)
    return nodes


def route(nodes: list[tuple], points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of a point, shard, and whether it lives there, for each point and shard that it lives in or visits."""
    out = []

    def go(at: int, idx: np.ndarray, home: np.ndarray) -> None:
        node = nodes[at]
        if not len(idx):
            return
        if len(node) == 1:
            out.append((idx, np.full(len(idx), node[0], np.int32), home))
            return
        v, mu, inner, outer = node
        d = distance(points[idx], v)
        a, b = d <= mu + RADIUS, d > mu - RADIUS
        go(inner, idx[a], home[a] & (d[a] <= mu))
        go(outer, idx[b], home[b] & (d[b] > mu))

    go(0, np.arange(len(points)), np.ones(len(points), bool))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool)
    idx, shard, home = (np.concatenate(x) for x in zip(*out))
    lives = np.empty(len(points), np.int32)
    lives[idx[home]] = shard[home]
    use = home | (shard > lives[idx])
    return idx[use], shard[use], home[use]


class Forest:
    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            for x, y in zip(a[:512].tolist(), b[:512].tolist()):
                rx, ry = self.find(x), self.find(y)
                if rx != ry:
                    self.parent[max(rx, ry)] = min(rx, ry)
                    self.edges.append((x, y))
            a, b = a[512:], b[512:]
            if len(a) > 4096:  # most pairs of a dense group are joined by now
                root = self.parent
                while (root != root[root]).any():
                    root = root[root]
                self.parent = root.copy()
                keep = root[a] != root[b]
                a, b = a[keep], b[keep]


def spanning_links(points: np.ndarray, homes: int, radius: int = RADIUS, asks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """points: distinct uint64, the first `homes` live here, the others visit. A spanning forest, as index pairs, of
    the links between a point that lives here and one of asks (indices; all points, if not given)."""
    forest, rng = Forest(len(points)), np.random.default_rng(11)

    def leaf(own: np.ndarray, ask: np.ndarray) -> None:
        p = points[own]
        step = max(1, BLOCK // max(1, len(own)))
        for i in range(0, len(ask), step):
            part = ask[i : i + step]
            q, o = np.nonzero(np.bitwise_count(points[part][:, None] ^ p[None, :]) <= radius)
            a, b = part[q], own[o]
            far = a != b
            forest.add(a[far], b[far])

    stack = [(np.arange(homes), np.arange(len(points)) if asks is None else asks)]
    while stack:
        own, ask = stack.pop()
        if not len(own) or not len(ask):
            continue
        if len(own) <= LEAF:
            leaf(own, ask)
            continue
        v, mu, d = _vantage(points[own], rng)
        if (d <= mu).all():
            leaf(own, ask)
            continue
        dq = distance(points[ask], v)
        stack.append((own[d <= mu], ask[dq <= mu + radius]))
        stack.append((own[d > mu], ask[dq > mu - radius]))
    return forest.edges


def _shard_links(t: pa.Table) -> pa.Table:
    fp, own = t.column("fp").to_numpy().view(np.uint64), t.column("own").to_numpy(zero_copy_only=False).astype(bool)
    homes = np.unique(fp[own])
    ask = np.unique(fp[~own])
    points = np.concatenate([homes, np.setdiff1d(ask, homes, assume_unique=True)])
    order = np.argsort(points)
    edges = np.array(spanning_links(points, len(homes), asks=order[np.searchsorted(points, ask, sorter=order)]), np.int64).reshape(-1, 2)
    tidy()
    return pa.table({"u": points[edges[:, 0]].view(np.int64), "v": points[edges[:, 1]].view(np.int64)})


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """distinct: fp. Links u, v that span the components of fingerprints within RADIUS bits. A shard's points, and
    those that ask it, are dealt out in blocks of about OWN and ASK; every block of points meets every block of askers
    in a task of its own, so that no task grows with the table, however uneven the shards are."""
    n = distinct.count()
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").collect()], np.int64).view(np.uint64)
    nodes = build_tree(sample, max(1, -(-n // SHARD)))

    def assign(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            idx, shard, home = route(nodes, fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[idx]), pa.array(home)], names=["shard", "fp", "home"])

    routed = materialize(distinct.select("fp").mapInArrow(assign, "shard int, fp long, home boolean"), "routed")
    # at most SAMPLE rows, one a leaf of the tree
    sizes = routed.groupBy("shard").agg(F.sum(F.col("home").cast("long")).alias("own"), F.count("*").alias("ask"))
    blocks = sizes.select("shard", F.ceil(F.greatest("own", F.lit(1)) / OWN).cast("int").alias("owns"), F.ceil(F.col("ask") / ASK).cast("int").alias("asks"))
    dealt = routed.join(F.broadcast(blocks), "shard")
    all_ = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.pmod(F.xxhash64("fp"), F.col("owns")).cast("int")
    ask = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("asks")).cast("int")
    owns = dealt.filter("home").select("shard", "fp", F.lit(True).alias("own"), own.alias("i"), F.explode(all_(F.col("asks"))).alias("j"))
    asks = dealt.select("shard", "fp", F.lit(False).alias("own"), F.explode(all_(F.col("owns"))).alias("i"), ask.alias("j"))
    return owns.unionByName(asks).groupBy("shard", "i", "j").applyInArrow(_shard_links, "u long, v long")


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (smallest doc_id that links reach)."""
    fps = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(link_fingerprints(distinct)).withColumnRenamed("u", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return fps.join(rooted.join(low, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """Of each group of near-duplicates one row of docs: that with the smallest doc_id."""
    rows = docs.select(F.xxhash64(text_of(docs)).alias("doc_id"), text_of(docs).alias("text"))
    roots = materialize(near_groups(rows).select(F.col("doc_id").alias("key"), F.col("component_id").alias("root")).distinct(), "roots")
    ids = docs.select("doc_id", F.xxhash64(text_of(docs)).alias("key")).groupBy("doc_id", "key").agg(F.count("*").alias("times"))
    return first_of_groups(docs, materialize(ids.join(roots, "key"), "rooted"))
