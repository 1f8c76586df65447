"""Sharding by histogram sort, in DataFrame functions only.

Rows sort by (hash of the text, doc_id), so equal texts are neighbours. Splitters between shards are found by
probing: each round counts exactly the bytes below evenly spaced key boundaries inside the interval that still holds
each splitter, over all partitions, and goes on within the cell where the target lies, first through the bits of
the hash and then, inside a group of equal texts that is too large for the tolerance, through doc_id. The driver sees
SHARDS x PROBES counts a round. When all splitters are within tolerance, or at a single key, rows are exchanged once.

Slots count through the ranges of the hash, a range's parts (by a hash of doc_id, in number as its rows need) and, in a
part, (hash, doc_id, checksum); a part is small, however many rows or copies a range has.

Defined cases: null text has size 1 (no bytes, plus 1) and the checksum of the empty text; null doc_id sorts as the
smallest; very long texts count whole; ties are repeated rows, which count each and get slots of their own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import materialize, text_of

SHARDS = 16
PROBES = 256
#: Of a shard's fair share, how far a splitter may be off. A group of equal texts is cut only beyond it.
TOLERANCE = 0.005
#: Ranges of the hash in which slots are counted, and the rows that a part of one is meant to hold.
CELLS = 1 << 16
PART = 1_024
LOW, HIGH = -(1 << 63), 1 << 63


def keyed(docs: DataFrame) -> DataFrame:
    text = text_of(docs)
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("k"))


def _probe(rows: DataFrame, key: str, cells: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int]]]:
    """cells: (splitter, from, to) of a key's values, `to` exclusive. Per splitter the bytes in each of its even
    probes that has any: (number of the probe, bytes)."""
    at = F.lit(None).cast("struct<c:int,p:int>")
    unique = sorted({(lo, hi) for _, lo, hi in cells})  # equal or disjoint: a row is in one of them at most
    for c, (lo, hi) in enumerate(unique):
        step = -(-(hi - lo) // PROBES)
        if hi - lo < 1 << 62:
            probe = f"({key} - ({lo}L)) div {step}L"
        else:  # offsets don't fit a long
            probe = f"(cast({key} as decimal(20,0)) - cast('{lo}' as decimal(20,0))) div cast('{step}' as decimal(20,0))"
        inside = (F.col(key) >= F.lit(lo)) & (F.col(key) <= F.lit(hi - 1))
        at = F.when(inside, F.struct(F.lit(c).alias("c"), F.expr(probe).cast("int").alias("p"))).otherwise(at)
    hits = rows.select("size", at.alias("x")).filter("x is not null")
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for c, p, n in hits.groupBy("x.c", "x.p").agg(F.sum("size")).collect():
        found.setdefault(unique[c], []).append((p, n))
    return {s: sorted(found.get((lo, hi), [])) for s, lo, hi in cells}


def splitters(rows: DataFrame, shards: int = SHARDS) -> list[tuple[int, int]]:
    """Keys (h, k) at which shards 1, 2, ... begin; a shard holds the keys from its own splitter up to the next."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = total / shards * TOLERANCE
    found: dict[int, tuple[int, int]] = {}

    def refine(data: DataFrame, key: str, open_: dict[int, tuple[int, int, int]], settle) -> dict[int, tuple[int, int, int]]:
        """open_: splitter to (from, to, bytes below from). Ends with cells of a single key."""
        single: dict[int, tuple[int, int, int]] = {}
        while open_:
            lows, highs = min(a for a, _, _ in open_.values()), max(b for _, b, _ in open_.values())
            counts = _probe(data.filter((F.col(key) >= F.lit(lows)) & (F.col(key) <= F.lit(highs - 1))), key, [(s, a, b) for s, (a, b, _) in open_.items()])
            after = {}
            for s, (a, b, below) in open_.items():
                step, want = -(-(b - a) // PROBES), total * s / shards
                cell = (b, b, below)
                for p, n in counts.get(s, ()):
                    lo = a + p * step
                    if abs(below - want) <= slack:
                        cell = (lo, lo, below)
                        break
                    if below + n > want + slack:
                        cell = (lo, min(b, lo + step), below)
                        break
                    below += n
                    cell = (min(b, lo + step), min(b, lo + step), below)
                a, b, below = cell
                if b - a == 0:
                    settle(s, a)
                elif b - a == 1:
                    single[s] = cell
                else:
                    after[s] = cell
            open_ = after
        return single

    def at_hash(s: int, h: int) -> None:
        found[s] = (h, LOW)

    if not total:
        return [(HIGH, LOW)] * (shards - 1)
    inside = refine(rows, "h", {s: (LOW, HIGH, 0) for s in range(1, shards)}, at_hash)
    for h in {a for a, _, _ in inside.values()}:
        group = rows.filter(F.col("h") == F.lit(h))
        own = {s: c for s, c in inside.items() if c[0] == h}

        def at_id(s: int, k: int, h=h) -> None:
            found[s] = (h, k) if k < HIGH else (h + 1, LOW)

        lo, hi = group.agg(F.min("k"), F.max("k")).first()
        one = refine(group, "k", {s: (lo, hi + 1, below) for s, (_, _, below) in own.items()}, at_id)
        for s, (k, _, _) in one.items():
            at_id(s, k + 1)
    return [found[s] for s in range(1, shards)]


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row. Shards hold near equal bytes; slots are gapless from 0."""
    rows = materialize(keyed(docs), "keys")
    shard = F.lit(0)
    for h, k in splitters(rows, shards):
        if h < HIGH:
            shard = shard + F.when((F.col("h") > F.lit(h)) | ((F.col("h") == F.lit(h)) & (F.col("k") >= F.lit(k))), 1).otherwise(0)
    placed = rows.withColumn("shard", shard)
    # slots by prefix sums over cells of the key, so that a shard needn't be sorted in one task
    cell = placed.withColumn("cell", F.shiftright("h", 64 - CELLS.bit_length() + 1))
    # CELLS rows at most
    parts = cell.groupBy("cell").agg(F.ceil(F.count("*") / PART).alias("parts"))
    cell = cell.join(F.broadcast(parts), "cell").withColumn("salt", F.pmod(F.xxhash64("k"), F.col("parts"))).drop("parts")
    counts = cell.groupBy("shard", "cell", "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("cell", "salt")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("shard", "cell", "salt").orderBy("h", "k", "text_crc32"))
    slots = cell.withColumn("rank", rank).join(before, ["shard", "cell", "salt"]).withColumn("slot", F.col("before") + F.col("rank") - 1)
    return slots.select("doc_id", "size", "text_crc32", "shard", "slot")
