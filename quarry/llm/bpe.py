"""Byte-level BPE, encoded in length-bucketed padded numpy matrices and decoded again.

A text is cut by the tokenizer's pattern. Pieces a worker hasn't met lately go, by byte length, into padded matrices
of ids; in every round each row merges its leftmost pair of minimum rank, found by hashed pair lookup, and the
matrix is compacted by one column; rows without a pair are done. A row takes as many rounds as it has merges, each over its
whole width, so pieces beyond the widest bucket (4,096 bytes without a break of the pattern) merge the same pairs in the same
order by a heap, which costs n log n rather than n * n.

Defined cases: null text counts as empty, which has no ids; very long texts are encoded whole; strings that look
like special tokens are ordinary text; repeated rows are encoded alike; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import kept, text_of

WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, 512, 1024, 2048, 4096)
NONE = np.uint32(0xFFFFFFFF)
CACHE = 100_000
SLICE = 256
ROWS = 1 << 15
#: Ids of a matrix.
AREA = 1 << 22
#: White space that could join a cut at a space; wider than the pattern's own white space.
UNEVEN = re.compile(r"\s\s|^\s|\s$")


class PairTable:
    """Open-addressed hash table from (left id, right id) to the merged id, probed for whole arrays."""

    def __init__(self, pairs: dict[int, int], half: int):
        """half: bits of an id; a key is two ids."""
        self.half, self.key = half, np.uint32 if half == 16 else np.uint64
        self.free = self.key((1 << 2 * half) - 1)
        self.mix = self.key(2654435769 if half == 16 else 0x9E3779B97F4A7C15)
        self.bits = max(4, (2 * len(pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, self.free, self.key), np.full(1 << self.bits, NONE, np.uint32)
        keys, values = np.fromiter(pairs, self.key, len(pairs)), np.fromiter(pairs.values(), np.uint32, len(pairs))
        at, mask = self._slot(keys), (1 << self.bits) - 1
        left = np.arange(len(keys))
        while len(left):  # each round, one key for every free slot
            free = left[self.keys[at[left]] == self.free]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.mix) >> self.key(2 * self.half - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(self.key) << self.key(self.half)) | right
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], NONE)
        rest = np.nonzero((held != keys) & (held != self.free))
        mask = (1 << self.bits) - 1
        while len(rest[0]):
            slot = (at[rest] + 1) & mask
            at[rest] = slot
            held, want = self.keys[slot], keys[rest]
            hit = held == want
            out[tuple(x[hit] for x in rest)] = self.values[slot[hit]]
            go = ~hit & (held != self.free)
            rest = tuple(x[go] for x in rest)
        return out


class ByteBPE:
    """ranks: token bytes to id, lower merges first, as in a .tiktoken file. Ids of 16 bits where all fit, else of 32;
    the largest number pads. Every byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        lacking = [b for b in range(256) if bytes([b]) not in ranks]
        if lacking:
            raise ValueError(f"bytes without a token: {lacking}")
        self.half = 16 if max(ranks.values()) < 0xFFFF else 32
        self.id_type, self.pad = (np.uint16, 0xFFFF) if self.half == 16 else (np.uint32, 0xFFFFFFFF)
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.table = PairTable({(ranks[t[:k]] << self.half) | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}, self.half)
        self.first = np.array([ranks[bytes([b])] for b in range(256)], self.id_type)
        self.pieces: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}

    def encode_matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.full((len(pieces), width), self.pad, self.id_type)
        ids[np.arange(width) < lengths[:, None]] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.table.get(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(len(pieces)), [None] * len(pieces)
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            done = best == NONE
            for r, line, n in zip(rows[done].tolist(), ids[done].tolist(), lengths[done].tolist()):
                out[r] = line[:n]
            go = ~done
            rows, ids, ranks, at, best, lengths = rows[go], ids[go], ranks[go], at[go], best[go], lengths[go] - 1
            if not len(rows):
                break
            line, n, w = np.arange(len(rows)), len(rows), ids.shape[1]
            ids[line, at] = best
            stay = np.ones((n, w), bool)
            stay[line, at + 1] = False
            ids = ids[stay].reshape(n, w - 1)
            stay = np.ones((n, w - 1), bool)
            stay[line, at] = False
            ranks = ranks[stay].reshape(n, w - 2)
            if w > 2:
                has = at < w - 2
                r = line[has]
                ranks[r, at[has]] = self.table.get(ids[r, at[has]], ids[r, at[has] + 1])
                has = at > 0
                r = line[has]
                ranks[r, at[has] - 1] = self.table.get(ids[r, at[has] - 1], ids[r, at[has]])
        return out

    def rank_of(self, left: int, right: int) -> int | None:
        return self.ranks.get(self.bytes_of[left] + self.bytes_of[right])

    def encode_long(self, piece: bytes) -> list[int]:
        ids = [int(self.first[b]) for b in piece]
        after, before, get = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)], self.rank_of
        first = self.table.get(np.array(ids[:-1], self.id_type), np.array(ids[1:], self.id_type)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != int(NONE)]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (q := get(ids[x], ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = [whole]
            elif len(p) > WIDTHS[-1]:
                out[i] = self.encode_long(p)
            else:
                by.setdefault(next(w for w in WIDTHS if len(p) <= w), []).append(i)
        for width, at in by.items():
            rows = min(ROWS, AREA // width)
            for k in range(0, len(at), rows):
                part = at[k : k + rows]
                for i, ids in zip(part, self.encode_matrix([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def cut(self, text: str) -> list[str]:
        """Chunks that the pattern cuts on its own: a space between two other characters always begins a match."""
        if not text or "\0" in text or UNEVEN.search(text):
            return self.pattern.findall(text)
        return text.replace(" ", "\0 ").split("\0")

    def encode_texts(self, texts: list[str]) -> list[list[tuple[int, str, bytes]]]:
        """For each text its chunks as (number of ids, ids joined by commas, decoded bytes). Chunks are remembered in
        two generations: a full one becomes the older one, and what is met again moves to the new one."""
        chunks = [self.cut(t) for t in texts]
        if len(self.pieces) > CACHE:
            self.pieces, self.older = {}, self.pieces
        known, older = self.pieces, self.older
        new = []
        for c in set(chain.from_iterable(chunks)).difference(known):
            if (had := older.get(c)) is not None:
                known[c] = had
            else:
                new.append(c)
        # a chunk of ASCII letters after a space is one match
        cuts = [[c] if c[0] == " " and c.isascii() and c[1:].isalpha() else self.pattern.findall(c) for c in new]
        pieces = list(set(chain.from_iterable(cuts)))
        ids = dict(zip(pieces, self.encode_pieces([p.encode() for p in pieces])))
        for c, x in zip(new, cuts):
            own = ids[x[0]] if len(x) == 1 else [i for p in x for i in ids[p]]
            known[c] = (len(own), ",".join(map(str, own)), self.decode(own))
        return [list(map(known.__getitem__, x)) for x in chunks]


def load_ranks(name: str) -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def tokenizer(name: str) -> ByteBPE:
    """One a worker process; the ranks are read where the tokenizers package is installed."""
    import public_tokenizers

    return kept(("bpe", name), lambda: ByteBPE(load_ranks(name), public_tokenizers.PATTERN))


def round_trip(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids_text (ids joined by commas), n_tokens, decoded (bytes) of every row."""

    def run(batches):
        bpe = tokenizer(ranks)
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                part = b.slice(k, SLICE)
                done = bpe.encode_texts([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([",".join([c[1] for c in x]) for x in done]), pa.array([sum([c[0] for c in x]) for x in done], pa.int64()), pa.array([b"".join([c[2] for c in x]) for x in done], pa.binary())],
                    names=["doc_id", "ids_text", "n_tokens", "decoded"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids_text string, n_tokens long, decoded binary")


def round_trip_digests(docs: DataFrame, ranks: str) -> DataFrame:
    """round_trip() with the ids and bytes as SHA-256 hex, taken in the worker: nothing long goes back to the JVM."""

    def run(batches):
        bpe = tokenizer(ranks)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                part = b.slice(k, SLICE)
                done = bpe.encode_texts([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([sum([c[0] for c in x]) for x in done], pa.int64()), pa.array([sha(",".join([c[1] for c in x]).encode()) for x in done]), pa.array([sha(b"".join([c[2] for c in x])) for x in done])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
