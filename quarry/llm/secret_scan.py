"""Secret scan: fixed rules, and a character convolutional network over every candidate with its context.

Candidates are the rules' findings and every other run of token characters, of what findings leave of it, that has letters
and digits, or changes between small letters and capitals more than once. All of them are scored. The
network sees the characters around and inside a candidate: sums of per-character filters of width WIDTH, rectified,
the maximum over the context and over the candidate, and a logistic layer. It learns from the labelled findings of all
documents with the context of half the findings blanked, so that contents count as well. Distinct windows are dealt by hash into
blocks; in each of ROUNDS rounds every block takes its next steps from the common weights, and the results' mean are the next
common weights. A rare class goes to several blocks. Each window, but for the held-out quarter, is learned from EPOCHS times at least. Others are
prose and runs that are no candidates; candidates that the rules leave have no label and are not learned from, as secrets may
be among them. Scores are calibrated (Platt) on what is held out from learning, and the threshold is one half, or less
where less is needed to find RECALL of the held-out findings; every held-out window counts, by its log-odds in thousandths. Findings of the rules always stay; the network adds candidates at or above the threshold.

Defined cases: null text counts as empty; very long texts are scanned whole, and a long candidate is seen whole in
overlapping windows, of which the highest score counts; without enough labelled findings the rules alone hold; equal texts
have equal spans; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, release, text_of, tidied, written

#: Windows of the larger class in a block, about, and of the other one at least; labelled findings without which rules hold alone.
BLOCK, LEAST, FEWEST = 16_384, 512, 20
ROUNDS, EPOCHS, TREE = 4, 2, 64
#: Steps of log-odds in which held-out scores are counted.
FINE = 1_000
RECALL = 0.98
LEFT, INSIDE, RIGHT = 24, 48, 8
LENGTH = LEFT + INSIDE + RIGHT
WIDTH, FILTERS, STEPS, BATCH = 5, 24, 400, 128
SLICE = 512
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Characters of a candidate, and of a run that is learnt as none, at least.
SHORTEST, LONG = 12, 16
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
TURNS = re.compile(r"[a-z][A-Z].*[a-z][A-Z]")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
_CODE = np.full(128, 40, np.uint8)
for _i in range(26):
    _CODE[ord("a") + _i] = 1 + _i
    _CODE[ord("A") + _i] = 41 + _i
for _c, _k in zip("\"'=:+/_- \n.,@", range(28, 41)):
    _CODE[ord(_c)] = _k
_CODE[ord("0") : ord("9") + 1] = 27
#: 0 is beyond the text or blanked, 67 a character beyond ASCII.
CLASSES = 68


def findings(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """The rules' findings as (start, kind, end), sorted, and the other candidates: what they leave of runs."""
    low, out, runs = text.lower(), [], []
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    for m in RUN.finditer(text):
        run, at = m.group(), m.start()
        if "AKIA" in run:
            out += [(at + x.start(), 1, at + x.end()) for x in ACCESS.finditer(run) if x.end() - x.start() >= 20]
        if len(run) >= 24:
            out += [(at + x.start(), 2, at + x.end()) for x in HEX.finditer(run)]
        runs.append((at, m.end()))
    out.sort()
    return out, [(a, b) for run in runs for a, b in remaining(run, out) if candidate(text[a:b])]


def candidate(run: str) -> bool:
    if not any(c.isdigit() for c in run):
        return TURNS.search(run) is not None
    return any(c.isalpha() for c in run)


def remaining(run: tuple[int, int], found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a run outside all findings (sorted by start) that are long enough."""
    parts, (at, end) = [], run
    for s, _, e in found:
        if s < end and e > at:
            parts.append((at, s))
            at = max(at, e)
    return [(a, b) for a, b in [*parts, (at, end)] if b - a >= SHORTEST]


def window(text: str, start: int, end: int) -> np.ndarray:
    """Character classes: LEFT before, INSIDE of the candidate, RIGHT after it."""
    inside = text[start : min(end, start + INSIDE)]
    parts = (text[max(0, start - LEFT) : start].rjust(LEFT, "\0"), inside.ljust(INSIDE, "\0"), text[end : end + RIGHT].ljust(RIGHT, "\0"))
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    out = np.where(codes < 128, _CODE[np.minimum(codes, 127)], 67).astype(np.uint8)
    out[codes == 0] = 0
    return out


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Windows over the whole of a candidate, by half of INSIDE; the last ends where it ends."""
    starts = [*range(start, max(start + 1, end - INSIDE), INSIDE // 2), *([end - INSIDE] if end - start > INSIDE else [])]
    return [window(text, a, min(end, a + INSIDE)) for a in starts]


class Network:
    """Filters by character class and offset, two maxima a filter, a logistic layer."""

    def __init__(self, weights: list[np.ndarray]):
        self.table, self.bias, self.out, self.out_bias = weights

    def forward(self, x: np.ndarray):
        n = LENGTH - WIDTH + 1
        z = self.bias + sum(self.table[k][x[:, k : k + n]] for k in range(WIDTH))
        a = np.maximum(z, 0)
        cut = LEFT
        own = a[:, cut : cut + INSIDE - WIDTH + 1]
        around = np.concatenate([a[:, : cut - 1], a[:, cut + INSIDE - WIDTH + 1 :]], axis=1)
        i, j = own.argmax(axis=1), around.argmax(axis=1)
        j = np.where(j < cut - 1, j, j - (cut - 1) + cut + INSIDE - WIDTH + 1)
        i = i + cut
        rows, f = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        pooled = np.concatenate([a[rows, i, f], a[rows, j, f]], axis=1)
        return pooled, i, j, 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.out_bias, -30, 30)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[k : k + 1024])[3] for k in range(0, len(x), 1024)]) if len(x) else np.empty(0)


def start(seed: int = 5) -> list[np.ndarray]:
    """Four weights, and Adam's two moments of each."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 0.1, (WIDTH, CLASSES, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), np.zeros(1)]
    return w + [np.zeros_like(a) for a in w + w]


def turns(good: int, bad: int) -> int:
    """Steps of a block in a round: EPOCHS of its larger class in all rounds, and STEPS at least."""
    return -(-max(STEPS, EPOCHS * -(-max(good, bad) // (BATCH // 2))) // ROUNDS)


def steps(state: list[np.ndarray], good: np.ndarray, bad: np.ndarray, block: int, turn: int) -> list[np.ndarray]:
    """One round of Adam on the logistic loss with as many findings as others in a batch, each class in an order of
    its own that goes on where the round before ended."""
    w, m, v = ([a.copy() for a in state[k : k + 4]] for k in (0, 4, 8))
    rng = np.random.default_rng([5, block])
    orders, n, half = [(x, rng.permutation(len(x))) for x in (good, bad)], turns(len(good), len(bad)), BATCH // 2
    blanks = np.random.default_rng([5, block, turn])
    want = np.repeat([1, 0], half)
    for step in range(1, n + 1):
        at = np.arange((turn * n + step - 1) * half, (turn * n + step) * half)
        part = np.concatenate([x[order[at % len(x)]] for x, order in orders])
        part[blanks.random(BATCH) < 0.5, :LEFT] = 0
        net = Network(w)
        pooled, i, j, p = net.forward(part)
        err = (p - want) / BATCH
        grads = [np.zeros_like(w[0]), None, pooled.T @ err, np.array([err.sum()])]
        back = err[:, None] * w[2][None, :] * (pooled > 0)
        f = np.broadcast_to(np.arange(FILTERS), i.shape)
        for pos, g in ((i, back[:, :FILTERS]), (j, back[:, FILTERS:])):
            for k in range(WIDTH):
                np.add.at(grads[0][k], (part[np.arange(BATCH)[:, None], pos + k], f), g)
        grads[1] = back[:, :FILTERS].sum(axis=0) + back[:, FILTERS:].sum(axis=0)
        for q in range(4):
            m[q] = 0.9 * m[q] + 0.1 * grads[q]
            v[q] = 0.999 * v[q] + 0.001 * grads[q] ** 2
            w[q] = w[q] - 0.01 * (m[q] / (1 - 0.9 ** (turn * n + step))) / (np.sqrt(v[q] / (1 - 0.999 ** (turn * n + step))) + 1e-8)
    return w + m + v


def calibration(scores: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> tuple[float, float]:
    """Platt's slope and offset on the log-odds, with his smoothed targets, by damped Newton steps. times: how often each
    score stands for one."""
    n = np.ones(len(y)) if times is None else times.astype(np.float64)
    z, good, bad = log_odds(scores), n[y == 1].sum(), n[y == 0].sum()
    want = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x, w = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])

    def loss(w):
        t = x @ w
        return float((n * (np.logaddexp(0, t) - want * t)).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (n * (p - want)))
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    return max(float(w[0]), 1e-6), float(w[1])


def log_odds(scores: np.ndarray) -> np.ndarray:
    p = np.clip(np.asarray(scores, np.float64), 1e-13, 1 - 1e-13)
    return np.log(p) - np.log1p(-p)


def calibrated(model: dict, scores: np.ndarray) -> np.ndarray:
    """Probabilities from the network's scores; the order stays."""
    slope, offset = model["calibration"]
    return 1 / (1 + np.exp(-np.clip(slope * log_odds(scores) + offset, -30, 30)))


def ordinary(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans that are no candidates: other long runs, and three stretches of prose."""
    spans = [m.span() for m in RUN.finditer(text) if len(m.group()) >= LONG and not any(c.isdigit() for c in m.group()) and not candidate(m.group())]
    for part in (1, 2, 3):
        k = len(text) * part // 4
        words = text[k : k + 16 + (k * 7919 + part) % 33]
        if words and not any(c.isdigit() for c in text[max(0, k - LEFT) : k + len(words) + RIGHT]):  # digits may be of a candidate
            spans.append((k, k + len(words)))
    return [(a, b) for a, b in spans if not any(s < b + RIGHT and a - LEFT < e for s, _, e in found)]  # nor in the window


def _labelled(batches):
    """The distinct windows of a task's findings and others, as far as a slice of rows shows."""
    for b in batches:
        for k in range(0, b.num_rows, SLICE):
            got = set()
            for t in b.column(0).slice(k, SLICE).to_pylist():
                found, _ = findings(t)
                values = [ASSIGN.match(t, s).span(2) for s, k, _ in found if k == 0]  # contents without the keyword
                values = [(s, e) for s, e in values if e - s >= 16 and any(c.isdigit() for c in t[s:e])]
                got |= {(window(t, s, e).tobytes(), 1) for s, e in [(s, e) for s, _, e in found] + values}
                got |= {(window(t, s, e).tobytes(), 0) for s, e in ordinary(t, found)}
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.binary()), pa.array([y for _, y in got], pa.int32())], names=["x", "y"])


def _packed(t: pa.Table) -> pa.Table:
    """A block's windows, learned from and held out, findings and others, each sorted and put together."""
    parts: dict[tuple, list[bytes]] = {(h, y): [] for h in (False, True) for y in (1, 0)}
    for h, y, x in zip(*(t.column(c).to_pylist() for c in ("held", "y", "x"))):
        parts[h, y].append(x)
    columns = [pa.array([b"".join(sorted(x))], pa.binary()) for x in parts.values()]
    return pa.Table.from_arrays([pa.array([t.column("block")[0].as_py()], pa.int32()), *columns], names=["block", "good", "bad", "held_good", "held_bad"])


def _blocks(docs: DataFrame) -> DataFrame | None:
    """The windows of all rows of docs in blocks, one row each."""
    since = written()
    seen = docs.select(text_of(docs).alias("text")).mapInArrow(tidied(_labelled), "x binary, y int").distinct()
    seen = materialize(seen.withColumn("held", F.pmod(F.xxhash64("x", F.lit(1)), F.lit(4)) == 3), "windows")
    n = {(r["held"], r["y"]): r["count"] for r in seen.groupBy("held", "y").count().collect()}
    learned, held = ([n.get((h, y), 0) for y in (0, 1)] for h in (False, True))
    if min(a + b for a, b in zip(learned, held)) < FEWEST or not min(learned + held):
        return None
    blocks = -(-max(learned) // BLOCK)
    copies = [min(blocks, -(-LEAST * blocks // k)) for k in learned]
    times = F.when(F.col("held"), 1).when(F.col("y") == 1, copies[1]).otherwise(copies[0])
    home = F.pmod(F.xxhash64("x", F.lit(2)), F.lit(blocks))
    dealt = seen.select("x", "y", "held", F.explode(F.sequence(F.lit(0), times - 1)).alias("block")).withColumn("block", F.pmod(home + F.col("block"), F.lit(blocks)).cast("int"))
    out = materialize(dealt.groupBy("block").applyInArrow(_packed, "block int, good binary, bad binary, held_good binary, held_bad binary"), "blocks")
    release(since, last=1)
    return out


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint8).reshape(-1, LENGTH)


def _mean(blocks: DataFrame, w: list[np.ndarray], turn: int) -> list[np.ndarray]:
    """The mean of the weights and moments to which the blocks come from w, summed in the order of the blocks, TREE at a time."""

    def learn(batches):
        for b in batches:
            for i in range(b.num_rows):
                block, good, bad = (b.column(c)[i].as_py() for c in range(3))
                if good and bad:  # else hashes left a class of few windows out here
                    new = np.concatenate([a.ravel() for a in steps(w, _unpacked(good), _unpacked(bad), block, turn)])
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([new.tobytes()], pa.binary())], names=["block", "w"])

    def add(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("block").to_pylist(), t.column("w").to_pylist()))
        total = sum(np.frombuffer(x) for _, x in rows)
        return pa.table({"first": pa.array([rows[0][0]], pa.int32()), "n": pa.array([len(rows)], pa.int32()), "w": pa.array([total.tobytes()], pa.binary())})

    new = blocks.select("block", "good", "bad").mapInArrow(tidied(learn), "block int, w binary")
    sums = sorted(tuple(r) for r in new.groupBy(F.floor(F.col("block") / TREE).alias("part")).applyInArrow(add, "first int, n int, w binary").collect())
    flat = sum(np.frombuffer(bytes(x)) for _, _, x in sums) / sum(k for _, k, _ in sums)
    return [a.reshape(b.shape) for a, b in zip(np.split(flat, np.cumsum([b.size for b in w])[:-1]), w)]


def _held_scores(blocks: DataFrame, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of all held-out windows in FINE steps, rounded down, their labels and counts; no more rows than steps."""

    def score(batches):
        net = Network(weights)
        for b in batches:
            for c, y in ((0, 1), (1, 0)):
                for x in b.column(c).to_pylist():
                    z, n = np.unique(np.floor(log_odds(net.score(_unpacked(x))) * FINE).astype(np.int32), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(np.full(len(z), y, np.int32)), pa.array(n.astype(np.int64))], names=["z", "y", "n"])

    got = blocks.select("held_good", "held_bad").mapInArrow(tidied(score), "z int, y int, n long").groupBy("z", "y").agg(F.sum("n").alias("n"))
    z, y, n = np.array(sorted(tuple(r) for r in got.collect()), np.int64).T
    return z, y, n


def train(docs: DataFrame) -> dict | None:
    """Weights and threshold from all rows of docs, or None where they have too few labelled findings."""
    since = written()
    try:
        blocks = _blocks(docs)
        if blocks is None:
            return None
        w = start()
        for turn in range(ROUNDS):
            w = _mean(blocks, w, turn)
        weights = [a.astype(np.float32) for a in w[:4]]
        z, y, n = _held_scores(blocks, weights)
    finally:
        release(since)
    scores = 1 / (1 + np.exp(-z / FINE))
    model = {"weights": weights, "calibration": calibration(scores, y, n)}
    own, many = scores[y == 1], np.cumsum(n[y == 1])  # z ascends
    lowest = own[np.searchsorted(many, int(np.floor(many[-1] * (1 - RECALL))), side="right")]
    return model | {"threshold": min(0.5, float(calibrated(model, np.array([lowest]))[0]))}


def spans_of(texts: list[str], model: dict | None) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], float | None]]:
    """For each text the rules' findings, all spans, both sorted by start and kind, and the least score of a finding."""
    got = [findings(t) for t in texts]
    where = [(i, a, b, k) for i, (base, rest) in enumerate(got) for a, k, b in base + [(a, 3, b) for a, b in rest]]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    least: list[float | None] = [None for _ in texts]
    if model and where:
        seen = [windows(texts[i], a, b) for i, a, b, _ in where]
        p = calibrated(model, Network(model["weights"]).score(np.stack([w for x in seen for w in x])))
        best = np.maximum.reduceat(p, np.cumsum([0, *map(len, seen[:-1])]))
        for (i, a, b, k), q in zip(where, best.tolist()):
            if k < 3:
                least[i] = q if least[i] is None else min(q, least[i])
            elif q >= model["threshold"]:
                added[i].append((a, 3, b))
    return [(base, sorted(base + more), low) for (base, _), more, low in zip(got, added, least)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (kind:start:end, comma-joined, in code points, end exclusive) of every row, and least_score,
    the lowest probability that the network gives a finding of the rules (null without any, or without a network)."""
    model = train(docs)

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                part = b.slice(k, SLICE)
                done = spans_of(part.column(1).to_pylist(), model)
                columns = [pa.array([joined(x[i]) for x in done], pa.string()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array([x[2] for x in done], pa.float64())], names=["doc_id", "base", "spans", "least_score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, base string, spans string, least_score double")


def scan_digests(docs: DataFrame) -> DataFrame:
    """scan() with counts of the spans by kind and the digest of the rules' spans."""
    out = scan(docs)
    n = lambda k: F.size(F.filter(F.split("spans", ","), lambda x: x.startswith(f"{k}:"))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[n(k) for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", F.round("least_score", 6).alias("least_score"))
