"""Toxicity by Levenshtein automata over a learnt lexicon, with context windows.

Training looks at a bounded sample of labelled rows (TRAIN_ROWS a class). A term enters the lexicon if toxic documents
hold it far more often than clean ones, beyond chance, and after many different words: a word that is frequent
only because a passage was copied has always the same word before it. Stems whose many completions behave like that
enter as prefixes. Scoring walks every word of a text through the product of the Levenshtein automata with the
lexicon trie, made deterministic as it goes, so misspelled terms are found too; words with digits or symbols between
their letters walk through a product that allows edits from four letters on. A misspelling is spared, whoever wrote it,
if clean documents hold it and toxic ones don't hold it far more often. Each hit is weighed by its window:
inside quotation marks it counts as quoted, else as abuse. A logistic model over the counts gives the score.

Defined cases: null and empty texts have no hits and score low; very long texts are scored whole; labels that are
null, or without a document, teach nothing; of several labels of a document the highest holds; without labels of
both classes every score is 0; rows with equal texts score alike; an empty table gives no rows; columns besides doc_id and text are
ignored or carried along.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import kept, materialize, text_of, tidied

THRESHOLD = 0.7
TRAIN_ROWS = 4_096
#: A term is this many times as frequent in toxic documents as in clean ones.
RATIO = 20.0
CONTEXTS = 3
#: So many different words before a term are enough, however frequent it is.
ENOUGH = 64
COMPLETIONS = 4
PREFIXES = range(4, 9)
#: Edits allowed by a term's length, longest first.
EDITS = ((10, 2), (5, 1), (0, 0))
#: The same for words with digits or symbols between their letters, which ordinary words don't have.
DISGUISED = ((8, 2), (4, 1), (0, 0))
WINDOW = 60
CACHE = 60_000
STATES = 4_000
#: Documents counted together while training.
SLICE = 64
WORD = re.compile(r"[^\W\d_]+")
#: Digits or symbols before a letter: where none follows a letter, a text has no word of the next kind.
MASK = re.compile(r"[\d_*@$!|+.-]{1,2}(?=[^\W\d_])")
#: Letters with one or two digits or symbols in between, begun and ended by a letter.
MASKED = re.compile(r"(?<![^\W_])[^\W\d_]+(?:[\d_*@$!|+.-]{1,2}[^\W\d_]+)+(?![^\W_])")
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‹": "›"}
FEATURES = 6
#: Weights of the features before any row is seen: a misspelled term says as much as a term, a quoted one little.
PRIOR = (4.0, 2.0, 2.0, 2.0, 0.5, 0.5)


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3, F.lit(0))


class LexiconAutomaton:
    """Whole terms within a few edits, and prefixes without edits, over one trie. States of the deterministic
    automaton are sets of (trie node, edits so far), found when first needed."""

    def __init__(self, words: list[str], prefixes: list[str], edits=EDITS):
        self.kids: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]  # edits that a term ending here allows
        self.stems: list[bool] = [False]
        self.budget: list[int] = [0]  # the most edits that any term below allows
        for w in words:
            allowed = next(k for n, k in edits if len(w) >= n)
            at = self._insert(w, allowed)
            self.ends[at] = allowed
        for p in prefixes:
            self.stems[self._insert(p, 0)] = True
        self._reset()

    def _insert(self, word: str, allowed: int) -> int:
        at = 0
        self.budget[0] = max(self.budget[0], allowed)
        for c in word:
            if c not in self.kids[at]:
                self.kids[at][c] = len(self.kids)
                self.kids.append({})
                self.ends.append(-1)
                self.stems.append(False)
                self.budget.append(0)
            at = self.kids[at][c]
            self.budget[at] = max(self.budget[at], allowed)
        return at

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.hits: list[int] = []
        self.start = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        todo = list(items)
        while todo:  # letters of the term that the text leaves out
            node, e = todo.pop()
            for kid in self.kids[node].values():
                if e < self.budget[kid] and (kid, e + 1) not in items:
                    items.add((kid, e + 1))
                    todo.append((kid, e + 1))
        key = frozenset(items)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            found = [e for node, e in key if e <= self.ends[node]]
            self.hits.append(0 if not found else 1 if min(found) == 0 else 2)
            if any(e == 0 and self.stems[node] for node, e in key):
                self.hits[-1] = 3
        return self.ids[key]

    def _move(self, at: int, c: str) -> int:
        items: set[tuple[int, int]] = set()
        for node, e in self.sets[at]:
            if (kid := self.kids[node].get(c)) is not None:
                items.add((kid, e))
            if e < self.budget[node]:
                items.add((node, e + 1))
                items.update((kid, e + 1) for kid in self.kids[node].values() if e < self.budget[kid])
        to = self._state(items) if items else -1
        self.moves[at][c] = to
        return to

    def match(self, word: str) -> int:
        """0: no; 1: a term; 2: a misspelled term; 3: a longer word that begins with a stem."""
        if len(self.sets) > STATES:
            self._reset()
        at, moves, last = self.start, self.moves, len(word) - 1
        for i, c in enumerate(word):
            to = moves[at].get(c)
            if to is None:
                to = self._move(at, c)
            if to < 0:
                return 0
            if self.hits[to] == 3 and i < last:
                return 3
            at = to
        return self.hits[at] % 3


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the hit stands between quotation marks that open and close in its line, WINDOW characters around."""
    left = text[max(0, start - WINDOW) : start].rpartition("\n")[2]
    right = text[end : end + WINDOW].partition("\n")[0]
    for opening, closing in QUOTES.items():
        at = left.rfind(opening)
        if at >= 0 and not any(c in left[at + 1 :] for c in closing) and any(c in right for c in closing):
            if opening != '"' or left.count('"') % 2:
                return True
    return False


class Scorer:
    def __init__(self, model: dict):
        self.model = model
        self.automaton = LexiconAutomaton(model["words"], model["prefixes"])
        self.masked = LexiconAutomaton(model["words"], [], DISGUISED)
        self.spared = frozenset(model["spared"])
        self.cache: dict[str, int] = {}

    def match(self, word: str) -> int:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            automaton = self.automaton if word.isalpha() else self.masked
            got = self.cache[word] = 0 if word in self.spared else automaton.match(word)
        return got

    def features(self, text: str) -> list[float]:
        """Whether any hit is abuse, then logs of the counts of terms, misspelled terms, stems; of quoted hits; and
        whether all are quoted. A disguised word counts beside the plain words that it is made of."""
        low = text.lower()
        words = set(WORD.findall(low))
        if any(low[m.start() - 1].isalpha() for m in MASK.finditer(low) if m.start()):
            words.update(MASKED.findall(low))
        cache = self.cache
        hits = {w: k for w in words if (k := cache[w] if w in cache else self.match(w))}
        if not hits:
            return [0.0] * FEATURES
        n = Counter()
        for pattern in (WORD, MASKED):
            for m in pattern.finditer(low):
                if (k := hits.get(m.group())) is not None:
                    n[4 if quoted(low, m.start(), m.end()) else k] += 1
        abuse = n[1] + n[2] + n[3]
        return [float(abuse > 0), math.log1p(n[1]), math.log1p(n[2]), math.log1p(n[3]), math.log1p(n[4]), float(n[4] > 0 and not abuse)]

    def score(self, text: str) -> float:
        x = np.dot(self.features(text), self.model["weights"]) + self.model["bias"]
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """y and text of at most TRAIN_ROWS documents a class, those whose ids hash lowest."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    ids = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS) for y in (0, 1)]
    chosen = [tuple(r) for x in ids for r in x.collect()]
    picked = docs.sparkSession.createDataFrame(chosen, "_id long, y int") if chosen else docs.sparkSession.createDataFrame([], "_id long, y int")
    rows = docs.select(F.col("doc_id").alias("_d"), text_of(docs).alias("text"))
    return rows.join(F.broadcast(picked), F.col("_d") == F.col("_id")).select("y", "text")


def hash_of(word: str) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


def _keys(word: str) -> list[str]:
    """The word, and its beginnings as stems."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def _slices(batches):
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)


def _frequencies(batches):
    """In how many documents of each class every word and stem is, few documents at a time."""
    for b in _slices(batches):
        df = {0: Counter(), 1: Counter()}
        for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            df[y].update({k for w in set(WORD.findall(text.lower())) for k in _keys(w)})
        keys = list(df[0].keys() | df[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([df[y][k] for k in keys], pa.int64()) for y in (1, 0)]], names=["term", "toxic", "clean"])


def _lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> tuple[list[str], list[str]]:
    """Words and stems. What may tell is decided by exact counts over the sample; as a term must be in RATIO times as
    many toxic documents as clean ones, there are at most about 2 / RATIO of the toxic documents' distinct terms."""
    df = sample.mapInArrow(tidied(_frequencies), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    df = materialize(df.filter(F.col("toxic") >= CONTEXTS), "terms")
    tested = df.count()
    often = (F.col("toxic") + 0.5) / (n_toxic + 1) >= RATIO * (F.col("clean") + 0.5) / (n_clean + 1)
    counts = {r[0]: (r[1], r[2]) for r in df.filter(often).collect()}
    wanted = frozenset(counts)

    def contexts(batches):
        for b in _slices(batches):
            seen = set()
            for text in b.column(1).to_pylist():
                before = ""
                for w in WORD.findall(text.lower()):
                    seen.update((k, hash_of(before), hash_of(w)) for k in _keys(w) if k in wanted)
                    before = w
            cols = list(zip(*seen)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()))], names=["term", "ctx", "more"])

    around = sample.filter("y = 1").mapInArrow(tidied(contexts), "term string, ctx long, more long").distinct()
    around = around.groupBy("term").agg(F.countDistinct("ctx").alias("ctx"), F.countDistinct("more").alias("more"))
    around = around.filter((F.col("ctx") >= CONTEXTS) & ((F.col("more") >= COMPLETIONS) | ~F.col("term").endswith("*")))
    found = {r[0]: (counts[r[0]][0], min(counts[r[0]][0], r[1])) for r in around.collect()}
    clean = {t: c for t, (_, c) in counts.items()}
    p, good = n_toxic / (n_toxic + n_clean), {}
    for t, (a, told) in found.items():  # told: copies of a passage tell no more than one
        c = clean.get(t, 0)
        q = told / (told + c)
        beyond = (told + c) * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0)) if q > p else 0
        if (told + 0.5) / (n_toxic + 1) >= RATIO * (c + 0.5) / (n_clean + 1) and beyond > math.log(tested + 1) and 4 * told >= min(a, ENOUGH):
            good[t] = a
    # of nested stems the longest that has nearly all documents of the shorter
    stems: list[str] = []
    for t in sorted((t[:-1] for t in good if t[-1] == "*"), key=len, reverse=True):
        if 2 * max((n for w, n in good.items() if w[-1] != "*" and w.startswith(t)), default=0) > good[t + "*"]:
            continue  # it is that one word that tells
        longer = [s for s in stems if s.startswith(t)]
        if not longer or good[t + "*"] > 1.5 * sum(good[s + "*"] for s in longer):
            stems = [s for s in stems if not s.startswith(t)] + [t]
    words = [t for t in sorted(good, key=lambda t: (-good[t], t)) if t[-1] != "*" and not any(t.startswith(s) for s in stems)]
    return words, sorted(stems)


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[list[float], float]:
    """Logistic regression with balanced classes, by Newton's method, drawn towards PRIOR where the rows say little."""
    x1 = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    ridge = np.array([0.05] * x.shape[1] + [1e-6]) * max(1.0, len(y) / 200)
    prior = np.array([*PRIOR, -4.0])
    beta = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        step = np.linalg.solve((x1.T * (weight * p * (1 - p) + 1e-9)) @ x1 + np.diag(ridge), x1.T @ (weight * (y - p)) - ridge * (beta - prior))
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return beta[:-1].tolist(), float(beta[-1])


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The model as plain values: words, prefixes, spared (ordinary words that a misspelling rule would catch), weights, bias."""
    empty = {"words": [], "prefixes": [], "spared": [], "weights": [0.0] * FEATURES, "bias": -30.0}
    sample = materialize(_sample(docs, labels), "labelled")
    n = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return empty
    words, prefixes = _lexicon(sample, n[1], n[0])
    model = empty | {"words": words, "prefixes": prefixes}

    def near_words(batches):
        own = Scorer(model)
        for b in _slices(batches):
            df = {0: Counter(), 1: Counter()}
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                df[y].update(w for w in set(WORD.findall(text.lower())) if own.match(w) == 2)
            words = list(df[0].keys() | df[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([df[y][w] for w in words], pa.int64()) for y in (1, 0)]], names=["w", "toxic", "clean"])

    near = sample.mapInArrow(tidied(near_words), "w string, toxic long, clean long").groupBy("w").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ordinary = (F.col("toxic") + 0.5) / (n[1] + 1) < RATIO * F.col("clean") / (n[0] + 1)
    model["spared"] = sorted(r[0] for r in near.filter((F.col("clean") > 0) & ((F.col("toxic") == 0) | ordinary)).collect())

    def features(batches):
        own = Scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], names=["y", "x"])

    rows = sample.mapInArrow(tidied(features), "y int, x array<double>").collect()
    x, y = np.array([r[1] for r in rows]).reshape(len(rows), -1), np.array([r[0] for r in rows])
    order = np.lexsort([*x.T, y])  # tasks end in any order
    model["weights"], model["bias"] = _fit(x[order], y[order])
    return model


def score_column(model: dict):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = _scorer(model)
        return pd.Series([own.score(t) for t in texts], dtype="float64")

    return score


def _scorer(model: dict) -> Scorer:
    return kept(("toxicity", pickle.dumps(model)), lambda: Scorer(model))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    return docs.select("doc_id", score_column(model)(text_of(docs)).alias("score"))


def keep_clean(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs below the threshold, whole."""
    return docs.filter(score_column(model)(text_of(docs)) < THRESHOLD)
