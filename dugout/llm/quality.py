"""Quality classifier: naive Bayes features for a linear support vector machine.

A text's features are indicators of n-grams: of its words (one and two), and of the shapes of its words (one to
three in a row, a repeated word having a shape of its own). Each indicator is scaled by the log ratio of its
counts in the two classes; a linear model with hinge loss is fitted by dual coordinate descent; a logistic
curve, fitted on rows that the model hasn't seen, turns its margin into a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout.llm.common import Memo, col, dealt, held, map_columns, numbered, renamed, slices

#: Buckets of the hashed n-grams. The last feature is the constant one.
BUCKETS = 1 << 18
#: The most labelled rows that a model is fitted on, and the most n-grams that they have in all: what the driver gets.
FIT_ROWS, FIT_GRAMS = 8000, 1 << 24
THRESHOLD = 0.3
#: Bytes of the words that a Python worker remembers, and of the texts whose n-grams it sorts at once: their n-grams take some forty times as much.
REMEMBERED, SORTED = 1 << 24, 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RUNS = [(re.compile(p), r) for p, r in ((r"[A-Z]+", "A"), (r"[a-z]+", "a"), (r"[0-9]+", "0"), (r"[^\x00-\x7f]+", "u"))]
_SAME = np.uint64(0x5BD1E9955BD1E995)


def _shape(word: str) -> str:
    if word.isalpha() and word.isascii() and word.islower():
        return "a"
    for pattern, letter in _RUNS:
        word = pattern.sub(letter, word)
    return word[:12]


def _hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each word: hashes of the lower-cased word and of its shape."""
    digest = xxhash.xxh64_intdigest
    found = [x for w in words.to_pylist() for x in (digest(w.lower().encode()), digest(_shape(w).encode(), 1))]
    return np.array(found, np.uint64), np.full(len(words), 2)


def _joined(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    return (a * _MIX ^ (b + np.uint64(seed))) * _MIX


def grams_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that each of the texts (large strings without nulls) has, ascending: their texts' places, and their numbers."""
    lists = pc.utf8_split_whitespace(texts)
    words = lists.flatten()
    there = pc.greater(pc.binary_length(words), 0)
    place = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())[there.to_numpy(zero_copy_only=False)]
    memo = held(Memo, "u8", REMEMBERED)
    at = memo.find(words.filter(there), _hashes)
    pairs = memo.values.reshape(-1, 2)[at]
    w, s = pairs[:, 0], pairs[:, 1].copy()
    next_ = place[1:] == place[:-1]  # whether a word's successor is of the same text
    s[1:][next_ & (w[1:] == w[:-1])] = _SAME
    two = _joined(s[:-1], s[1:], 3)
    third = next_[1:] & next_[:-1]
    grams = np.concatenate([w, _joined(w[:-1], w[1:], 1)[next_], _joined(s, s, 2), two[next_], _joined(two[:-1], s[2:], 4)[third]])
    both = np.concatenate([place, place[:-1][next_], place, place[:-1][next_], place[:-2][third]])
    grams >>= np.uint64(40)  # in place, as these are a task's largest arrays
    grams %= np.uint64(BUCKETS - 1)
    both *= BUCKETS
    both += grams.view(np.int64)
    del grams
    both.sort()
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    return both // BUCKETS, both % BUCKETS


def features(text: str) -> np.ndarray:
    """The numbers of the n-grams that the text has, ascending."""
    return grams_of(pa.array([text], pa.large_string()))[1]


@dataclass
class Model:
    ratios: np.ndarray  # by feature, the log ratio of counts
    weights: np.ndarray  # of the scaled indicators; the constant's last
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        v = self.ratios[found]
        return float(self.weights[found] @ v / max(np.sqrt(v @ v), 1e-9) + self.weights[-1])

    def score_all(self, texts: pa.Array) -> np.ndarray:
        """Scores of the texts of a column; null counts as empty."""
        made = [np.empty(0)]
        for part in slices(texts, SORTED):
            place, gram = grams_of(part)
            v = self.ratios[gram]
            along = np.bincount(place, self.weights[gram] * v, len(part))
            margins = along / np.maximum(np.sqrt(np.bincount(place, v * v, len(part))), 1e-9) + self.weights[-1]
            made.append(1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -500, 500))))
        return np.concatenate(made)

    def score(self, text: str) -> float:
        return float(self.score_all(pa.array([text]))[0])


def count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The log ratio of each feature's smoothed share of the rows of label 1 and of label 0."""
    counts = np.ones((2, BUCKETS))
    for r, y in zip(rows, labels, strict=True):
        counts[int(y == 1), r] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Weights of the linear model with hinge loss over the scaled indicators. Rows have unit length; both classes
    have the same cost in all."""
    y = np.where(labels == 1, 1.0, -1.0)
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    bound = cost * 0.5 / np.maximum(share, 1e-9)
    scale = np.array([1 / max(np.sqrt((ratios[r] ** 2).sum()), 1e-9) for r in rows])
    squares = np.array([(ratios[r] ** 2).sum() * k * k + 1 for r, k in zip(rows, scale, strict=True)])
    weights, alpha = np.zeros(BUCKETS), np.zeros(len(rows))
    shuffled = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in shuffled.permutation(len(rows)):
            r = rows[i]
            v = ratios[r] * scale[i]
            gradient = y[i] * (weights[r] @ v + weights[-1]) - 1
            now = min(max(alpha[i] - gradient / squares[i], 0.0), bound[i])
            if step := (now - alpha[i]) * y[i]:
                weights[r] += step * v
                weights[-1] += step
                alpha[i] = now
    return weights


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve through the margins, by Newton's method, with softened labels."""
    n1, n0 = int((labels == 1).sum()), int((labels != 1).sum())
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        g = np.array([((target - p) * margins).sum() - 1e-3 * a, (target - p).sum()])
        q = p * (1 - p)
        h = np.array([[(q * margins**2).sum() + 1e-3, (q * margins).sum()], [(q * margins).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model of label 1 from the rows' features. With one class only, or no row, every score is that class's smoothed share."""
    n1, n = int((labels == 1).sum()), len(labels)
    if not 0 < n1 < n:
        p = (n1 + 1) / (n + 2)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 1.0, float(np.log(p / (1 - p))))
    apart = np.arange(n) % 5 == 0
    if not all(0 < (labels[m] == 1).sum() < m.sum() for m in (apart, ~apart)):
        apart = np.zeros(n, bool)
    fitted = [r for r, x in zip(rows, apart, strict=True) if not x]
    ratios = count_ratios(fitted, labels[~apart])
    model = Model(ratios, dual_descent(fitted, labels[~apart], ratios), 1.0, 0.0)
    held = apart if apart.any() else ~apart
    margins = np.array([model.margin(r) for r, x in zip(rows, held, strict=True) if x])
    model.slope, model.offset = _logistic(margins, labels[held])
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """Fit a model on ``rows`` labelled documents at most, those whose ids hash lowest.

    ``labels`` has one label of 0 or 1 for an id; of several, the greatest holds, null ones and null ids count
    for nothing. Of several texts of one id the least teaches, null counting as empty, so that the order of the
    rows is nothing to the model. The chosen ids, ``rows`` at most, are broadcast; the driver gets their n-grams, as
    many documents' as have ``FIT_GRAMS`` in all.
    """
    named = labels.filter(col(label).isNotNull() & col(id_col).isNotNull()).groupBy(col(id_col).alias("_id")).agg(F.max(col(label)).alias("_label"))
    chosen = named.orderBy(F.xxhash64(F.col("_id"), F.lit(11)), "_id").limit(rows)
    source = docs.select(col(id_col).alias("_id"), F.coalesce(col(text), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")
    source = source.groupBy("_id", "_label").agg(F.min("_text").alias("_text"))

    def make():
        def work(column: pa.Array):
            found: list[np.ndarray] = []
            for part in slices(column, SORTED):
                place, gram = grams_of(part)
                found += np.split(gram.astype("<i4"), np.searchsorted(place, np.arange(1, len(part))))
            return [found]

        return work

    found = map_columns(source, make, T.StructType([T.StructField("f", T.ArrayType(T.IntegerType()))]), ["_text"], ["_id", "_label"])
    first = Window.orderBy(F.xxhash64(F.col("_id"), F.lit(11)), "_id")  # of `rows` rows at most
    within = found.withColumn("sum", F.sum(F.size("f")).over(first)).filter(F.col("sum") <= FIT_GRAMS)
    table = within.select("_id", "_label", "f").toArrow()
    order = np.argsort(table.column("_id").to_numpy())
    grams = [x.values.to_numpy() for chunk in table.column("f").chunks for x in chunk]
    model = fit([grams[i] for i in order], table.column("_label").to_numpy().astype(np.int64)[order])
    del table, grams
    pa.default_memory_pool().release_unused()
    return model


SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` (0 to 1, higher where label 1 is likelier) and ``predicted`` (1 from the threshold on) to every row.

    A null or empty text has the score of a text without features. Repeated rows have equal scores; other columns
    pass through, but for one named like an output.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: one weight for each bucket

    def make():
        def work(column: pa.Array):
            scores = shared.value.score_all(column)
            return pa.array(scores), pa.array((scores >= threshold).astype(np.int32))

        return work

    return map_columns(dealt(docs), make, SCORED, [text], keep)


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least the threshold, with all columns as they were, whatever their names."""
    numbers, names = numbered(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda column: [pa.array(shared.value.score_all(column) >= threshold)]

    good = map_columns(numbers, make, T.StructType([T.StructField("good", T.BooleanType())]), [names[text]], chosen="good")
    return renamed(good, names)
