"""Language identification by rank-order profiles of n-grams.

A profile is the list of a language's most frequent character n-grams (one to three letters, words padded by
a blank) by rank. A document's own list is compared with every profile: the distance is the sum, over the
document's n-grams, of how far each is out of place, or the length of the list where a profile lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout.llm.common import col, dealt, map_columns, slices

WORD = regex.compile(r"\p{L}+")
UNKNOWN = "und"
#: Length of the lists of n-grams.
RANKS = 400
#: The most rows that a language's profile is learned from; they are chosen by a hash of the id and the text's length.
LEARN_ROWS = 8000


def gram_codes(text: str) -> np.ndarray | None:
    """All n-grams of the text's words, each in 63 bits: three code points of 21 bits. None if it has no letter."""
    words = WORD.findall(text.lower())
    if not words:
        return None
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), "<u4").astype(np.int64)
    letter = c != 32
    pairs = c[:-1] | c[1:] << 21
    middle = letter[1:-1]
    return np.concatenate([c[letter], pairs, (pairs[:-1] | c[2:] << 42)[middle]])


def ranked(codes: np.ndarray) -> np.ndarray:
    """The most frequent n-grams, first the most frequent; ties by code."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    counts = np.diff(np.append(first, len(codes)))
    if len(first) > 4 * RANKS:  # those rarer than the last in the list needn't be sorted
        least = np.partition(counts, len(counts) - RANKS)[len(counts) - RANKS]
        first, counts = first[counts >= least], counts[counts >= least]
    return codes[first[np.argsort(-counts, kind="stable")[:RANKS]]]


class Profiles:
    """The languages' lists, as a table from n-gram to its rank in every language."""

    def __init__(self, lists: dict[str, list[int]]):
        self.langs = sorted(lists)
        self.vocab = np.unique(np.array([g for grams in lists.values() for g in grams], np.int64))
        self.ranks = np.full((len(self.vocab) + 1, len(self.langs)), -1, np.int32)  # the last row: in no profile
        for j, lang in enumerate(self.langs):
            grams = np.array(lists[lang], np.int64)
            self.ranks[np.searchsorted(self.vocab, grams), j] = np.arange(len(grams))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, ties to the first by name, and its share of all languages' likeness."""
        codes = gram_codes(text) if text and self.langs else None
        if codes is None:
            return UNKNOWN, 0.0
        own = ranked(codes)
        at = np.searchsorted(self.vocab, own)
        at[at == len(self.vocab)] = 0
        at[self.vocab[at] != own] = len(self.vocab)
        theirs = self.ranks[at]
        apart = np.where(theirs < 0, RANKS, np.abs(theirs - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        alike = 1 - apart / (RANKS * len(own))
        return self.langs[best], float(alike[best] / alike.sum()) if alike.sum() else 1 / len(self.langs)


def learn_profiles(docs: DataFrame, lang: str = "lang", text: str = "text", id_col: str = "doc_id", rows: int = LEARN_ROWS) -> Profiles:
    """Profiles of all non-null values of ``lang``, each from about ``rows`` of its documents at most.

    The n-grams are counted on the executors; the driver gets ``RANKS`` of them for each language. Rows whose
    text is null, empty or without letters teach nothing, and a language with no others isn't learned.
    """
    known = docs.filter(col(lang).isNotNull() & col(text).isNotNull()).select(
        col(lang).cast("string").alias("lang"), col(text).alias("text"), F.xxhash64(col(id_col), F.lit(7)).alias("h")
    )
    # a language's share of its rows that keeps about `rows` of them; one row for each language
    shares = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(rows)) / F.count("*")).alias("share"))
    chosen = known.join(F.broadcast(shares), "lang").filter((F.pmod("h", F.lit(1 << 20)) / float(1 << 20)) < F.col("share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            at = 0
            for part in slices(batch.column(1)):
                gathered: dict[str, list[np.ndarray]] = {}
                for name, value in zip(langs[at : at + len(part)], part, strict=True):
                    codes = gram_codes(value.as_py())
                    if codes is not None:
                        gathered.setdefault(name, []).append(codes)
                at += len(part)
                for name, codes in gathered.items():
                    grams, counts = np.unique(np.concatenate(codes), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"]
                    )

    totals = chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= RANKS).collect()
    lists: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        lists.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(lists)


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row, from its whole text only.

    A text that is null or has no letter, or any text if no language was learned, is ``und`` with score 0.
    Repeated rows have equal results; other columns pass through, but for one named like an output.
    """

    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # as many ranks as n-grams times languages

    def make():
        known = shared.value

        def work(column: pa.Array):
            made = [known.predict(t.as_py()) for t in column]
            return [m[0] for m in made], [m[1] for m in made]

        return work

    return map_columns(dealt(docs), make, PREDICTED, [text], keep)
