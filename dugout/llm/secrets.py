"""Secret scans: fixed shapes of credentials, and long tokens that a battery of tests finds random.

A random token is one whose characters look drawn uniformly from the alphabet of its encoding: a chi-squared
test of uniformity, a runs test and a test of serial correlation, joined by Fisher's method, give it one
p-value. Those of true secrets are uniform, those of ordinary tokens lie near zero. For each range of
lengths the share of ordinary tokens above a cut is estimated from all of the corpus, and the cut is the
least for which that share stays below the wanted false-discovery rate.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout.llm.common import col, map_columns, small_batches

#: The shapes of credentials, and the least length of what counts.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_KEYS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "random")

LONG = 16
#: A run of the encodings' characters with its padding: '=' stands only at the end of a value, elsewhere it parts a name from it.
TOKEN = re.compile(rf"[A-Za-z0-9+/_-]{{{LONG},}}(?:={{1,6}}(?![A-Za-z0-9+/_=-]))?")
#: Where a run that no encoding holds may be parted: at the signs of the one, of the other, or of both.
PARTS = [re.compile(p) for p in (r"[^_-]+", r"[^+/]+", r"[^+/_-]+")]
#: Of parts that overlap, the longest with a p-value of at least so much is taken: a value isn't parted at its own signs.
DOUBTFUL = 0.05
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: The encodings a token may be in, the smallest alphabet first.
ALPHABETS = {
    "hex": DIGITS + LOWER[:6],
    "HEX": DIGITS + LOWER[:6].upper(),
    "base32": LOWER.upper() + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + LOWER.upper(),
    "base62": DIGITS + LOWER.upper() + LOWER,
    "base64": LOWER.upper() + LOWER + DIGITS + "+/",
    "base64url": LOWER.upper() + LOWER + DIGITS + "-_",
}
_INDEX = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS.items()}
#: Lower ends of the ranges of lengths that have a cut of their own, each twice: for tokens with digits and without.
STRATA = (16, 24, 32, 48, 64, 128)
N_STRATA = 2 * len(STRATA)
BINS = 200

SPANS = T.ArrayType(
    T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType()),
    ])
)


def encoding(token: str) -> str | None:
    """The smallest alphabet that holds all characters of the token."""
    letters = set(token)
    return next((name for name, index in _INDEX.items() if letters <= index.keys()), None)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(token: str) -> float:
    """The combined p-value of the battery for the token being uniformly random; 0 if it is in no known encoding.

    Letters of one case without a digit count as words, with 0: of random values of ``LONG`` characters, 4 in a hundred in
    base32 and less than 1 in the other encodings look so.
    """
    token = token.rstrip("=")
    name = encoding(token)
    if name is None or len(token) < 8:
        return 0.0
    if token in (token.lower(), token.upper()) and not any(c in DIGITS for c in token):
        return 0.0
    index, k, n = _INDEX[name], len(_INDEX[name]), len(token)
    x = np.fromiter(map(index.__getitem__, token), np.int64, n)
    bins = min(8, k)
    expected = np.bincount(np.arange(k) * bins // k, minlength=bins) * (n / k)
    chi = float((((np.bincount(x * bins // k, minlength=bins) - expected) ** 2) / expected).sum())
    df = bins - 1
    uniform = _normal_tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = x >= k / 2
    a = int(high.sum())
    b = n - a
    if not a or not b:
        return 0.0
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + int((high[1:] != high[:-1]).sum())
    by_runs = 2 * _normal_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 0.0
    d = x - x.mean()
    serial = float((d[1:] * d[:-1]).sum() / (d * d).sum())
    by_serial = 2 * _normal_tail(abs(serial + 1 / n) * math.sqrt(n))
    half = -sum(math.log(max(p, 1e-300)) for p in (uniform, by_runs, by_serial))
    return min(1.0, math.exp(-half) * (1 + half + half * half / 2))


def candidates(text: str) -> Iterator[tuple[int, int, float]]:
    """Start, end and p-value of every long token but numbers.

    A run that mixes the signs of base64 and base64url is in no encoding: of its parts, the longest that may
    be random and then those of the greatest p-values, as far as they don't overlap.
    """
    if len(text) < LONG or max(map(len, text.split()), default=0) < LONG:
        return
    for m in TOKEN.finditer(text):
        token = m[0]
        if not (("+" in token or "/" in token) and ("-" in token or "_" in token)):
            if not token.rstrip("=").isdigit():
                yield m.start(), m.end(), randomness(token)
            continue
        spans = {(x.start(), x.end()) for parts in PARTS for x in parts.finditer(token) if len(x[0].rstrip("=")) >= LONG}
        tested = [(randomness(token[a:b]), b - a, a, b) for a, b in spans if not token[a:b].rstrip("=").isdigit()]
        chosen: list[tuple[int, int, float]] = []
        for p, _, a, b in sorted(tested, key=lambda t: (t[0] < DOUBTFUL, -t[1] if t[0] >= DOUBTFUL else 0, -t[0], -t[1], t[2])):
            if all(b <= x or y <= a for x, y, _ in chosen):
                chosen.append((a, b, p))
        for a, b, p in sorted(chosen):
            yield m.start() + a, m.start() + b, p


def stratum(token: str) -> int:
    """The number of the token's range of lengths, without its padding; tokens without a digit come behind all others."""
    token = token.rstrip("=")
    bare = not any(c in DIGITS for c in token)
    return sum(len(token) >= least for least in STRATA) - 1 + len(STRATA) * bare


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind's number and end of the fixed shapes, by start, then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in ASSIGN_KEYS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if len(text) >= 32 and max(map(len, text.split()), default=0) >= 32:
        # a run of 32 or more stands within a token of at least that length
        found += [
            (t.start() + m.start(), 2, t.start() + m.end())
            for t in TOKEN.finditer(text)
            for m in HEX.finditer(t[0])
            if m.end() - m.start() >= 32
        ]
    return sorted(found)


def scan_text(text: str, cuts: Mapping[int, float]) -> list[tuple[int, int, int, float | None]]:
    """Start, kind's number, end and p-value (of random tokens) of every secret, by start, then kind."""
    found: list[tuple[int, int, int, float | None]] = [(a, kind, b, None) for a, kind, b in base_spans(text)]
    for a, b, p in candidates(text):
        if p > cuts.get(stratum(text[a:b]), 1.0):
            found.append((a, 3, b, p))
    return sorted(found, key=lambda s: s[:3])


def cut_by_discovery(counts: np.ndarray, rate: float) -> float:
    """The least cut for which the estimated share of ordinary tokens among those above it is at most ``rate``.

    ``counts`` has tokens by p-value, in equal bins. Above one half p-values are taken to be of random tokens,
    whose number below follows, as they are uniform.
    """
    above = counts[::-1].cumsum()[::-1]
    per_bin = 2 * counts[len(counts) // 2 :].sum() / len(counts)
    if not per_bin:
        return 1.0
    random = per_bin * (len(counts) - np.arange(len(counts)))
    ordinary = np.maximum(0, above - random) / np.maximum(above, 1)
    # the first bin holds what the battery rejects outright
    return float(1 + np.argmax(ordinary[1:] <= rate)) / len(counts)


def learn_cuts(docs: DataFrame, text: str = "text", rate: float = 0.05) -> dict[int, float]:
    """The cut of each range of lengths, from every distinct long token of the corpus: one that is copied counts once.
    Only counts by range and bin, a table of at most ``N_STRATA * BINS`` rows, reach the driver."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for value in batch.column(0):
                text = value.as_py() or ""
                for a, b, p in candidates(text):
                    # padding isn't part of what is tested
                    token = text[a:b].rstrip("=")
                    found.add((stratum(token), xxhash.xxh3_64_intdigest(token) - (1 << 63), min(BINS - 1, int(p * BINS))))
            s, h, j = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(s, pa.int32()), pa.array(h, pa.int64()), pa.array(j, pa.int32())], names=["s", "h", "j"]
            )

    small_batches(docs.sparkSession)
    tokens = docs.select(col(text).alias("text")).mapInArrow(test, "s int, h long, j int").distinct()
    rows = tokens.groupBy("s", "j").agg(F.count("*").alias("n")).collect()
    tables = np.zeros((N_STRATA, BINS), np.int64)
    for r in rows:
        tables[r["s"], r["j"]] = r["n"]
    return {s: cut_by_discovery(tables[s], rate) for s in range(N_STRATA) if tables[s].any()}


def find_secrets(
    docs: DataFrame, cuts: Mapping[int, float] | None = None, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Add ``spans``: kind, start, end (code points, end exclusive) and p-value of every secret of the whole text.

    ``cuts`` are those of ``learn_cuts``, learned from ``docs`` where they aren't given. A null or empty text
    has an empty list. Spans of one kind don't overlap; a random token is reported beside a span of another kind that
    it touches. Runs of fewer than ``LONG`` characters aren't tested. Repeated rows have equal results; other columns pass through, but for one named ``spans``.
    """
    cuts = learn_cuts(docs, text) if cuts is None else cuts

    def make():
        def work(column: pa.Array):
            return [
                [
                    [{"kind": KINDS[k], "start": a, "end": b, "p": p} for a, k, b, p in scan_text(t.as_py() or "", cuts)]
                    for t in column
                ]
            ]

        return work

    return map_columns(docs, make, T.StructType([T.StructField("spans", SPANS)]), [text], keep)


def redact_text(text: str, spans: list[tuple[int, int, int, float | None]]) -> str:
    """The text with each secret, or run of overlapping ones, replaced by the first one's kind in angle brackets."""
    out, at = [], 0
    for a, kind, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", cuts: Mapping[int, float] | None = None) -> DataFrame:
    """``docs`` with the secrets of every text replaced; texts without any, and null texts, stay as they are."""
    cuts = learn_cuts(docs, text) if cuts is None else cuts
    order = docs.columns

    def make():
        def clean(value: str | None) -> str | None:
            return redact_text(value, found) if value and (found := scan_text(value, cuts)) else value

        return lambda column: [[clean(t.as_py()) for t in column]]

    return map_columns(docs, make, T.StructType([T.StructField(text, T.StringType())]), [text]).select(*map(col, order))
