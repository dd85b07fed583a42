"""Context-triggered piecewise hashing: document fingerprints that survive local edits.

A rolling hash of the last seven bytes ends a piece wherever it is one less than a multiple of the block
size; every piece gives one letter of a signature. A fingerprint has the signatures of a block size and of
its double, so that texts of up to twice or half the length can be compared, by edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout.llm.common import col, map_columns, materialize, shuffle_partitions

WINDOW = 7
LEAST_BLOCK = 3
LENGTH = 64
#: The letters of a signature, and the weights by which a byte's age enters the rolling hash.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
AGES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646C, 0xFD7046C5], dtype=np.uint32)
#: Signatures without so many letters in a row in common aren't alike.
COMMON = 4


def rolling(data: bytes) -> np.ndarray:
    """At each byte, a mixed sum of the last seven bytes weighted by age."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    h = x * AGES[0]
    for k in range(1, WINDOW):
        h[k:] += x[:-k] * AGES[k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def _cuts(size: int, ends: np.ndarray) -> list[int]:
    """Where pieces end. Of more than twice LENGTH ends, as where lines repeat, those at least so far apart that so many pieces
    fill the text: so all parts of a text weigh alike."""
    if len(ends) <= 2 * LENGTH:
        return (ends + 1).tolist()
    apart, cuts, last = -(-size // (2 * LENGTH)), [], 0
    while (k := int(np.searchsorted(ends, last + apart - 1))) < len(ends):
        last = int(ends[k]) + 1
        cuts.append(last)
    return cuts


def _signature(data: bytes, ends: np.ndarray) -> str:
    """A letter for each piece, and one for what is left."""
    cuts = _cuts(len(data), ends)
    digest = xxhash.xxh32_intdigest
    out = [LETTERS[digest(data[a:b]) & 63] for a, b in zip([0, *cuts], cuts, strict=False)]
    last = cuts[-1] if cuts else 0
    if last < len(data):
        out.append(LETTERS[digest(data[last:]) & 63])
    return "".join(out)


def fingerprint(text: str) -> str:
    """``block:signature:signature of the double block``. Equal texts have equal fingerprints; the empty text has ``3::``.

    The block is the largest that gives half of LENGTH pieces or more.
    """
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return f"{LEAST_BLOCK}::"
    block = LEAST_BLOCK
    while block * LENGTH < len(data):
        block *= 2
    h = rolling(data)
    at = lambda size: np.flatnonzero(h % np.uint32(size) == size - 1)
    ends = at(block)
    while block > LEAST_BLOCK and len(ends) < LENGTH // 2:
        block //= 2
        ends = at(block)
    wide = ends[h[ends] % np.uint32(2 * block) == 2 * block - 1]
    while len(wide) >= LENGTH // 2:
        block, ends = 2 * block, wide
        wide = ends[h[ends] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{_signature(data, ends)}:{_signature(data, wide)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit for each letter of ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def signature_likeness(a: str, b: str) -> float:
    """One less the edit distance (letters inserted and deleted) over both lengths; 0 without a run in common."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    k = min(COMMON, len(a), len(b))
    if {a[i : i + k] for i in range(len(a) - k + 1)}.isdisjoint(b[i : i + k] for i in range(len(b) - k + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """From 0 to 1, the likeness of two fingerprints where block sizes are equal or one is twice the other, else 0."""
    if x == y:
        return 1.0
    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    bx, by = int(bx), int(by)
    if bx == by:
        return max(signature_likeness(x1, y1), signature_likeness(x2, y2))
    if bx == 2 * by:
        return signature_likeness(x1, y2)
    if by == 2 * bx:
        return signature_likeness(x2, y1)
    return 0.0


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``fingerprint`` to every row. A null text counts as empty; repeated rows have equal fingerprints; other
    columns pass through, but for one named like the output."""

    def make():
        return lambda column: [[fingerprint(t.as_py() or "") for t in column]]

    return map_columns(docs, make, T.StructType([T.StructField("fingerprint", T.StringType())]), [text], keep)


def edited(text: str, other: str) -> str:
    """The text with its second half (the last floor(n / 2) letters) replaced by the first as many of the other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


REPORT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
REPORT_DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
#: Ties of the id are dealt out by so many letters of the text; the driver gets a sample of what rows are dealt out by.
DEALT_CHARS = 64
#: With the partition that a row comes from, what it is (a report, or a partition's first or last document) and a text.
TAGGED = pa.schema([*REPORT, ("part", pa.int32()), ("kind", pa.string()), ("text", pa.string())])


def _report(doc_id: int | None, text: str, print_: str, following: str, its_print: str) -> tuple:
    changed = edited(text, following)
    changed_print = fingerprint(changed)
    return (
        doc_id, len(text), hashlib.sha256(changed.encode("utf-8")).hexdigest(), print_, changed_print,
        likeness(print_, changed_print), likeness(print_, its_print),
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def edit_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document, by descending id.

    Documents are sorted by ranges of their id, which shuffles the texts once. Each task reports on all its
    documents but the last, whose successor is the first of the next range that has any: these few documents,
    one for each task, meet in a join by range. The last document's successor is the first one; a sole
    document follows itself. Null ids come last, rows of equal id stand in the order of their texts. Null texts
    count as empty. Other columns are left out.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc()]
    source = (
        docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
        .repartitionByRange(shuffle_partitions(docs.sparkSession), order[0], F.substring("text", 1, DEALT_CHARS).asc())
        .sortWithinPartitions(*order)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        ends = [None] * (len(REPORT) - 1)

        def end(kind: str, doc: tuple) -> tuple:
            row = [doc[0], *ends]
            row[3] = doc[2]
            return (*row, part, kind, doc[1])

        for batch in batches:
            rows = []
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc = (i, value.as_py())
                doc = (*doc, fingerprint(doc[1]))
                rows.append(end("first", doc) if held is None else (*_report(*held, *doc[1:]), part, "report", None))
                held = doc
            yield _batch(rows, TAGGED)
        if held is not None:
            yield _batch([end("last", held)], TAGGED)

    tagged = materialize(source.mapInArrow(run, f"{REPORT_DDL}, part int, kind string, text string"), "edits")
    firsts, lasts = [tagged.filter(F.col("kind") == k).select("part", "doc_id", "text", "fingerprint") for k in ("first", "last")]
    # as many rows as tasks had documents
    following = firsts.select(
        "part",
        F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("after"),
    )
    met = (
        lasts.join(following, "part")
        .join(firsts.select(F.col("part").alias("after"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print")), "after")
        .select("doc_id", "text", "fingerprint", "next_text", "next_print")
    )

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([_report(*r) for r in zip(*[c.to_pylist() for c in batch.columns], strict=True)], REPORT)

    return tagged.filter(F.col("kind") == "report").select(*REPORT.names).unionByName(met.mapInArrow(close, REPORT_DDL))
