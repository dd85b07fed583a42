"""Vector code compression: each of a vector's parts as the index of its nearest code word, in whole numbers.

Segment-mean lower bounds find the nearest entry: the distance of two parts is at least that of their segments' means,
weighted by the segments' lengths, and of what is left of both beside the means, by length. One segment first, then
twice as many a step. Entries whose bound lies above an exact distance already known go, with room for rounding;
survivors get exact integer distances.

The codebooks (16 x 64 entries, whatever the table's size) are learned in rounds over all vectors: tasks return sums of
each entry, which Spark adds up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout.llm.common import col, map_columns, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Whole components are held within this bound, so that no squared distance and no usual sum leaves 64 bits.
LIMIT = 1 << 28
#: Rows of parts that meet all entries at a time.
TOGETHER = 4096


class Bounds:
    """Lower bounds of the squared distances between rows and a codebook's entries, from coarse to fine."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        width = entries.shape[1]
        self.cuts = [np.linspace(0, width, n + 1).astype(int)[:-1] for n in (1, 2, 4, 8, 16, 32, 64) if n == 1 or 2 * n <= width]
        self.sketches = [self.sketch(entries, cuts) for cuts in self.cuts]
        self.longest = np.sqrt((entries.astype(float) ** 2).sum(1).max())

    @staticmethod
    def sketch(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Per row: each segment's mean by the root of its length, then the length of what is left."""
        x = x.astype(np.float64)
        lengths = np.diff(np.append(cuts, x.shape[1]))
        means = np.add.reduceat(x, cuts, axis=1) / lengths
        left = np.sqrt(((x - np.repeat(means, lengths, axis=1)) ** 2).sum(1))
        return np.column_stack([means * np.sqrt(lengths), left])

    def exact(self, x: np.ndarray, rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
        return ((x[rows] - self.entries[entries]) ** 2).sum(1)

    def survivors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and entries, in order, whose bounds don't show that another entry is nearer."""
        everyone = np.arange(len(x))
        bound = np.zeros((len(x), len(self.entries)))
        mine = self.sketch(x, self.cuts[0])
        for k in range(mine.shape[1]):
            bound += (mine[:, k, None] - self.sketches[0][None, :, k]) ** 2
        # what rounding may add to a bound
        room = 1e-3 + 1e-11 * (np.sqrt((x.astype(float) ** 2).sum(1)) + self.longest) ** 2
        known = self.exact(x, everyone, bound.argmin(1)) + room
        rows, entries = np.nonzero(bound <= known[:, None])
        for cuts, theirs in zip(self.cuts[1:], self.sketches[1:], strict=True):
            mine = self.sketch(x, cuts)
            finer = ((mine[rows] - theirs[entries]) ** 2).sum(1)
            best = entries[_first_least(rows, finer)[0]]
            known = np.minimum(known, self.exact(x, everyone, best) + room)
            near = finer <= known[rows]
            rows, entries = rows[near], entries[near]
        return rows, entries

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the nearest entry, the lower one of two equally near, and its exact squared distance."""
        rows, entries = self.survivors(x)
        at, least = _first_least(rows, self.exact(x, rows, entries))
        return entries[at], least


def _first_least(rows: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row first has its least value, and that value; ``rows`` ascends and leaves out none."""
    least = np.minimum.reduceat(value, np.flatnonzero(np.diff(rows, prepend=-1)))
    at = np.flatnonzero(value == least[rows])
    return at[np.flatnonzero(np.diff(rows[at], prepend=-1))], least


class Codebooks:
    def __init__(self, entries: np.ndarray):
        """``entries``: parts x entries x width."""
        self.entries = entries
        self.bounds = [Bounds(e) for e in entries]

    def assigned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each part of each vector: vectors x parts."""
        x = x.reshape(len(x), len(self.entries), -1)
        found, error = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], np.int64)
        for p, bounds in enumerate(self.bounds):
            for a in range(0, len(x), TOGETHER):
                found[a : a + TOGETHER, p], error[a : a + TOGETHER, p] = bounds.nearest(x[a : a + TOGETHER, p])
        return found, error

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def whole(vector: Column, width: int) -> Column:
    """floor(256 x) of each component, held within LIMIT, with zeros behind up to ``width``."""
    scaled = F.transform(vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * SCALE), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    return F.concat(scaled, F.array_repeat(F.lit(0), F.lit(width) - F.size(vector)))


def usable(vectors: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Rows whose vector has no null, NaN or infinite component and the commonest length (the longer of two), and that length."""
    x = col(vector)
    fit = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.filter(F.coalesce(fit, F.lit(False)))
    sizes = rows.groupBy(F.size(x).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).head()
    width = sizes["size"] if sizes else 0
    return rows.filter(F.size(x) == width), width


def learn(rows: DataFrame, width: int) -> Codebooks:
    """Codebooks of ``rows`` (id, x): parts of the least ids first, then ROUNDS rounds of assignment and floored means."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(ENTRIES).collect()
    entries = np.array([r["x"] for r in first], np.int64).reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2)
    for _ in range(ROUNDS):
        books = Codebooks(entries)

        def sums(batches: Iterator[pa.RecordBatch], books: Codebooks = books) -> Iterator[pa.RecordBatch]:
            parts, n, _ = shape = books.entries.shape
            count, total = np.zeros((parts, n), np.int64), np.zeros(shape, np.int64)
            for batch in batches:
                x = _matrix(batch.column(0))
                found, _ = books.assigned(x)
                x = x.reshape(len(x), parts, -1)
                for p in range(parts):
                    count[p] += np.bincount(found[:, p], minlength=n)
                    np.add.at(total[p], found[:, p], x[:, p])
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_pydict({"part": p, "entry": e, "n": count[p, e], "total": pa.array(list(total[p, e]), pa.list_(pa.int64()))})

        told = rows.select("x").mapInArrow(sums, "part long, entry long, n long, total array<long>")
        # rows of at most PARTS x ENTRIES from each task; as many numbers as the codebooks have come back
        told = told.select("part", "entry", "n", F.posexplode("total").alias("at", "v")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
        entries = entries.copy()
        for r in told.toLocalIterator():
            entries[r["part"], r["entry"], r["at"]] = r["v"] // r["n"]
    return Codebooks(entries)


def encode(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Each usable vector's code: vec_id, code (two hex digits a part), error, label_error, codebooks_sha256.

    Vectors that are null or empty, hold a null, NaN or infinite component, or have another length than most, take no part. A
    length that PARTS doesn't divide is filled up with zeros; components beyond 2^20 count as 2^20. A repeated row counts as
    often as it occurs, in the codebooks and in the result. Null ids have a code but come last among the first entries; equal
    ids go by their vectors. With fewer than ENTRIES vectors there are fewer entries. Null labels are a label. Other columns
    aren't read. A table without a usable vector gives no rows.
    """
    kept, width = usable(vectors.select(col(id_col).alias("id"), col(vector).alias("v"), col(label).alias("label")), "v")
    padded = -(-width // PARTS) * PARTS
    rows = kept.select("id", "label", whole(F.col("v"), padded).alias("x"))
    if not width:
        empty = T.StructType([rows.schema["id"], *[T.StructField(c, t) for c, t in (("code", T.StringType()), ("error", T.LongType()), ("label_error", T.LongType()), ("codebooks_sha256", T.StringType()))]])
        return vectors.sparkSession.createDataFrame([], empty).withColumnRenamed("id", id_col)
    books = learn(rows, padded)

    def coder():
        digits = np.array([f"{i:02x}" for i in range(ENTRIES)], "U2")

        def work(x: pa.Array):
            found, error = books.assigned(_matrix(x))
            return pa.array(digits[found].view(f"U{2 * PARTS}")[:, 0] if len(found) else [], pa.string()), pa.array(error.sum(1))

        return work

    made = T.StructType([T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = materialize(map_columns(rows, coder, made, ["x"], keep=["id", "label"]), "codes")
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    sums = sums.withColumnRenamed("label", "of")
    found = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return found.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """The same with every distance."""
    finite = "len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

    def assigned(k: int) -> str:
        apart = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - w[i]) * (x[i] - w[i])))"
        return f"a{k} AS (SELECT rid, p, any_value(x) AS x, min(struct_pack(d := CAST({apart} AS BIGINT), e := e)) AS best FROM parts JOIN book{k} USING (p) GROUP BY rid, p)"

    def book(k: int) -> str:
        floored = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
        return f"""m{k} AS (SELECT p, e, list({floored} ORDER BY i) AS w FROM (
    SELECT p, best.e AS e, i, sum(x[i]) AS s, count(*) AS n FROM a{k - 1}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS i) GROUP BY ALL) GROUP BY p, e),
book{k} AS (SELECT p, e, coalesce(m.w, b.w) AS w FROM book{k - 1} b LEFT JOIN m{k} m USING (p, e))"""

    return f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND {finite}),
parts AS (SELECT rid, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, (SELECT unnest(range({PARTS})) AS p)),
book0 AS (SELECT p, rid - 1 AS e, x AS w FROM parts WHERE rid <= {ENTRIES}),
{", ".join(f"{assigned(k - 1)}, {book(k)}" for k in range(1, ROUNDS + 1))},
{assigned(ROUNDS)},
digest AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS}),
coded AS (SELECT vec_id, label, code, error FROM kept JOIN (SELECT rid, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid) USING (rid))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"""
