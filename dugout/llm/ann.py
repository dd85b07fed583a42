"""Approximate nearest neighbours: coarse cells, score-aware four-bit codes, exact reranking.

Euclidean order is that of the inner product less half the squared length, so the search is for maximum inner
product. Vectors are moved to their mean and turned at random, so that no few dimensions hold all that tells them apart.
A vector's residual from its cell's centre, drawn to a common length, is coded by four bits for each pair of dimensions,
under the anisotropic loss: error parallel to the residual counts more than error across it, since the queries for
which the vector scores high point its way. A query's table has its product with every code word, both as seen from the
cell's centre, so that neither far-off means nor cells of very different width cost precision; scores
are sums of table entries, two codes at a time. Of each part that a query scans, the best by code are ranked anew
by their exact distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout.llm.common import col, map_columns, materialize

#: The most vectors that the index is fitted on; every vector is indexed.
FIT_ROWS = 20_000
MAX_CELLS = 4096
#: Below so many vectors there is one cell only.
LEAST_ROWS = 256
#: Share of the cells that a query looks into. These vectors have hardly any clusters; real ones need far less.
PROBED = 0.65
#: So many of each query's best by code, in each part of the index, are ranked by exact distance.
RERANKED = 160
#: A part of the index has about so many vectors, and meets about so many queries at a time.
PART_ROWS, PART_QUERIES = 8192, 2048
#: The cosine from which on a query counts in the loss; it sets how much more parallel error weighs.
ALIGNED = 0.2


@dataclass
class Index:
    centres: np.ndarray  # cells x dimensions
    words: np.ndarray  # pairs of dimensions x 16 x 2
    weight: float  # of parallel error, that of error across being 1
    length: float = 1.0  # of the residuals that the words were fitted for

    @property
    def width(self) -> int:
        return 2 * len(self.words)

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.width - x.shape[1]))).astype(np.float32)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.argmin((self.centres**2).sum(1)[None, :] - 2 * self.pad(x) @ self.centres.T, axis=1)

    def probed(self, queries: np.ndarray, share: float) -> np.ndarray:
        n = max(min(len(self.centres), 8), math.ceil(share * len(self.centres)))
        apart = (self.centres**2).sum(1)[None, :] - 2 * self.pad(queries) @ self.centres.T
        return np.argpartition(apart, n - 1, axis=1)[:, :n] if n < len(self.centres) else np.tile(np.arange(n), (len(queries), 1))

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Packed codes, two to a byte."""
        x = self.pad(x)
        residual = x - self.centres[cell]
        code = _assign(residual, _directions(residual), self.words, self.weight)
        if code.shape[1] % 2:
            code = np.pad(code, ((0, 0), (0, 1)))
        return (code[:, 0::2] | code[:, 1::2] << 4).astype(np.uint8)

    def evened(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors with their residuals drawn to the length that the words were fitted for, and how much shorter they were."""
        residual = self.pad(x) - self.centres[cell]
        size = np.sqrt((residual * residual).sum(1)) / np.float32(self.length)
        return self.centres[cell] + residual / np.maximum(size, 1e-30)[:, None], size

    def lifted(self, x: np.ndarray, cell: np.ndarray, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What a vector's code adds to its squared distance from a query: twice the product of residual and code, less the
        residual's squared length. The error of such a distance is in proportion to the distance itself."""
        residual = self.pad(x) - self.centres[cell]
        each = np.stack([codes & 15, codes >> 4], axis=2).reshape(len(codes), -1)[:, : len(self.words)]
        coded = self.words[np.arange(len(self.words))[None, :], each].reshape(len(codes), -1) * size[:, None]
        return 2 * (residual * coded).sum(1) - (residual * residual).sum(1)

    def scan(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate products of the residuals with the queries: vectors x queries, by table look-ups."""
        q = self.pad(queries).reshape(len(queries), -1, 2)
        tables = np.einsum("qmd,mkd->mkq", q, self.words, optimize=True)
        if len(tables) % 2:
            tables = np.concatenate([tables, np.zeros_like(tables[:1])])
        total = np.zeros((len(codes), len(queries)), np.float32)
        for m in range(codes.shape[1]):
            both = (tables[2 * m + 1][:, None, :] + tables[2 * m][None, :, :]).reshape(256, -1)
            total += both[codes[:, m]]
        return total


def _directions(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-30)


def _assign(residual: np.ndarray, direction: np.ndarray, words: np.ndarray, weight: float, rounds: int = 3) -> np.ndarray:
    """Code words by coordinate descent: each pair of dimensions in turn, given the parallel error of the others."""
    n, m = len(residual), len(words)
    r, u = residual.reshape(n, m, 2), direction.reshape(n, m, 2)
    apart = ((r[:, :, None, :] - words[None]) ** 2).sum(-1)
    along = np.einsum("nmd,mkd->nmk", u, words)
    mine = np.einsum("nmd,nmd->nm", r, u)
    code = apart.argmin(-1)
    at = np.arange(n)
    error = (mine - np.take_along_axis(along, code[:, :, None], 2)[:, :, 0]).sum(1)
    for _ in range(rounds):
        for k in range(m):
            others = error - (mine[:, k] - along[at, k, code[:, k]])
            each = others[:, None] + mine[:, k, None] - along[:, k]
            code[:, k] = (apart[:, k] + (weight - 1) * each**2).argmin(1)
            error = each[at, code[:, k]]
    return code


def _means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means; a centre that loses all its points moves to one of them."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres.astype(np.float32)


def fit(x: np.ndarray, rows: int, rounds: int = 6, seed: int = 3) -> Index:
    """An index for ``rows`` vectors, from a sample of them."""
    x = np.pad(x, ((0, 0), (0, x.shape[1] % 2))).astype(np.float32)
    d = x.shape[1]
    weight = max(1.0, (d - 1) * ALIGNED**2 / (1 - ALIGNED**2))
    n_cells = 1 if rows < LEAST_ROWS else max(1, min(MAX_CELLS, round(math.sqrt(rows)), len(x) // 4))
    centres = _means(x, n_cells, seed)
    index = Index(centres, np.zeros((d // 2, 16, 2), np.float32), weight)
    residual = x - centres[index.cells(x)]
    size = np.sqrt((residual * residual).sum(1))
    index.length = float(np.sqrt((size**2).mean())) or 1.0
    # of vectors that are centres themselves nothing is left to code
    residual, u = residual * (index.length / np.maximum(size, 1e-30))[:, None], _directions(residual)
    pairs = residual.reshape(len(x), -1, 2)
    for m in range(d // 2):
        own = pairs[:, m]
        index.words[m] = _means(own, 16, seed + m, 8) if len(own) >= 16 else own[np.arange(16) % len(own)]
    for _ in range(rounds):  # words that minimise the loss, given the codes
        code = _assign(residual, u, index.words, weight)
        chosen = np.stack([index.words[m][code[:, m]] for m in range(d // 2)], axis=1)
        error = ((pairs - chosen) * u.reshape(pairs.shape)).sum((1, 2))
        for m in range(d // 2):
            um, before = u.reshape(pairs.shape)[:, m], chosen[:, m]
            target = error + (before * um).sum(1)  # the parallel error if this pair's word were zero
            for k in range(16):
                at = code[:, m] == k
                if at.any():
                    a = at.sum() * np.eye(2) + (weight - 1) * um[at].T @ um[at]
                    b = pairs[at, m].sum(0) + (weight - 1) * (target[at, None] * um[at]).sum(0)
                    index.words[m, k] = np.linalg.solve(a, b)
            chosen[:, m] = index.words[m][code[:, m]]
            error = target - (chosen[:, m] * um).sum(1)
    return index


@dataclass
class Turn:
    mean: np.ndarray
    scale: float
    turn: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return ((x.astype(np.float64) - self.mean) / self.scale @ self.turn).astype(np.float32)


def _turned(x: np.ndarray, seed: int = 5) -> Turn:
    """Moves vectors to the sample's mean, in units of its spread, and turns them at random: distances keep their order."""
    x = x.astype(np.float64)
    mean = x.mean(0)
    scale = float(np.sqrt(((x - mean) ** 2).mean())) or 1.0
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))[0]
    return Turn(mean, scale, turn)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 1), values.dtype)


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Rows (vec_id, v) that take part: an id, and a vector without null, NaN or infinite components, not all zero,
    of the commonest length (of several, the greatest). Repeated rows count once; of several vectors of one id the least
    counts."""
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), col(vector).alias("v"))
    rows = rows.filter(
        F.col("vec_id").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("v") == (common["n"] if common else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


MET = pa.schema([("query", pa.int64()), ("d", pa.float64()), ("rep", pa.int64())])
MET_DDL = "query long, d double, rep long"


def search(
    vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", probed: float = PROBED,
    reranked: int = RERANKED, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """The ``k`` nearest found of every row that ``is_query`` (a column condition on vec_id) picks, against all other
    rows: query_id, rank, vec_id, score (Euclidean distance in double precision), ties by id.

    Copies of a vector are one entry of the index that names its k + 1 least ids, which is all that any query can
    return of them; queries with equal vectors search once. The index is cut into parts of all cells, whose codes meet
    queries in blocks, so no group grows with the table. A query looks into the share ``probed`` of the cells, nearest
    first, and into every other that may hold something nearer than what it found, by the distance of the cell's centre and
    the cell's width. Of each part the ``reranked`` best by code are ranked by their distance, and the k + 1 nearest
    leave it. Rows that don't take part (``usable``) neither ask nor are found. Other
    columns are left out; too few candidates give as many rows as there are.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vector).withColumn("h", F.xxhash64("v")), "usable")
    first = Window.partitionBy("h", "v").orderBy("vec_id")
    reps = (
        rows.withColumn("n", F.row_number().over(first))
        .filter(F.col("n") <= k + 1)  # planned as a limit for each group, also before the shuffle
        .groupBy("h", "v")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .select(F.col("ids")[0].alias("rep"), "ids", "h", "v")
    )
    reps = materialize(reps, "vectors")
    asked = rows.filter(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "h", "v").distinct()
    asked = asked.join(reps.select(F.col("rep").alias("query"), "h", "v"), ["h", "v"]).select("query_id", "query")
    asked = materialize(asked, "queries")
    queries = reps.join(asked.select(F.col("query").alias("rep")).distinct(), "rep", "left_semi").select(F.col("rep").alias("query"), "v")
    n_rows, n_queries = reps.count(), queries.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n_rows or not n_queries:
        return empty
    known = reps.orderBy(F.xxhash64("h", F.lit(1)), "rep").limit(fit_rows).select("v").toArrow()
    known = _matrix(known.column("v").combine_chunks())
    turned = _turned(known)
    index = fit(turned(known), n_rows)

    def coder():
        def work(column: pa.Array):
            if not len(column):
                return [], [], [], []
            x = turned(_matrix(column))
            cell = index.cells(x)
            even, size = index.evened(x, cell)
            codes = index.codes(even, cell)
            lift = index.lifted(x, cell, codes, size)
            return pa.array(cell.astype(np.int32)), [c.tobytes() for c in codes], pa.array(size.astype(np.float32)), pa.array(lift.astype(np.float32))

        return work

    parts, blocks = math.ceil(n_rows / PART_ROWS), math.ceil(n_queries / PART_QUERIES)
    made = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType()), T.StructField("size", T.FloatType()), T.StructField("lift", T.FloatType())])
    coded = map_columns(reps, coder, made, ["v"], ["rep", "v"]).select(
        "*",
        F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    asking = queries.select(
        "*",
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"),
    )

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return MET.empty_table()
        cell = left.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        left = left.take(pa.array(order))
        cell = cell[order]
        codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(cell), -1)
        reps_, size, lift = (left.column(c).to_numpy() for c in ("rep", "size", "lift"))
        own_v = _matrix(left.column("v").combine_chunks()).astype(np.float64)
        starts = np.searchsorted(cell, np.arange(len(index.centres) + 1))
        held = np.flatnonzero(np.diff(starts) > 0)
        width = np.zeros(len(index.centres))
        np.maximum.at(width, cell, np.sqrt(((index.pad(turned(own_v)) - index.centres[cell]).astype(np.float64) ** 2).sum(1)))
        q, names = _matrix(right.column("v").combine_chunks()).astype(np.float64), right.column("query").to_numpy()
        out: list[pa.Table] = []

        def scored(score: np.ndarray, at: np.ndarray, asks: np.ndarray) -> None:
            for c in held[asks[held].any(axis=1)]:
                who, own = np.flatnonzero(asks[c]), slice(starts[c], starts[c + 1])
                seen = at[who] - index.centres[c]
                score[own, who] = 2 * size[own, None] * index.scan(seen, codes[own]) - (seen**2).sum(1)[None, :] - lift[own, None]

        def best(score: np.ndarray, n: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rows of the n best by code of each query, and their distances; infinite where nothing was seen."""
            n = min(n, len(score))
            rows_ = np.argpartition(-score, n - 1, axis=0)[:n]
            d = np.stack([np.sqrt(((own_v[rows_[:, j]] - some[j]) ** 2).sum(1)) for j in range(len(some))], axis=1)
            return rows_, np.where(np.isfinite(np.take_along_axis(score, rows_, axis=0)), d, np.inf)

        for a in range(0, len(q), 64):
            some = q[a : a + 64]
            at = index.pad(turned(some))
            asks = np.zeros((len(index.centres), len(some)), bool)
            asks[index.probed(at, probed).T, np.arange(len(some))] = True
            score = np.full((len(cell), len(some)), -np.inf, np.float32)
            scored(score, at, asks)
            reach = best(score, k + 1, some)[1].max(axis=0) if len(cell) > k else np.full(len(some), np.inf)
            apart = np.sqrt(((at[None, :, :] - index.centres[:, None, :]).astype(np.float64) ** 2).sum(2))
            scored(score, at, ~asks & ((apart - width[:, None]) * turned.scale <= reach * (1 + 1e-5)))
            rows_, d = best(score, reranked, some)
            near = np.lexsort((reps_[rows_], d), axis=0)[: k + 1]
            rows_, d = np.take_along_axis(rows_, near, axis=0), np.take_along_axis(d, near, axis=0)
            j, i = np.nonzero(np.isfinite(d).T)
            out.append(pa.Table.from_arrays([pa.array(names[a + j]), pa.array(d[i, j]), pa.array(reps_[rows_[i, j]])], schema=MET))
        return pa.concat_tables(out)

    met = coded.groupBy("part", "block").cogroup(asking.groupBy("part", "block")).applyInArrow(meet, MET_DDL)
    nearest = Window.partitionBy("query").orderBy("d", "rep")
    # of the k + 1 nearest entries at most k + 1 ids can be among the nearest
    near = met.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= k + 1)
    near = near.join(reps.select("rep", "ids"), "rep").select("query", "d", F.explode("ids").alias("vec_id"))
    found = asked.join(near, "query").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("d").alias("score"))
