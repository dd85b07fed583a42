"""What the operators of this subpackage share: column-wise Arrow maps, shared-folder tables, sizes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_own_folder: str | None = None


def col(name: str) -> Column:
    """The column of exactly this name, also where the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named by number, so that no name of an operator's own clashes; and the new names by the old."""
    names = {c: f"n{i}" for i, c in enumerate(df.columns)}
    return df.select(*[col(c).alias(n) for c, n in names.items()]), names


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``numbered`` under their own names again; others are left out."""
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])


#: Bytes of an Arrow batch on its way to Python, where the session names no bound of its own. By Spark's default a batch of texts
#: has 10,000 rows or 64 MB, in buffers that double as they grow, and is held by the JVM and the Python worker at once.
BATCH = 1 << 22
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches have ``BATCH`` bytes in this session, give or take a row, if its settings don't say otherwise."""
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(BATCH))


def give_back() -> None:
    """Return what is free to the system at a task's end: a Python worker goes on to the next stages with all it ever took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux
    if trim is not None:
        trim(0)


def map_columns(
    df: DataFrame,
    make: Callable[[], Callable[..., Sequence]],
    outputs: T.StructType,
    inputs: Sequence[str],
    keep: Sequence[str] | None = None,
    chosen: str | None = None,
) -> DataFrame:
    """Add columns computed batch by batch in Arrow.

    ``make()`` runs once per task and returns a function from the arrays of ``inputs`` to one sequence per
    field of ``outputs``. ``keep`` names the columns carried along (all by default). A kept column whose
    name equals an output's, in any case, is replaced by the output. An input that is kept goes to Python once.
    With ``chosen``, the name of a boolean output, only rows for which it is true go back. Batches are kept small
    (``small_batches``).
    """
    small_batches(df.sparkSession)
    new = {f.name.lower() for f in outputs.fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    sent = [*kept, *[c for c in dict.fromkeys(inputs) if c not in kept]]
    source = df.select(*[col(c).alias(f"k{i}") for i, c in enumerate(sent)])
    schema = T.StructType(
        [T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(kept)]
        + [T.StructField(f"r{i}", f.dataType) for i, f in enumerate(outputs.fields)]
    )
    kinds = [to_arrow_type(f.dataType) for f in outputs.fields]
    n_kept, places = len(kept), [sent.index(c) for c in inputs]
    picked = None if chosen is None else n_kept + [f.name for f in outputs.fields].index(chosen)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            first = whole.column(places[0])
            # texts a few at a time, so that neither they nor what is made of them take much memory
            text = pa.types.is_string(first.type) or pa.types.is_large_string(first.type) or pa.types.is_binary(first.type)
            for a, b in ranges(first, TOGETHER) if text and len(first) else [(0, len(first))]:
                batch = whole.slice(a, b - a)
                made = work(*[batch.column(i) for i in places])
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(made, kinds, strict=True)]
                out = pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n_kept)], *arrays], names=names)
                yield out if picked is None else out.filter(out.column(picked))
        give_back()

    out = source.mapInArrow(run, schema)
    return out.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)],
        *[F.col(f"r{i}").alias(f.name) for i, f in enumerate(outputs.fields)],
    )


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the one the session names. Without a cluster, one of our own will do."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="dugout-")
    return f"file://{_own_folder}"


def new_table(spark: SparkSession, tag: str) -> str:
    """The path of a table not yet written, in the shared folder."""
    return f"{shared_folder(spark)}/dugout-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later work doesn't depend on any executor's disk."""
    path = new_table(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a frame made by ``materialize`` that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/dugout-" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Texts are worked on together up to so many bytes.
TOGETHER = 1 << 21


def ranges(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of ``limit`` bytes at most, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = before = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield a, b
        a, before = b, int(ends[b - 1])


def slices(texts: pa.Array, limit: int = TOGETHER) -> Iterator[pa.Array]:
    """The rows of ``ranges``, as large strings without nulls."""
    for a, b in ranges(texts, limit):
        yield pc.fill_null(texts.slice(a, b - a), "").cast(pa.large_string())


@lru_cache(maxsize=1)
def held(make: Callable, *args):
    """What a Python worker keeps for its next tasks: one operator's tables, until another operator asks."""
    return make(*args)


class Memo:
    """Rows of numbers by text, looked up for whole arrays at a time, within a bound of bytes. When it is full, what
    wasn't asked for since the last time goes."""

    def __init__(self, kind: str, limit: int):
        self.kind, self.limit = kind, limit
        self._set(pa.array([], pa.large_string()), np.empty(0, kind), np.empty(0, np.int64))

    def _set(self, keys: pa.Array, values: np.ndarray, lengths: np.ndarray) -> None:
        self.keys, self.values, self.lengths, self.starts = keys, values, lengths, np.cumsum(lengths) - lengths
        self.asked = np.zeros(len(keys), bool)

    def size(self) -> int:
        return self.keys.nbytes + self.values.nbytes + 17 * len(self.keys)

    def find(self, texts: pa.Array, learn) -> np.ndarray:
        """The places of all texts; ``learn`` gets the distinct new ones and returns their numbers and how many each has."""
        if self.size() > self.limit:
            kept = self.asked
            self._set(self.keys.filter(pa.array(kept)), *self[np.flatnonzero(kept)])
            if 2 * self.size() > self.limit:
                self._set(self.keys.slice(0, 0), self.values[:0], self.lengths[:0])
        coded = texts.dictionary_encode()
        at = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.keys), -1).to_numpy()
        new = at < 0
        self.asked[at[~new]] = True
        if new.any():
            asked, missing = self.asked, coded.dictionary.filter(pa.array(new))
            values, lengths = learn(missing)
            at = np.where(new, len(self.keys) - 1 + np.cumsum(new), at)
            self._set(pa.concat_arrays([self.keys, missing]), np.concatenate([self.values, values]), np.concatenate([self.lengths, lengths]))
            self.asked[: len(asked)] = asked
        return at[coded.indices.to_numpy()]

    def __getitem__(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts at these places, one after the other, and how many each has."""
        return gather(self.values, self.starts[at], self.lengths[at]), self.lengths[at]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, one after the other."""
    source = np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
    source += np.arange(len(source))
    return flat[source]


def dealt(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew where its scan has fewer tasks than the cluster has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
