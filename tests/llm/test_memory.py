"""What a task holds at once follows from bounds in bytes, whatever the texts' lengths."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout.llm import common, quality

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
ROWS, LENGTH = 3000, 5000


def largest(spark):
    """The most bytes of texts that reached Python together, and the rows that came back."""

    def make():
        return lambda column: [pa.array(np.full(len(column), column.buffers()[2].size))]

    docs = spark.range(ROWS, numPartitions=1).select(F.repeat(F.lit("word "), LENGTH // 5).alias("text"))
    made = common.map_columns(docs, make, T.StructType([T.StructField("held", T.LongType())]), ["text"], [])
    return tuple(made.agg(F.max("held"), F.count("*")).first())


@pytest.fixture
def unset(spark):
    before = spark.conf.get(KEY, None)
    spark.conf.unset(KEY)
    yield
    spark.conf.unset(KEY)
    if before is not None:
        spark.conf.set(KEY, before)


def test_batches_of_long_texts_are_small(spark, unset):
    held, rows = largest(spark)
    assert rows == ROWS and held <= common.BATCH + 2 * LENGTH


def test_the_sessions_own_bound_holds(spark, unset):
    spark.conf.set(KEY, "8m")
    held, rows = largest(spark)
    assert rows == ROWS and common.BATCH + 2 * LENGTH < held <= (8 << 20) + 2 * LENGTH
    assert spark.conf.get(KEY) in ("8m", "8388608b")


def test_grams_of_many_texts_take_little_at_once():
    words = np.random.default_rng(3).integers(0, 5000, (400, 2000)).astype(str)
    texts = pa.array([" ".join(w) for w in words.tolist()])
    model = quality.Model(np.linspace(-1, 1, quality.BUCKETS), np.linspace(1, -1, quality.BUCKETS), 1.0, 0.0)
    tracemalloc.start()
    try:
        scores = model.score_all(texts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 60 * quality.SORTED
    assert scores.tolist() == [model.score(t) for t in texts.to_pylist()]
