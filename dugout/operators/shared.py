"""Tables that a plan writes and reads again, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame

_own: list[str] = []


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` from files of its own under ``spark.checkpoint.dir``: what reads it doesn't compute it again. Without a cluster a
    temporary folder will do."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="dugout-"))
        folder = _own[0]
    path = f"{folder.rstrip('/')}/dugout-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
