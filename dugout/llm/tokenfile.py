"""Token-ID output: documents as Simple-8b blocks in Parquet shards, in order of document.

``write`` deals the documents out by ranges of their id, so that the shards, one after the other, hold
them in ascending order. One row of a shard is one block: its documents, where each one's ids begin, and
the ids packed by ``simple8b``. ``read`` unpacks blocks on the executors; a document's place in the whole
stream is the ids of earlier shards, of earlier blocks and of earlier documents of its block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dugout.llm import simple8b
from dugout.llm.common import Memo, col, held, ranges, shuffle_partitions

#: A block is closed when it holds so many ids or documents.
BLOCK_IDS, BLOCK_DOCS = 1 << 17, 2048
#: Marks that always end a word and never join what follows; an apostrophe may begin one, so it isn't among them.
MARKS = ".,!?;:*#$%&)]}\"-_=+/\\@~^`"

BLOCKS = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("offsets", pa.list_(pa.int64())), ("words", pa.binary()), ("escaped_at", pa.binary()), ("escaped", pa.binary()),
])
BLOCKS_DDL = (
    "shard int, block int, n_ids long, doc_ids array<bigint>, offsets array<bigint>, words binary, "
    "escaped_at binary, escaped binary"
)


_BLANKS = np.arange(256, dtype=np.uint8)
_BLANKS[[9, 10, 13]] = 32
#: Bytes of the pieces, and of the words, that a Python worker remembers.
REMEMBERED = 1 << 25
#: Texts are encoded together up to so many bytes.
TOGETHER = 1 << 23


def _layout(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of large strings without nulls."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, "<i8")[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), at


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))


def _pieces(texts: pa.Array) -> pa.Array:
    """A list for each text of its runs between blanks, tabs and line ends, some of them empty: a text may be cut there
    before anything else."""
    data, at = _layout(texts)
    return pc.split_pattern(_strings(_BLANKS[data[at[0] : at[-1]]], at - at[0]), " ")


def _halves(pieces: pa.Array) -> pa.Array:
    """Of every piece two strings: its word, and the marks behind it where the tokenizer would part them anyway."""
    words = pc.utf8_rtrim(pieces, characters=MARKS)
    # letters of these ranges may become a letter and a mark, which the marks behind would join
    parted = pc.and_not(pc.match_substring_regex(words, r"[\p{L}\p{N}]$"), pc.match_substring_regex(words, r"[\x{130}\x{900}-\x{fff}\x{fb00}-\x{fb4f}]$"))
    parted = parted.to_numpy(zero_copy_only=False)
    data, at = _layout(pieces)
    cut = at[:-1] + np.where(parted, pc.binary_length(words).to_numpy(), np.diff(at))
    halves = _strings(data, np.append(np.stack([at[:-1], cut], axis=1).ravel(), at[-1]))
    return pc.if_else(pc.string_is_ascii(halves), pc.ascii_lower(halves), halves)


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of ``TOGETHER`` bytes at most, or of one row."""
    return ranges(texts, TOGETHER)


class LibraryEncoder:
    """Ids by the tokenizers library, asked once for each distinct word while it is remembered.

    Its model works on the runs of letters, digits or marks between white space, so a text's ids are those of
    its pieces one after the other. Texts that may hold special tokens go to the library whole.
    """

    def __init__(self, path: str, cached: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.pieces, self.words = Memo("u4", cached), Memo("u4", cached)

    def _ask(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A word of small ASCII letters is one run already, so the library's model can take it directly."""
        tokenize, texts = self.library.model.tokenize, words.to_pylist()
        coded = [[x.id for x in tokenize(w)] if w.isascii() and w.isalpha() and w.islower() else None for w in texts]
        others = [i for i, ids in enumerate(coded) if ids is None]
        for i, ids in zip(others, self._ask([texts[i] for i in others]), strict=True):
            coded[i] = ids
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), "<u4", int(lengths.sum())), lengths

    def _ask_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at = self.words.find(_halves(pieces), self._ask_words)
        ids, lengths = self.words[at]
        return ids, lengths.reshape(-1, 2).sum(axis=1)

    def encode_many(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (none of a null), as little-endian 32-bit integers.

        All pieces of all texts are looked up at once, the unknown ones are learned, and the ids are gathered by
        cumulative offsets.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        special = pc.match_substring(texts, "<|")
        lists = _pieces(pc.if_else(special, "", texts))
        ids, lengths = self.pieces[self.pieces.find(lists.flatten(), self._ask_pieces)]
        ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))]
        data = ids.tobytes()
        out = [data[4 * a : 4 * b] for a, b in pairwise(ends.tolist())]
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self._ask([texts[i].as_py()])[0], "<u4").tobytes()
        return out


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append ``end_id`` and write all ids to ``path``, by ascending document id.

    Null texts count as empty: they have the end id only. Null ids come first; rows of equal id stand in the
    order of their texts. Other columns aren't written. No documents give shards without blocks.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    source = (
        docs.select(col(id_col).cast("long").alias("doc_id"), col(text).alias("text"))
        .repartitionByRange(shuffle_partitions(spark), order[0])
        .sortWithinPartitions(*order)
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, block = held(LibraryEncoder, vocabulary).encode_many, TaskContext.get().partitionId(), 0
        ids: list = []
        coded: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(coded), "<u4")
            words, at, big = simple8b.encode(values)
            offsets = np.cumsum([0, *(len(c) // 4 for c in coded)])
            row = [shard, block, len(values), ids, offsets, words.astype("<u8").tobytes(), at.astype("<i8").tobytes(), big.astype("<u8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCKS, strict=True)], schema=BLOCKS)

        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                for i, data in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                    ids.append(i)
                    coded.append(data + end)
                    size += len(data) // 4 + 1
                    if size >= BLOCK_IDS or len(ids) >= BLOCK_DOCS:
                        yield close()
                        block, ids, coded, size = block + 1, [], [], 0
        if ids:
            yield close()

    source.mapInArrow(pack, BLOCKS_DDL).write.parquet(path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The documents in the files (shard, block, doc_id, ``within``: the ids of the block before it, and ``ids``
    with the end id, as little-endian 32-bit integers in one binary value), and every block's place in the stream."""
    blocks = spark.read.schema(BLOCKS_DDL).parquet(path)
    sizes = blocks.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    # as many rows as there are shards: one per task of the writer
    shards = shards.select(
        "shard",
        (F.sum("shard_ids").over(Window.orderBy("shard")) - F.col("shard_ids")).alias("shard_start"),
    )
    starts = (
        sizes.withColumn("before", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids"))
        .join(shards, "shard")
        .select("shard", "block", (F.col("shard_start") + F.col("before")).alias("block_start"))
    )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = simple8b.decode(
                    np.frombuffer(row["words"], "<u8"), row["n_ids"], np.frombuffer(row["escaped_at"], "<i8"), np.frombuffer(row["escaped"], "<u8")
                ).astype("<u4")
                at = row["offsets"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * len(row["doc_ids"]), pa.int32()), pa.array([row["block"]] * len(row["doc_ids"]), pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()), pa.array(at[:-1], pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()),
                    ],
                    names=["shard", "block", "doc_id", "within", "ids"],
                )

    rows = blocks.mapInArrow(unpack, "shard int, block int, doc_id long, within long, ids binary")
    return rows, starts


def located(spark: SparkSession, path: str) -> DataFrame:
    """``read`` with every document's place in the whole stream."""
    rows, starts = read(spark, path)
    return rows.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("within")).alias("start"), "ids"
    )
