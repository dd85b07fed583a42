"""Chat formatting by columnar byte assembly.

Turns are dealt out by ranges of (conversation, turn), so a conversation of any length is spread over tasks.
Each Arrow batch is assembled at once: the lengths of all headers, contents and trailers give cumulative
offsets, from which scatter indices place every byte in one preallocated buffer. A conversation's text is
its parts one after the other; each part carries the byte spans that the loss is taken over.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.llm.common import col, shuffle_partitions

#: The template. A user's turn stands between the first pair, an assistant's between the second; any other role
#: is named between the third, and its text ends with the last mark.
USER, ASSISTANT, ROLE, END = ("[INST]", "[/INST]"), ("<s>", "</s>"), ("[ROLE]", "[/ROLE]"), "[END]"
CONTROLS = (*USER, *ASSISTANT, *ROLE, END)
TURN = re.compile(
    r"\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)\[END\]",
    re.DOTALL,
)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)

#: Ties of the turn are dealt out by so many letters; the driver gets a sample of what rows are dealt out by.
DEALT_CHARS = 64
PARTS = "conv_id long, part long, n_turns long, formatted string, loss_start array<int>, loss_end array<int>"


def escape(texts: pa.Array) -> pa.Array:
    """Double every backslash, then break every control string by a backslash behind its first character."""
    out = pc.replace_substring(texts, "\\", "\\\\")
    for control in CONTROLS:
        out = pc.replace_substring(out, control, f"{control[0]}\\{control[1:]}")
    return out


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of every turn of a formatted conversation, or of a part of one."""
    for m in TURN.finditer(formatted):
        if m["user"] is not None:
            yield "user", unescape(m["user"])
        elif m["assistant"] is not None:
            yield "assistant", unescape(m["assistant"])
        else:
            yield unescape(m["role"]), unescape(m["other"])


def _bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a string array without nulls."""
    array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, "<i8")[array.offset : array.offset + len(array) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), at


def assemble(segments: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The rows' segments in one buffer, row by row; and where each segment begins (rows x segments, and the end)."""
    sources = [_bytes_of(s) for s in segments]
    lengths = np.stack([np.diff(at) for _, at in sources], axis=1)
    starts = np.concatenate([[0], np.cumsum(lengths.ravel())])
    buffer = np.empty(starts[-1], np.uint8)
    begins = starts[:-1].reshape(lengths.shape)
    for k, (data, at) in enumerate(sources):
        for a in range(0, len(begins), 4096):  # the indices take eight bytes for each byte that is moved
            b = min(a + 4096, len(begins))
            lo, hi = at[a], at[b]
            target = np.arange(lo, hi) + np.repeat(begins[a:b, k] - at[a:b], lengths[a:b, k])
            buffer[target] = data[lo:hi]
    return buffer, np.append(begins.ravel(), starts[-1])


def _format(batch: pa.RecordBatch, part: int) -> pa.RecordBatch:
    conv, role, text = batch.column(0), pc.fill_null(batch.column(1), ""), escape(pc.fill_null(batch.column(2), ""))
    user, assistant = pc.equal(role, "user"), pc.equal(role, "assistant")
    named = pc.binary_join_element_wise(ROLE[0], escape(role), ROLE[1], "")
    head = pc.if_else(user, USER[0], pc.if_else(assistant, ASSISTANT[0], named))
    tail = pc.if_else(user, USER[1], pc.if_else(assistant, ASSISTANT[1], END))
    buffer, at = assemble([head, text, tail])
    ids = conv.to_numpy(zero_copy_only=False) if not conv.null_count else np.array(conv.to_pylist(), dtype=object)
    first = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
    last = np.append(first[1:], batch.num_rows)
    base, ends = at[3 * first], at[3 * last]
    spoken = np.flatnonzero(assistant.to_numpy(zero_copy_only=False))
    per_part = np.searchsorted(spoken, np.append(first, batch.num_rows)).astype("<i4")
    origin = np.repeat(base, np.diff(per_part))
    lists = [
        pa.ListArray.from_arrays(pa.array(per_part), pa.array((at[3 * spoken + k] - origin).astype("<i4"))) for k in (1, 2)
    ]
    offsets = np.append(base, ends[-1:]).astype("<i4")
    texts = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(buffer))
    return pa.RecordBatch.from_arrays(
        [conv.take(pa.array(first)), pa.array(part + np.arange(len(first))), pa.array(last - first), texts, *lists],
        names=["conv_id", "part", "n_turns", "formatted", "loss_start", "loss_end"],
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """Parts of formatted conversations: conv_id, part, n_turns, formatted, loss_start, loss_end.

    ``turns`` has conv_id, turn, role and text; other columns are left out. A conversation's text is the
    ``formatted`` of its rows by ``part``. The loss spans are byte offsets in the part's UTF-8 text, one for
    every assistant turn. Null texts and null roles count as empty strings. Rows are ordered by turn (nulls
    first), then by role and text, so repeated rows and ties have one result. Rows with a null conv_id form a
    conversation of their own.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    source = (
        turns.select(
            col("conv_id").cast("long").alias("conv_id"), col("turn").cast("long").alias("turn"),
            col("role").cast("string").alias("role"), col("text").cast("string").alias("text"),
        )
        .repartitionByRange(shuffle_partitions(turns.sparkSession), *order[:2], *[F.substring(c, 1, DEALT_CHARS).asc_nulls_first() for c in ("role", "text")])
        .sortWithinPartitions(*order)
        .select("conv_id", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32  # range partitions are numbered in order
        for batch in batches:
            if batch.num_rows:
                out = _format(batch, part)
                part += out.num_rows
                yield out

    return source.mapInArrow(run, PARTS)


DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of what the formatted parts hold, by parsing them: one row for each conversation.

    A digest of a whole conversation needs its parts in order; they stream through one task by Arrow batches,
    which keeps no more than one batch and the running digests.
    """
    source = parts.repartition(shuffle_partitions(parts.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None

        def close(conv, s) -> pa.RecordBatch:
            row = [conv, s["turns"], s["all"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["formatted"]]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, DIGESTS, strict=True)], schema=DIGESTS)

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != current:
                    if state is not None:
                        yield close(current, state)
                    current = row["conv_id"]
                    state = {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
                for role, text in parse(row["formatted"]):
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode())
                data = row["formatted"].encode()
                for a, b in zip(row["loss_start"], row["loss_end"], strict=True):
                    text = unescape(data[a:b].decode())
                    state["chars"] += len(text)
                    state["loss"].update(text.encode())
                state["formatted"] += len(row["formatted"])
        if state is not None:
            yield close(current, state)

    return source.mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
