"""Byte-pair encoding with word ends, and decoding.

A word's symbols form a doubly linked list; a priority queue holds the possible merges by rank, then
position. Entries whose symbols have changed since they were queued are stale and are skipped when they
come up. Decoding concatenates the vocabulary strings of the ids, parted by one space as a tokenizer
file without a decoder section does.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dugout.llm.common import Memo, dealt, held, map_columns, slices

#: Fixed values of the vocabulary's format: how normalized text is cut into words, and the mark of a word's end.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t\n\v\f\r \x85\p{Z}\p{L}\p{N}]+")
WORD_END = "</w>"


#: Bytes of the pieces that a Python worker remembers, and how many words.
REMEMBERED, WORDS_REMEMBERED = 1 << 24, 50_000
_BLANKS = np.arange(256, dtype=np.uint8)
_BLANKS[[9, 10, 13]] = 32


def pieces_of(texts: pa.Array) -> pa.Array:
    """A list for each text (large strings without nulls) of its runs between blanks, tabs and line ends, some of them
    empty: a text may be cut there before anything else."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, "<i8")[texts.offset : texts.offset + len(texts) + 1]
    plain = _BLANKS[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if data is not None else np.empty(0, np.uint8)
    return pc.split_pattern(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(plain)), " ")


def _code_points(ranges: str) -> list[int]:
    """``a-b`` and single ones, in hexadecimal."""
    ends = (r.split("-") for r in ranges.split())
    return [c for r in ends for c in range(int(r[0], 16), int(r[-1], 16) + 1)]


#: Letters and digits of newer Unicode versions than the vocabulary's library knows; to it they are marks.
NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 "
    "10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 "
    "187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 "
    "1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e "
    "2cea2-2cead 323b0-33479 3d000-3fc3f"
)
_AS_MARK = {c: "\ue000" for c in _code_points(NEWER)}
#: Capitals that the library knows and Python's own tables may not.
_SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_SMALL |= {c: c + 0x20 for c in _code_points("10d50-10d65")} | {c: c + 0x1B for c in _code_points("16ea0-16eb8")}


def words_of(text: str) -> list[str]:
    """The words of normalized text."""
    shape = text if text.isascii() else text.translate(_AS_MARK)
    return WORDS.findall(text) if shape == text else [text[slice(*m.span())] for m in WORDS.finditer(shape)]


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if it is visible Latin-1, else the next letter from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class WordBPE:
    """The encoder of one vocabulary file. Its memo tables are bounded; they outlive a task in its Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = token
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.final = [vocab[x + WORD_END] for x in letters]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words: dict[str, list[int]] = {}
        self.pieces = Memo("i4", REMEMBERED)
        self.shown = pa.array(self.strings, pa.string())

    def encode_word(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        if not data:
            return []
        ids = [self.inner[b] for b in data]
        ids[-1] = self.final[data[-1]]
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [
            (*merges[pair], i, pair) for i in range(n - 1) if (pair := (ids[i], ids[i + 1])) in merges
        ]
        queue = [(rank, i, pair, new) for rank, new, i, pair in queue]
        heapq.heapify(queue)
        while queue:
            _, i, pair, new = heapq.heappop(queue)
            j = after[i]
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (found := merges.get(right := (new, ids[k]))) is not None:
                    heapq.heappush(queue, (found[0], i, right, found[1]))
            h = before[i]
            if h >= 0 and (found := merges.get(left := (ids[h], new))) is not None:
                heapq.heappush(queue, (found[0], h, left, found[1]))
        return [x for x in ids if x >= 0]

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of a run of text without white space of ``pieces_of``."""
        # lower-casing goes letter by letter: a capital sigma at a word's end gets no final form
        text = piece.lower() if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower().translate(_SMALL)
        ids: list[int] = []
        for word in words_of(text):
            known = self.words.get(word)
            if known is None:
                if len(self.words) >= WORDS_REMEMBERED:
                    self.words.clear()
                known = self.encode_word(word)
                if len(word) < 64:
                    self.words[word] = known
            ids += known
        return ids

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = [self.encode_piece(p) for p in pieces.to_pylist()]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter((i for ids in coded for i in ids), "<i4", int(lengths.sum())), lengths

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts (large strings without nulls), one after the other, and where each text's begin, with the end.

        Texts that may hold special tokens are first cut at these; what is left of all texts is cut into pieces,
        which are looked up at once, and those not met lately are encoded.
        """
        parted = pc.match_substring(texts, "<|") if self.cut is not None else pa.array(np.zeros(len(texts), bool))
        lists = pieces_of(pc.if_else(parted, pa.scalar("", pa.large_string()), texts))
        ids, lengths = self.pieces[self.pieces.find(lists.flatten(), self._learn)]
        ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))]
        odd = np.flatnonzero(parted.to_numpy(zero_copy_only=False)).tolist()
        if not odd:
            return ids, ends
        own = [ids[a:b] for a, b in pairwise(ends.tolist())]
        for i in odd:
            own[i] = np.concatenate([np.empty(0, "<i4"), *map(self._part, self.cut.split(texts[i].as_py()))])
        return np.concatenate(own), np.cumsum([0, *map(len, own)])

    def _part(self, part: str) -> np.ndarray:
        if part in self.special:
            return np.array([self.special[part]], "<i4")
        pieces = pieces_of(pa.array([part], pa.large_string())).flatten().to_pylist()
        return np.array([i for piece in pieces for i in self.encode_piece(piece)], "<i4")

    def encode(self, text: str) -> list[int]:
        parts = self.cut.split(text) if self.cut is not None and "<|" in text else [text]
        return np.concatenate([*map(self._part, parts)]).tolist()

    def decode_many(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of runs of ids: the vocabulary strings of each, joined by blanks."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.shown.take(pa.array(ids))), " ")

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


def encoder(path: str) -> WordBPE:
    return held(WordBPE, path)


ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``ids`` and ``decoded`` (the ids decoded again) to every row.

    A null or empty text, or one of white space only, has no ids and decodes to the empty string. Repeated
    rows are encoded each on its own; other columns pass through, but for one named like an output. The
    vocabulary file is read by every Python worker, from ``vocabulary``.
    """

    def make():
        bpe = encoder(vocabulary)

        def work(column: pa.Array):
            coded, lengths, decoded = [np.empty(0, "<i4")], [np.zeros(1, np.int64)], [pa.array([], pa.string())]
            for part in slices(column):
                ids, ends = bpe.encode_many(part)
                coded.append(ids)
                lengths.append(np.diff(ends))
                decoded.append(bpe.decode_many(ids, ends))
            offsets = np.cumsum(np.concatenate(lengths)).astype("<i4")
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(coded))), pa.concat_arrays(decoded)

        return work

    return map_columns(dealt(docs), make, ENCODED, [text], keep)
