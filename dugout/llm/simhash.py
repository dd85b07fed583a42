"""SimHash near-duplicates by covering locality-sensitive hashing.

Every one of the 64 bits of a fingerprint gets a vector of r + 1 bits. For each non-zero vector v of that
length, one table keeps the bits whose vector has odd parity with v. The r or fewer bits in which a pair
differs give r equations, which some non-zero v solves: in its table the pair collides. So 2^(r+1) - 1 tables
find every pair within the radius, and every collision is checked.

Near copies by similarity have fingerprints of four such words, each with tables of its own. What collides and agrees
in four fifths of all bits is compared exactly, by its sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout.llm.common import col, dealt, map_columns, materialize, numbered, renamed, shuffle_partitions
from dugout.llm.components import least_reachable

BITS, SEED = 64, 42
WORDS, RADIUS = 4, 4
#: Of near copies by similarity: words of a shingle, least Jaccard similarity, words of a fingerprint, radius of each word's
#: tables, bits of a table's keys, and the most of the 256 bits in which a pair that is compared differs: one at 0.8 differs in
#: 39 of them, give or take 6.
NEAR_WORDS, SIMILAR = 5, 0.8
PRINTS, NEAR_RADIUS, KEY_BITS, NEAR_BITS = 4, 5, 20, 56
#: A bucket of more distinct fingerprints is dealt out by pairs of blocks of about so many.
BLOCK = 8192
#: The pairs of buckets of up to so many fingerprints are compared for many buckets at once. Keys of a fixed length make the buckets
#: grow with the input, by chance members that are nowhere near: these cost a comparison each, and a bucket of such ones no more.
SMALL = 128


def words_of(text: str) -> list[bytes]:
    """What ASCII white space parts, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _shingles(parts: list[bytes], words: int) -> Iterator[bytes]:
    """The shingles in order, repeats included; none without words."""
    if not parts:
        return
    whole = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    last = ends[words - 1 :].tolist() or [len(whole)]
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    for a, b in zip(first, last, strict=True):
        yield whole[a:b]


def shingle_hashes(parts: list[bytes], words: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in _shingles(parts, words)], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Of rows of 64-bit words, the bits that are set in over half of the rows."""
    counts = np.zeros(hashes.shape[1] * BITS, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        octets = hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, hashes.shape[1] * 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def simhash(text: str, words: int = WORDS) -> int:
    """The fingerprint of a text's shingles, unsigned: a bit is 1 if it is set in over half of their hashes.

    A-Z are lower-cased; words are what ASCII white space parts, shingles so many words joined by one blank,
    repeats included. Fewer words make one shingle of all of them, none the fingerprint zero.
    """
    return int(majority(shingle_hashes(words_of(text), words)[:, None])[0])


def shingle_set(text: str, words: int = NEAR_WORDS) -> np.ndarray:
    """The 128-bit hashes of the distinct shingles, a row of two words each."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join({digest(s, SEED) for s in _shingles(words_of(text), words)}), np.uint64).reshape(-1, 2)


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of PRINTS words of a set of 128-bit hashes: of both their words, and of these mixed anew."""
    mixed = hashes ^ (hashes >> np.uint64(30))
    for factor, shift in ((0xBF58476D1CE4E5B9, 27), (0x94D049BB133111EB, 31)):
        mixed = mixed * np.uint64(factor)
        mixed ^= mixed >> np.uint64(shift)
    return majority(np.hstack([hashes, mixed]))


def similarity(a: bytes, b: bytes) -> float:
    """The Jaccard similarity of two sets of 64-bit hashes; 1 if both are empty."""
    x, y = (np.frombuffer(s, np.uint64) for s in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, words: int = WORDS) -> DataFrame:
    """Add ``simhash``, the fingerprint as a signed 64-bit integer. A null text counts as empty; other columns pass
    through, but for one named like the output."""

    def make():
        def work(column: pa.Array):
            return [np.array([simhash(t.as_py() or "", words) for t in column], np.uint64).view(np.int64)]

        return work

    return map_columns(docs, make, T.StructType([T.StructField("simhash", T.LongType())]), [text], keep)


def covering_masks(radius: int) -> list[int]:
    """One mask of kept bits for each table, as signed 64-bit integers, for a radius up to 5. Bit i has the vector
    1 + i mod (2^(r+1) - 1), so that each mask keeps about half of the bits."""
    size = (1 << (radius + 1)) - 1
    masks = [sum(1 << i for i in range(BITS) if ((1 + i % size) & v).bit_count() % 2) for v in range(1, size + 1)]
    return np.array(masks, np.uint64).view(np.int64).tolist()


def narrowed(masks: list[int], bits: int, word: int = 0) -> list[int]:
    """Each mask without all its kept bits but so many, drawn for each by itself: what collides by a whole mask does so by
    its part."""
    some = []
    for t, mask in enumerate(masks):
        kept = [i for i in range(BITS) if mask >> i & 1]
        drawn = np.random.default_rng([SEED, word, t]).choice(kept, min(bits, len(kept)), replace=False).tolist()
        some.append(sum(1 << i for i in drawn))
    return np.array(some, np.uint64).view(np.int64).tolist()


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits each fingerprint of ``a`` (rows of words) differs from each of ``b``."""
    return sum(np.bitwise_count(a[:, None, k] ^ b[None, :, k]) for k in range(a.shape[1]))


def spanning_links(group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the members of one bucket (fingerprints, or rows of words) just as all its pairs within the
    radius do: each member of a component with the one it was reached from. Members already reached aren't compared
    again, so a dense group takes a few passes, not all pairs; members without any link go 64 at a time."""
    prints = group[:, None] if group.ndim == 1 else group
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rest = np.lexsort(prints.T)
    while len(rest) > 1:
        near = _apart(prints[rest[:64]], prints[rest]) <= radius
        linked = np.flatnonzero(near.sum(axis=1) > 1)
        if not len(linked):
            rest = rest[64:]
            continue
        front, rest = rest[linked[:1]], np.concatenate([rest[linked[0] + 1 : 64], rest[64:]])
        while len(front) and len(rest):
            ahead = []
            for k in range(0, len(front), 64):
                part = front[k : k + 64]
                near = _apart(prints[part], prints[rest]) <= radius
                hit = near.any(axis=0)
                if hit.any():
                    ahead.append(rest[hit])
                    found.append((part[near[:, hit].argmax(axis=0)], rest[hit]))
                    rest = rest[~hit]
                    if not len(rest):
                        break
            front = np.concatenate(ahead) if ahead else rest[:0]
    a, b = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1))
    return group[a], group[b]


def closest_links(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the members of one bucket just as all its pairs within the radius do, by near members first: what
    lies within half the radius is connected, then parts within three quarters, then within all of it. Two parts are
    linked by the nearest pair that meets as the second is reached."""
    part = np.arange(len(prints))
    found: list[tuple[int, int]] = []
    for share in (0.5, 0.75, 1.0):
        reach = int(radius * share)
        rest = np.argsort(part, kind="stable")
        while len(rest):
            seed = part[rest[0]]
            front, rest = rest[part[rest] == seed], rest[part[rest] != seed]
            while len(front) and len(rest):
                ahead = []
                for k in range(0, len(front), 64):
                    some = front[k : k + 64]
                    apart = _apart(prints[some], prints[rest])
                    nearest = apart.min(axis=0)
                    hit = np.flatnonzero(nearest <= reach)
                    if not len(hit):
                        continue
                    hit = hit[np.lexsort((rest[hit], nearest[hit], part[rest[hit]]))]
                    first = hit[np.flatnonzero(np.diff(part[rest[hit]], prepend=-1))]  # of each part reached its nearest member
                    found += zip(some[apart[:, first].argmin(axis=0)].tolist(), rest[first].tolist(), strict=True)
                    reached = np.isin(part[rest], part[rest[first]])
                    ahead.append(rest[reached])
                    rest = rest[~reached]
                    if not len(rest):
                        break
                front = np.concatenate(ahead) if ahead else rest[:0]
                part[front] = seed
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return prints[a], prints[b]


def nearest_across(prints: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each member with the nearest one of another root, if that is within the radius."""
    found = [(np.empty((0, prints.shape[1]), prints.dtype),) * 2]
    for k in range(0, len(prints), 64):
        apart = np.where(roots[k : k + 64, None] == roots[None, :], radius + 1, _apart(prints[k : k + 64], prints))
        j = apart.argmin(axis=1)
        near = np.flatnonzero(apart[np.arange(len(j)), j] <= radius)
        found.append((prints[k + near], prints[j[near]]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def near_pairs(prints: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of all pairs within the radius, the earlier first, and in how many bits each differs. Rows of one bucket stand
    together; ``ends`` has for each row where its bucket ends, or its own place or less, if it is to be left out. So many rows
    apart, the pairs of all buckets are compared at once."""
    words = [np.ascontiguousarray(prints[:, k]) for k in range(prints.shape[1])]
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int16))]
    first, step = np.arange(len(prints)), 1
    while len(first := first[first + step < ends[first]]):
        apart = sum(np.bitwise_count(w.take(first) ^ w.take(first + step)).astype(np.int16) for w in words)
        near = np.flatnonzero(apart <= radius)
        found.append((first[near], first[near] + step, apart[near]))
        step += 1
    a, b, apart = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, b, apart


#: A link from one fingerprint to another; or, with a key, a member of a bucket that is too large for one task.
_WORDS, _OTHERS = [f"w{k}" for k in range(PRINTS)], [f"other{k}" for k in range(PRINTS)]
FOUND = pa.schema([(c, pa.int64()) for c in ("key", *_WORDS, *_OTHERS, "root")])
FOUND_DDL = ", ".join(f"{c} long" for c in FOUND.names)


def _found(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None = None, root: np.ndarray | None = None) -> pa.RecordBatch:
    word = lambda x, k: pa.array(np.ascontiguousarray(x[:, k]).view(np.int64)) if x is not None and k < x.shape[1] else pa.nulls(len(a), pa.int64())
    number = lambda x: pa.nulls(len(a), pa.int64()) if x is None else pa.array(x)
    return pa.RecordBatch.from_arrays([number(key), *[word(x, k) for x in (a, b) for k in range(PRINTS)], number(root)], schema=FOUND)


def _in_buckets(rows: DataFrame, radius: int, block: int | None, across: bool) -> DataFrame:
    """``FOUND`` of rows (key, part if a bucket has several, w0 and what more words there are, root if ``across``), dealt
    out and sorted by key and part.

    A bucket, which has one key and part, is worked on when it is complete, its members in the order of their words. One
    of more than ``block`` rows isn't: its rows go out as they come. With ``across``, each member is linked to the nearest
    within the radius of another root, else links are found that connect the members just as all pairs within the radius
    do. Both are at most as many as the members.
    """
    names = [c for c in _WORDS if c in rows.columns]
    grouped = [c for c in ("key", "part") if c in rows.columns]

    def complete(key: np.ndarray, prints: np.ndarray, roots: np.ndarray | None, starts: np.ndarray, large: int | None) -> Iterator[pa.RecordBatch]:
        ends = np.append(starts[1:], len(key))
        sizes = ends - starts
        out = np.zeros(len(starts), bool) if not block else sizes > block
        if large is not None and len(starts):
            out[0] |= key[0] == large
        for k in np.flatnonzero(out):
            some = slice(starts[k], ends[k])
            yield _found(prints[some], None, key[some], roots[some] if across else None)
        ordered = lambda rows: prints[rows].view(np.int64).T[::-1]
        whole = (sizes > SMALL) & ~out
        i, j, apart = near_pairs(prints, np.repeat(np.where(whole | out, 0, ends), sizes), radius)
        some = np.repeat(whole, sizes)
        if across:
            i, j, apart = (x[roots[i] != roots[j]] for x in (i, j, apart))
            i, j, apart = np.append(i, j), np.append(j, i), np.append(apart, apart)
            order = np.lexsort((*ordered(j), apart, i))
            one = order[np.flatnonzero(np.diff(i[order], prepend=-1))]  # of each member the nearest
        else:
            # two members near each other only are a link; one that none is near has no part in any
            times = np.bincount(np.append(i, j), minlength=len(key))
            one = np.flatnonzero((times[i] == 1) & (times[j] == 1))
            times[i[one]] = times[j[one]] = 0
            some |= times > 0
        a, b = [prints[i[one]]], [prints[j[one]]]
        some = np.flatnonzero(some)
        bucket = np.searchsorted(starts, some, side="right")
        order = np.lexsort((*ordered(some), bucket))
        for group in np.split(some[order], np.flatnonzero(np.diff(bucket)) + 1) if len(some) else []:
            if across:
                x, y = nearest_across(prints[group], roots[group], radius)
            else:
                x, y = (closest_links if len(names) > 1 else spanning_links)(prints[group], radius)
            a.append(x)
            b.append(y)
        yield _found(np.concatenate(a), np.concatenate(b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        large = None  # the bucket whose rows go out
        for batch in batches:
            now = {c: batch.column(c).to_numpy() for c in (*grouped, *["root"] * across)}
            now["prints"] = np.stack([batch.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
            now = {c: np.concatenate([held[c], x]) for c, x in now.items()} if held else now
            if not len(now["key"]):
                continue
            changes = [now[c][1:] != now[c][:-1] for c in grouped]
            starts = np.append(0, np.flatnonzero(np.any(changes, axis=0)) + 1)
            last = starts[-1]
            done, held = ({c: x[some] for c, x in now.items()} for some in (slice(last), slice(last, None)))
            yield from complete(done["key"], done["prints"], done.get("root"), starts[:-1], large)
            if block and (len(held["key"]) > block or held["key"][0] == large):
                large = int(held["key"][0])
                yield _found(held["prints"], None, held["key"], held.get("root"))
                held = {}
        if held:
            yield from complete(held["key"], held["prints"], held.get("root"), np.zeros(1, np.int64), large)

    dealt_out = rows.repartition(shuffle_partitions(rows.sparkSession), *grouped).sortWithinPartitions(*grouped)
    return dealt_out.mapInArrow(run, FOUND_DDL)


def colliding(prints: DataFrame, masks: list[list[int]], radius: int, tag: str, across: bool = False, block: int = BLOCK) -> DataFrame:
    """Links (``_WORDS``, ``_OTHERS``) between distinct fingerprints, w0 and what more words there are, that collide under one
    of a word's masks and lie within the radius; see ``_in_buckets``. ``across`` needs a number ``root`` of each.

    The rows sorted are as many as fingerprints times masks. A bucket of more than ``block`` of them is cut into
    blocks, and each pair of blocks is a task's work by itself.
    """
    names = [c for c in _WORDS if c in prints.columns]
    carried = [*names, *["root"] * across]

    def keyed(word: str, own: list[int]):
        return F.transform(F.array(*map(F.lit, own)), lambda mask: F.xxhash64(F.lit(word), mask, F.col(word).bitwiseAND(mask)))

    keys = F.concat(*map(keyed, names, masks))
    rows = prints.select(F.explode(keys).alias("key"), *carried)
    found = materialize(_in_buckets(rows, radius, block, across), tag)
    large = found.filter("key is not null").select("key", *carried)
    if not large.isEmpty():
        sizes = materialize(large.groupBy("key").agg(F.ceil(F.count("*") / block).alias("blocks")), "blocks")
        own = F.pmod(F.xxhash64(*names), F.col("blocks"))
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: j != F.col("own"))
        cut = large.join(sizes, "key").withColumn("own", own).withColumn("o", F.explode(others))
        cut = cut.select("key", (F.least("own", "o") * F.col("blocks") + F.greatest("own", "o")).alias("part"), *carried)
        found = found.unionByName(_in_buckets(cut, radius, None, across))
    return found.filter("key is null").select(*_WORDS, *_OTHERS)


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links a, b between distinct fingerprints (column ``simhash``) that connect all pairs within the radius."""
    found = colliding(prints.select(F.col("simhash").alias("w0")), [covering_masks(radius)], radius, "buckets", block=block)
    return found.select(F.col("w0").alias("a"), F.col("other0").alias("b"))


def _named(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (doc_id, node) with component_id: the least id of the component that ``roots`` makes of its node.

    What a large component or a much copied node is joined with is written first, so that Spark splits the partition.
    """
    units = rows.groupBy("node").agg(F.min("doc_id").alias("first_id")).join(roots.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left")
    units = materialize(units.select("node", "first_id", F.coalesce("root", "node").alias("root")), "units")
    each = materialize(units.groupBy("root").agg(F.min("first_id").alias("component_id")), "roots")
    return rows.join(materialize(units.join(each, "root").select("node", "component_id"), "named"), "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``simhash`` and component_id, the least id reachable by links.

    Two documents are linked where their fingerprints differ in ``radius`` bits or fewer; copies share one
    fingerprint and are taken as one until the end. Texts without words have fingerprint zero, which links like
    any other. Null ids are no component's name: a component of such rows only has a null name. Repeated rows
    are all returned. Other columns are left out.
    """
    prints = fingerprints(dealt(docs.select(col(id_col).cast("long").alias("doc_id"), col(text).alias("text"))), keep=["doc_id"], words=words)
    prints = materialize(prints.withColumnRenamed("simhash", "node"), "simhash")
    roots = least_reachable(links(prints.select(F.col("node").alias("simhash")).distinct(), radius), tag="simhash-links")
    return _named(prints, roots).select("doc_id", F.col("node").alias("simhash"), "component_id")


#: Up to so many keys are broadcast, and more are shuffled.
BROADCAST_KEYS = 1_000_000


def _sets_of(source: DataFrame, wanted: DataFrame, n: int, words: int) -> DataFrame:
    """For each of the ``n`` wanted (doc_id, x) its node and the set of its shingles, from the text (doc_id, x, text)."""

    def make():
        def work(column: pa.Array):
            sets = [shingle_set(t.as_py() or "", words) for t in column]
            return [[x[:, 0].tobytes() for x in sets]]

        return work

    wanted = F.broadcast(wanted) if n <= BROADCAST_KEYS else wanted
    some = source.join(wanted, ["doc_id", "x"]).select("node", "text")
    sets = map_columns(some, make, T.StructType([T.StructField("set", T.BinaryType())]), ["text"], ["node"])
    return sets.groupBy("node").agg(F.min("set").alias("set"))


def _compared(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs a, b of nodes, written, with ``near``: whether their sets are at least so similar."""

    def make():
        return lambda x, y: [[similarity(a.as_py(), b.as_py()) >= similar for a, b in zip(x, y, strict=True)]]

    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    joined = joined.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return materialize(map_columns(joined, make, T.StructType([T.StructField("near", T.BooleanType())]), ["x", "y"], ["a", "b"]), "compared")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similar: float = SIMILAR, words: int = NEAR_WORDS) -> DataFrame:
    """One row per row of ``docs`` with an id: doc_id, x (a hash of the text), and component_id, the least id reachable by links.

    Documents are linked where their fingerprints collide in a table of one of their words and agree in four fifths of all
    bits (``NEAR_BITS``), and the Jaccard similarity of
    their distinct shingles is ``similar`` or more. The links that connect each bucket are compared exactly. While these
    leave parts of a bucket apart, each member of such a part is compared with the nearest of another part, round after
    round until no new link is found: so a bucket never gives more pairs than members. Texts of one fingerprint (as are
    those without words) are taken as one. Null texts count as empty. Repeated rows are all returned. Other columns, and
    rows with a null id, are left out.
    """
    source = docs.select(col(id_col).cast("long").alias("doc_id"), F.xxhash64(col(text)).alias("x"), col(text).alias("text")).filter("doc_id is not null")

    def make():
        def work(column: pa.Array):
            prints = [wide_print(shingle_set(t.as_py() or "", words)).view(np.int64) for t in column]
            together = np.stack(prints) if prints else np.empty((0, PRINTS), np.int64)
            return [pa.array(np.ascontiguousarray(together[:, k])) for k in range(PRINTS)]

        return work

    made = T.StructType([T.StructField(c, T.LongType()) for c in _WORDS])
    rows = map_columns(dealt(source), make, made, ["text"], ["doc_id", "x"])
    rows = materialize(rows.select("doc_id", "x", F.struct(*_WORDS).alias("node")), "prints")
    masks = [narrowed(covering_masks(NEAR_RADIUS), KEY_BITS, word) for word in range(PRINTS)]

    def pairs(prints: DataFrame, tag: str, across: bool = False) -> DataFrame:
        found = colliding(prints, masks, NEAR_BITS, tag, across)
        one, other = F.struct(*_WORDS), F.struct(*[F.col(o).alias(c) for o, c in zip(_OTHERS, _WORDS, strict=True)])
        return found.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()

    tried = materialize(pairs(rows.select("node.*").distinct(), "buckets"), "tried")
    # a node is in many pairs: their number would have all texts shuffled long before there are too many nodes to broadcast
    nodes = materialize(tried.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    n = nodes.count()
    wanted = rows.join(F.broadcast(nodes) if n <= BROADCAST_KEYS else nodes, "node").groupBy("node").agg(F.min(F.struct("doc_id", "x")).alias("r"))
    sets = materialize(_sets_of(source, wanted.select("node", "r.*"), n, words), "sets")
    compared = _compared(tried, sets, similar)
    while True:
        parts = least_reachable(compared.filter("near").select("a", "b"), tag="near-links")
        apart = compared.filter("not near")
        ends = apart.select(F.col("a").alias("node")).distinct().unionByName(apart.select(F.col("b").alias("node")).distinct()).distinct()
        # members of a bucket that compared pairs leave in several parts are in parts with an end of a pair that isn't near
        placed = materialize(nodes.join(parts, "node", "left").select("node", F.coalesce("root", "node").alias("part")), "placed")
        split = materialize(placed.join(ends, "node", "left_semi").select("part").distinct(), "split")
        open_ = placed.join(split, "part", "left_semi").select("node.*", F.xxhash64("part").alias("root"))
        across = pairs(open_, "open", across=True).join(compared.select("a", "b"), ["a", "b"], "left_anti")
        more = _compared(across, sets, similar)
        if more.filter("near").isEmpty():
            break
        compared = compared.unionByName(more)
    return _named(rows, parts).select("doc_id", "x", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similar: float = SIMILAR, words: int = NEAR_WORDS) -> DataFrame:
    """``docs`` with one document of each component of ``near_copies``, the one of the least id, all columns as they were.

    Of rows of one id and text the one whose columns are least as JSON stays. Different texts under one id that is a
    component's least all stay, and so do rows with a null id, which can't be named: no text is lost that isn't linked
    to one that stays.
    """
    held, names = numbered(docs)
    key = [F.col(names[id_col]).cast("long"), F.xxhash64(names[text])]
    found = near_copies(held, names[id_col], names[text], similar, words)
    judged = found.groupBy("doc_id", "x").agg(F.count("*").alias("times"), F.first(F.col("doc_id") != F.col("component_id")).alias("goes"))
    judged = materialize(judged.filter("goes or times > 1"), "judged")
    n, n_repeated = judged.agg(F.count("*"), F.count(F.when(~F.col("goes"), 1))).first()
    judged = F.broadcast(judged) if n <= BROADCAST_KEYS else judged
    marked = held.select("*", key[0].alias("doc_id"), key[1].alias("x")).join(judged, ["doc_id", "x"], "left")
    kept = marked.filter("goes is null")
    if n_repeated:
        own = F.struct(*names.values())
        once = marked.filter(~F.col("goes")).groupBy("doc_id", "x").agg(F.min_by(own, F.to_json(own)).alias("own"))
        kept = kept.select(*names.values()).unionByName(once.select("own.*"))
    return renamed(kept, names)
