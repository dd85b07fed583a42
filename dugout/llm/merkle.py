"""Merkle manifest of documents: a tree of 16 nodes a run for each source, and one over the sources' subroots.

Higher-order SQL blocks: leaves in order are gathered in arrays of 256 at most, which sequence, transform, slice and aggregate
collapse by two levels; the blocks' roots are nodes again, in blocks of their own, until one node of each source remains.
All of it is DataFrame functions.

Ranks need no task that holds a source: leaves are dealt by ranges of source and id, numbered where they lie, and the
numbers of rows in earlier ranges are added. A block gives each of its runs of 16 the siblings further up once; full
paths exist only row by row, where they are hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.llm.common import col, forget, materialize

#: Nodes that become one, and levels by which a block of FANOUT ** DEPTH nodes collapses at once.
FANOUT, DEPTH = 16, 2
BLOCK = FANOUT**DEPTH
_STEP = "struct<before:string,after:string>"


def encoded(*values: Column) -> Column:
    """Values one after the other: UTF-8 byte count, ``:`` and the value, integers in decimal; ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts])


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(encoded(doc_id, source, lang, n_chars, text), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, start, lambda below, s: F.sha2(F.concat(s["before"], below, s["after"]), 256))


def proof(path: Column) -> Column:
    """All siblings on a path in one text, level by level upwards, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place among those of the same ``key`` by ``order`` (from 0), and ``n``, their number."""
    dealt = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    # the id holds the partition in its upper bits, the row's number in it in the lower 33
    dealt = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("at", 33).alias("part")
    runs = dealt.groupBy("key", part).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    of_key = Window.partitionBy("key")
    earlier = of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("key", "part", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("rows").over(of_key).alias("n"))
    found = dealt.withColumn("part", part).join(runs, ["key", "part"])
    return found.select(*rows.columns, (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "n")


def _levels(nodes: Column, n: Column) -> Column:
    """The nodes of a block, and of each level that it collapses to: as far as the source's tree goes, DEPTH levels at most."""
    depth = sum((F.when(n > FANOUT**k, 1).otherwise(0) for k in range(DEPTH)), F.lit(0))

    def above(levels: Column, k: Column) -> Column:
        below = F.element_at(levels, k)
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / FANOUT).cast("int"))
        return F.concat(levels, F.array(F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(below, r * FANOUT + 1, FANOUT), ""), 256))))

    return F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(1), depth), F.array(nodes), above)


def _siblings(nodes: Column, at: Column) -> Column:
    """The other nodes of the run that holds the node numbered ``at`` (from 0): those before it, those behind it."""
    within = at % FANOUT
    before = F.array_join(F.slice(nodes, at - within + 1, within), "")
    return F.struct(before.alias("before"), F.array_join(F.slice(nodes, at + 2, FANOUT - 1 - within), "").alias("after"))


def _blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """key, block, n, rows (nodes in order), and root: the node that the block collapses to."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "hash", *payload)))
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    found = nodes.groupBy("key", block).agg(F.max("n").alias("n"), rows.alias("rows"))
    return found.withColumn("root", F.element_at(F.element_at(_levels(F.col("rows.hash"), F.col("n")), -1), 1))


def tree(nodes: DataFrame, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of nodes (key, pos, n, hash, ``payload``): blocks with the path above them and their key's root; each key's root.

    The paths of nodes are left to ``paths``, so that what is joined to a block is joined before its nodes are apart.
    """
    blocks = materialize(_blocks(nodes, payload), "merkle-blocks")
    done = blocks.filter(F.col("n") <= BLOCK)
    roots = done.select("key", "root")
    top = done.withColumn("above", F.array().cast(f"array<{_STEP}>"))
    if blocks.filter(F.col("n") > BLOCK).isEmpty():
        return top, roots
    open_ = blocks.filter(F.col("n") > BLOCK)
    upper = open_.select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("hash"))
    higher, more = tree(upper, [])
    steps = materialize(paths(higher, []).select("key", F.col("pos").alias("block"), F.col("path").alias("above"), "root"), "merkle-paths")
    return top.unionByName(open_.drop("root").join(steps, ["key", "block"])), roots.union(more)


def paths(blocks: DataFrame, payload: list[str], extra: list[str] | None = None) -> DataFrame:
    """Every node of blocks with its path: key, pos, hash, ``payload``, ``extra`` columns of the block, path, root."""
    extra = extra or []
    levels = blocks.withColumn("levels", _levels(F.col("rows.hash"), F.col("n")))

    def run(r: Column) -> Column:
        steps = [_siblings(F.get("levels", F.lit(k)), F.floor(r / FANOUT ** (k - 1)).cast("int")) for k in range(1, DEPTH)]
        upper = F.slice(F.array(*steps), F.lit(1), F.greatest(F.size("levels") - 2, F.lit(0)))
        return F.struct(F.slice("rows", r * FANOUT + 1, FANOUT).alias("rows"), F.concat(upper, F.col("above")).alias("above"))

    numbers = F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / FANOUT).cast("int"))
    alone = (F.size("levels") == 1).alias("alone")
    runs = levels.select("key", "root", *extra, alone, F.explode(F.transform(numbers, run)).alias("run"))

    def node(x: Column, i: Column) -> Column:
        own = F.array(_siblings(F.transform(F.col("run.rows"), lambda y: y["hash"]), i))
        return F.struct(x.alias("row"), F.when(F.col("alone"), F.col("run.above")).otherwise(F.concat(own, F.col("run.above"))).alias("path"))

    nodes = runs.select("key", "root", *extra, F.explode(F.transform("run.rows", node)).alias("node"))
    return nodes.select("key", *[F.col(f"node.row.{c}").alias(c) for c in ("pos", "hash", *payload)], *extra, F.col("node.path").alias("path"), "root")


def manifest(docs: DataFrame, text_again: Column | None = None) -> DataFrame:
    """Each row of ``docs`` with its place in the trees: doc_id, leaf, again, path, subroot, root.

    ``path`` holds the siblings before and behind the node on each level, from the leaf to the root; ``again`` is the leaf
    of a row whose text is ``text_again`` (its own text by default), to be folded with ``path``.

    A null is a value of its own in a leaf, and null sources are a source, the first one. An empty text is a text of 0
    bytes. Rows of one id are in the order of their leaves (null ids first); equal rows are leaves of equal digests at
    places of their own. A source of one row has that leaf as its subroot. An empty table gives no rows. Of other columns
    none is read.
    """
    source = col("source").cast("string")
    fields = [col("doc_id"), source, col("lang"), col("n_chars")]
    own = leaf(*fields, col("text"))
    again = own if text_again is None else leaf(*fields, text_again)
    key = F.coalesce(F.concat(F.lit("="), source), F.lit("-"))  # bytewise, null first
    rows = materialize(docs.select(key.alias("key"), col("doc_id").alias("doc_id"), own.alias("hash"), again.alias("again")), "merkle-leaves")
    ordered = placed(rows, ["doc_id", "hash"])
    blocks, roots = tree(ordered, ["doc_id", "again"])
    forget(rows)
    forget(ordered)
    subroots = materialize(roots.select(F.lit("").alias("key"), F.col("key").alias("source_key"), F.col("root").alias("hash")), "merkle-sources")
    over, _ = tree(placed(subroots, ["source_key"]), ["source_key"])
    up = paths(over, ["source_key"]).select(F.col("source_key").alias("key"), F.col("hash").alias("subroot"), F.col("path").alias("source_path"), F.col("root").alias("top"))
    up = materialize(up, "merkle-up")
    whole = blocks.join(up, "key").withColumn("above", F.concat("above", "source_path"))
    found = paths(whole, ["doc_id", "again"], ["subroot", "top"])
    return found.select("doc_id", F.col("hash").alias("leaf"), "again", "path", "subroot", F.col("top").alias("root"))


def verified(docs: DataFrame, text_again: Column | None = None) -> DataFrame:
    """``manifest`` with each path put to use: doc_id, leaf, subroot, root, proof_sha256 (the digest of all siblings),
    folded_root (from the leaf of the changed text and the siblings), verified."""
    rows = manifest(docs, text_again).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), fold(F.col("again"), F.col("path")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC = "list_reduce(list_prepend(4294967295, list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii({0}[i]) AS BIGINT))), lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))"


def oracle_sql() -> str:
    """The same by recursive queries over levels."""
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)")
    one = lambda f: f"coalesce(concat(strlen({f}), ':', {f}) || CASE WHEN {f} IS NULL THEN NULL ELSE '' END, '-')"
    head = " || ".join(one(f) for f in fields)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    crc = f"(4294967295 - {_CRC.format('CAST(doc_id AS VARCHAR)')})"

    def up(name: str, start: str) -> str:
        return f"""{name} AS (SELECT 0 AS level, key, pos, hash, n FROM {start} UNION ALL
  SELECT level + 1, key, pos // {FANOUT}, sha256(string_agg(hash, '' ORDER BY pos)), (n + {FANOUT - 1}) // {FANOUT} FROM {name} WHERE n > 1 GROUP BY level, key, pos // {FANOUT}, n)"""

    def steps(name: str, start: str) -> str:
        return f"""{name} AS (SELECT s.key, s.pos, p.level, coalesce(string_agg(x.hash, '' ORDER BY x.pos) FILTER (WHERE x.pos < p.pos), '') AS before,
    coalesce(string_agg(x.hash, '' ORDER BY x.pos) FILTER (WHERE x.pos > p.pos), '') AS after
  FROM {start} s JOIN {start}_up p ON p.key = s.key AND p.n > 1 AND p.pos = s.pos // CAST({FANOUT} ** p.level AS BIGINT)
  JOIN {start}_up x ON x.key = p.key AND x.level = p.level AND x.pos // {FANOUT} = p.pos // {FANOUT} GROUP BY s.key, s.pos, p.level, p.pos)"""

    return f"""WITH RECURSIVE d AS (SELECT *, sha256({head} || {one("text")}) AS hash,
    CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN sha256({head} || {one(f"translate(text, '{upper}', '{lower}')")}) END AS again FROM documents),
leaves AS (SELECT coalesce('=' || source, '-') AS key, doc_id, hash, coalesce(again, hash) AS again,
    row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, hash)),
{up("leaves_up", "leaves")},
subs AS (SELECT '' AS key, key AS source_key, hash, row_number() OVER (ORDER BY encode(key)) - 1 AS pos, count(*) OVER () AS n FROM leaves_up WHERE n = 1),
{up("subs_up", "subs")},
{steps("own", "leaves")},
{steps("top", "subs")},
path AS (SELECT key, pos, level, before, after FROM own UNION ALL
  SELECT l.key, l.pos, 1000 + t.level, t.before, t.after FROM leaves l JOIN subs s ON s.source_key = l.key JOIN top t ON t.pos = s.pos),
numbered AS (SELECT *, row_number() OVER (PARTITION BY key, pos ORDER BY level) AS k FROM path),
folded AS (SELECT key, pos, 0 AS k, again AS hash FROM leaves UNION ALL
  SELECT f.key, f.pos, f.k + 1, sha256(p.before || f.hash || p.after) FROM folded f JOIN numbered p ON p.key = f.key AND p.pos = f.pos AND p.k = f.k + 1),
last AS (SELECT key, pos, arg_max(hash, k) AS folded_root FROM folded GROUP BY key, pos),
proofs AS (SELECT key, pos, sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM path GROUP BY key, pos)
SELECT l.doc_id, l.hash AS leaf, s.hash AS subroot, r.hash AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = r.hash AS verified
FROM leaves l JOIN subs s ON s.source_key = l.key JOIN (SELECT hash FROM subs_up WHERE n = 1) r ON true
JOIN last z ON z.key = l.key AND z.pos = l.pos LEFT JOIN proofs p ON p.key = l.key AND p.pos = l.pos"""
