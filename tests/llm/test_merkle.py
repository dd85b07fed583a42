"""The manifest against a tree built with lists, and against its SQL."""

import hashlib
import zlib

import duckdb
import pytest

from dugout.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, path string, key string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def walk(nodes, at):
    """The root of a list of nodes, and the runs' other nodes on the way up from the one numbered ``at``."""
    path = []
    while len(nodes) > 1:
        first = at // 16 * 16
        path.append((nodes[first:at], nodes[at + 1 : first + 16]))
        nodes, at = [digest(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], at // 16
    return nodes[0], path


def expected(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(((-1 if r[0] is None else r[0]), leaf(r[:5]), r) for r in sources[s]) for s in names}
    leaves = {s: [x[1] for x in ordered[s]] for s in names}
    subroots = [walk(leaves[s], 0)[0] for s in names]
    out = []
    for k, s in enumerate(names):
        for i, (_, own, r) in enumerate(ordered[s]):
            subroot, path = walk(leaves[s], i)
            root, more = walk(subroots, k)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            node = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if changed else own
            for before, after in path + more:
                node = digest(*before, node, *after)
            proof = digest(*(x for before, after in path + more for x in before + after))
            out.append((r[0], own, subroot, root, proof, node, node == root))
    return sorted(out, key=str)


def table(tmp_path, spark, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({merkle.oracle_sql()})").fetchall(), key=str)
    return sorted((tuple(r) for r in got.collect()), key=str), sql


def test_odd_rows(tmp_path, spark):
    """Nulls in every column, equal ids with other texts, repeated rows, sources of one and of no name, names that clash."""
    extra = ("own", "own", "own")
    rows = [(i, f"s{i % 3}", "en", 5, f"Text Äß {i}", *extra) for i in range(120)]
    rows += [(None, "s1", None, None, None, *extra), (None, "s1", None, None, "A null id", *extra), (7, "s1", "en", 1, "Again", *extra), (7, "s1", "en", 0, "", *extra)]
    rows += [(500, None, "en", 1, "No Source", *extra), (501, "", None, 1, "Empty Source", *extra), (502, "é", "", 1, "X" * 50_000, *extra), (503, "-", "-", -1, "-", *extra)]
    rows += [(504, "zz", "en", 1, "Twice", *extra)] * 2
    rows += [(1000 + k, f"many{k}", "en", k, f"One Each {k}", *extra) for k in range(40)]
    got, sql = table(tmp_path, spark, rows)
    assert got == expected(rows) == sql
    assert 0 < sum(r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n", [16, 17, 256, 257, 4097])
def test_sizes_of_a_source(tmp_path, spark, n):
    """Sources of as many rows as fill a run, a block, and more."""
    rows = [(i * 3, "hot", "en", i, f"T{i}", "", "", "") for i in range(n)] + [(1, "one", None, 0, "Only", "", "", "")]
    got, _ = table(tmp_path, spark, rows)
    assert got == expected(rows)


def test_empty(tmp_path, spark):
    got, sql = table(tmp_path, spark, [])
    assert got == sql == []
