"""Vector codes against all distances: the bounds alone, then the query."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from dugout.llm import queries, vectorcode

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x string, of string"


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 16, 70])
@pytest.mark.parametrize("reach", [2, 300, vectorcode.LIMIT // 4])
def test_bounds_lose_no_nearest_entry(width, reach):
    rng = np.random.default_rng(width)
    entries = rng.integers(-reach, reach + 1, (50, width))
    entries[7] = entries[31]  # ties
    x = np.concatenate([rng.integers(-reach, reach + 1, (400, width)), entries, np.zeros((1, width), int)])
    found, error = vectorcode.Bounds(entries).nearest(x)
    apart = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    assert (found == apart.argmin(1)).all() and (error == apart.min(1)).all()


def test_bounds_filter():
    """Most entries go before their exact distance is taken; finer bounds leave fewer of them."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(64, 16)).cumsum(1) * 100  # neighbouring components are alike
    x = (centres[rng.integers(64, size=2000)] + rng.normal(size=(2000, 16)) * 10).astype(np.int64)
    bounds = vectorcode.Bounds(centres.astype(np.int64))
    fine = len(bounds.survivors(x)[0]) / len(x)
    bounds.cuts, bounds.sketches = bounds.cuts[:1], bounds.sketches[:1]
    coarse = len(bounds.survivors(x)[0]) / len(x)
    assert 1 <= fine < coarse < 64 / 8


def plain(rows):
    kept = [r for r in rows if r[1] and all(v is not None and math.isfinite(v) for v in r[1])]
    width = len(kept[0][1]) if kept else 0
    padded = -(-width // 16) * 16
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(np.float32(v).astype(float) * 256) for v in r[1]] + [0] * (padded - width) for r in kept]
    w = padded // 16
    parts = [[tuple(v[p * w : p * w + w]) for v in whole] for p in range(16)]
    books = [list(part[:64]) for part in parts]
    apart = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    assign = lambda: [[min((apart(x, c), e) for e, c in enumerate(books[p])) for x in parts[p]] for p in range(16)]
    for _ in range(2):
        for p, found in enumerate(assign()):
            for e in range(len(books[p])):
                mine = [x for x, (_, at) in zip(parts[p], found, strict=True) if at == e]
                if mine:
                    books[p][e] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    found = assign()
    digest = hashlib.sha256(",".join(str(i) for b in books for e in b for i in e).encode()).hexdigest()
    out, of_label = [], {}
    for i, r in enumerate(kept):
        error = sum(found[p][i][0] for p in range(16))
        of_label[r[2]] = of_label.get(r[2], 0) + error
        out.append((r[0], "".join(f"{found[p][i][1]:02x}" for p in range(16)), error, r[2]))
    return sorted(((a, b, c, of_label[label], digest) for a, b, c, label in out), key=str)


def answers(tmp_path, spark, rows, extra=()):
    spark.createDataFrame([(*r, "own", "own", "own") for r in [*rows, *extra]], SCHEMA).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op12_vector_codes(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def by_sql(tmp_path, columns="vec_id, code, error, label_error, codebooks_sha256"):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    return sorted(con.execute(f"SELECT {columns} FROM ({vectorcode.oracle_sql()})").fetchall(), key=str)


def vectors(n, width, seed=5):
    rng = np.random.default_rng(seed)
    return [(i * 3, [float(np.float32(v)) for v in rng.normal(size=width)], [None, 1, 2, 2, 2][i % 5]) for i in range(n)]


def test_odd_rows(tmp_path, spark):
    """Nulls, NaN, infinities, zeros, equal vectors, repeated rows and ids, null ids."""
    rows = vectors(150, 32)
    rows += [(900, [0.0] * 32, None), (901, rows[4][1], 7), (903, [1e9 / 2**10] + [-3.0] * 31, 7), rows[8], rows[8], (12, rows[80][1], None), (None, rows[3][1], 1)]
    rows += [(910, None, 1), (911, [float("nan")] + [1.0] * 31, 1), (912, [float("inf")] * 32, None), (913, [None] + [1.0] * 31, 1)]
    got = answers(tmp_path, spark, rows)
    assert got == plain(rows) == by_sql(tmp_path)


def test_other_lengths_take_no_part(tmp_path, spark):
    rows = vectors(70, 32)
    assert answers(tmp_path, spark, rows, [(-1, [], 1), (-2, [1.0], 2), (-3, [1.0] * 64, None)]) == plain(rows)


@pytest.mark.parametrize(("n", "width"), [(1, 16), (20, 16), (64, 48), (90, 20)])
def test_few_vectors_and_widths(tmp_path, spark, n, width):
    rows = vectors(n, width)
    assert answers(tmp_path, spark, rows) == plain(rows)


def test_too_large_components(tmp_path, spark):
    rows = [(i, [3e38, -3e38] + [float(i)] * 14, None) for i in range(3)]
    assert [r[:3] for r in answers(tmp_path, spark, rows)] == [(i, "0000" + f"{i:02x}" * 14, 0) for i in range(3)]


def test_empty(tmp_path, spark):
    assert answers(tmp_path, spark, []) == []
