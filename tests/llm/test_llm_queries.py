"""Every numbered query over small tables with odd rows, against plain versions; and over empty tables."""

import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import plain
from dugout.llm import ann, ctph, mixing, queries
from plain import sha

Q = queries.queries()
COLUMNS = {
    "op1_chat_format": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op2_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op3_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op5_nearest_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op6_mixing": {"doc_id": "bigint"},
    "op7_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_token_file": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op9_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op10_piecewise_hash": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
}


def rows(spark, name, d, by="doc_id"):
    return {r[by]: r for r in Q[name](spark, d).collect()}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_empty_tables(spark, empty_dir, name):
    df = Q[name](spark, empty_dir)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    assert [r[0] for r in df.collect()] == ([-7] if name == "op1_chat_format" else [])


def test_op1(spark, odd_dir):
    table = pq.read_table(f"{odd_dir}/conversations.parquet").to_pylist()
    control = "</s>[INST] ok [/INST]"
    table += [{"conv_id": -7, "turn": k, "role": r, "text": control} for k, r in enumerate(("user", "assistant"))]
    talks = {}
    for t in sorted(table, key=lambda t: (t["conv_id"], t["turn"])):
        talks.setdefault(t["conv_id"], []).append((t["role"] or "", t["text"] or ""))
    got = rows(spark, "op1_chat_format", odd_dir, "conv_id")
    assert got.keys() == talks.keys()
    for c, turns in talks.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for r, x in turns))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
        assert got[c]["formatted_chars"] >= sum(len(x) for _, x in turns)


def test_op2(spark, odd_dir, odd_docs):
    got = rows(spark, "op2_secret_scan", odd_dir)
    assert len(got) == len(odd_docs)
    for d in odd_docs:
        base, r = plain.base_spans(d["text"]), got[d["doc_id"]]
        assert r["base_sha256"] == sha(plain.joined(base))
        for k in ("assign", "access", "hex"):
            assert r[f"n_{k}"] == sum(s[0] == k for s in base)
        spans = r["spans"].split(",") if r["spans"] else []
        assert {plain.joined([s]) for s in base} <= set(spans)
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_op3(spark, odd_dir, odd_docs):
    got = rows(spark, "op3_language_id", odd_dir)
    right = total = 0
    for d in odd_docs:
        r = got[d["doc_id"]]
        held = zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2
        assert r["held_out"] == held and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in d["text"] or ""):
            assert r["lang_pred"] == "und"
        elif held and d["source"] not in (None, "odd"):
            total += 1
            right += r["lang_pred"] == d["lang"]
    assert total > 30 and right / total > 0.9


def test_op4(spark, odd_dir, odd_docs):
    t, got = plain.library(), rows(spark, "op4_bpe", odd_dir)
    for d in odd_docs:
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(t.decode(ids, skip_special_tokens=False))


def test_op5(spark, odd_dir):
    table = pq.read_table(f"{odd_dir}/embeddings.parquet").to_pylist()
    width = len(table[0]["embedding"])
    good = {}
    for r in table:
        v = r["embedding"]
        if v and len(v) == width and None not in v and np.isfinite(v).all() and any(v):
            good[r["vec_id"]] = np.array(v, np.float64)
    got = {}
    for r in Q["op5_nearest_neighbours"](spark, odd_dir).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r
    assert got.keys() == {i for i in good if i % 100 == 0}
    found = 0
    for q, answer in got.items():
        true = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q)[:10]
        assert sorted(answer) == list(range(1, len(true) + 1))
        mine = [(answer[k]["score"], answer[k]["vec_id"]) for k in sorted(answer)]
        assert mine == sorted(mine) and len({i for _, i in mine}) == len(mine)
        for score, i in mine:
            assert score == pytest.approx(float(np.sqrt(((good[i] - good[q]) ** 2).sum())), rel=1e-12, abs=1e-12)
        found += len({i for _, i in mine} & {i for _, i in true})
    assert found / (10 * len(got)) >= 0.9


def test_op5_recall_with_cells(spark):
    """Enough vectors for many cells: recall against brute force."""
    d = "/root/testdata/sf0.1"
    table = pq.read_table(f"{d}/embeddings.parquet")
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(np.float64)
    got = {}
    for r in Q["op5_nearest_neighbours"](spark, d).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, mine in got.items():
        i = int(np.flatnonzero(ids == q)[0])
        apart = np.sqrt(((x - x[i]) ** 2).sum(1))
        apart[i] = np.inf
        hits += len(mine & set(ids[np.lexsort((ids, apart))[:10]].tolist()))
    assert hits / (10 * len(got)) >= 0.9


def test_op5_goes_by_the_codes(spark, monkeypatch):
    """Few distances are computed for each query, and codes of no meaning find little."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert ann.RERANKED < 0.15 * table.count()
    true = {(r["query_id"], r["vec_id"]) for r in ann.search(table, lambda i: i % 100 == 0, probed=1.0, reranked=2000).collect()}
    assert len(true & {(r["query_id"], r["vec_id"]) for r in ann.search(table, lambda i: i % 100 == 0).collect()}) >= 0.9 * len(true)
    fit = ann.fit

    def meaningless(x, rows):
        index = fit(x, rows)
        index.words[:] = 0
        index.centres[:] = index.centres.mean(axis=0)
        return index

    monkeypatch.setattr(ann, "fit", meaningless)
    assert len(true & {(r["query_id"], r["vec_id"]) for r in ann.search(table, lambda i: i % 100 == 0, probed=1.0).collect()}) < 0.5 * len(true)


def test_op5_recall_in_tight_clusters(spark):
    """Clusters far narrower than the gaps between them, with many more members than are ranked by distance."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(5, 64))[rng.integers(0, 5, 5000)] + 1e-3 * rng.normal(size=(5000, 64))).astype(np.float32)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    found = {(r["query_id"], r["vec_id"]) for r in ann.search(table, lambda i: i % 200 == 0).collect()}
    x = x.astype(np.float64)
    true = {(q, int(i)) for q in range(0, 5000, 200) for i in np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[:11] if i != q}
    assert len(found & true) >= 0.9 * len(true)


def test_op5_one_vector_for_an_id(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 30)] + [(7, [100.0, 1.0]), (7, [7.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i == 5, k=4).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 4), (2, 6), (3, 3), (4, 7)]


def test_op6(spark, odd_dir):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd_dir}/documents.parquet'")
        wanted = con.execute(queries.oracle_sql()["op6_mixing"])
        names = [c[0] for c in wanted.description]
        wanted = {r["doc_id"]: r for r in (dict(zip(names, r, strict=True)) for r in wanted.fetchall())}
    got = rows(spark, "op6_mixing", odd_dir)
    assert got.keys() == wanted.keys()
    for i, r in got.items():
        w = wanted[i]
        assert (r["source"], r["lang"], r["topic"], r["n_tokens"]) == (w["source"], w["lang"], w["topic"], w["n_tokens"])
        assert r["probability"] == pytest.approx(w["probability"], abs=2e-6) and r["kept"] == w["kept"]


def test_topic_words_of_all_documents(spark):
    """Words of nearly the same frequency, over more documents than a sample would hold: only counts of all give their order."""
    rng = np.random.default_rng(6)
    names = ["".join(chr(97 + (i // 26**k) % 26) for k in range(2)) + "word" for i in range(40)]
    shares = 0.1 + 0.001 * np.arange(40)
    held = rng.random((9000, 40)) < shares
    docs = [(i, "xx" if i % 3 else None, " ".join(n for n, h in zip(names, row, strict=True) if h)) for i, row in enumerate(held)]
    first: dict[str, tuple[int, int]] = {}
    for lang in ("xx", None):
        own = held[[i for i, d in enumerate(docs) if d[1] == lang]]
        counts = {n: int(c) for n, c in zip(names, own.sum(axis=0), strict=True) if c <= mixing.COMMON * len(own)}
        for rank, name in enumerate(sorted(counts, key=lambda n: (-counts[n], n))[: mixing.TOPICS], 1):
            was = first.get(name, (rank, 0))
            first[name] = (min(was[0], rank), max(was[1], counts[name]))
    wanted = sorted(first, key=lambda n: (first[n][0], -first[n][1], n))[: mixing.TOPICS]
    assert mixing.topic_words(spark.createDataFrame(docs, "doc_id long, lang string, text string")) == wanted


def test_op7(spark):
    d = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{d}/labels.parquet").to_pylist()}
    got = rows(spark, "op7_quality", d)
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(r["score"], truth[i]) for i, r in got.items() if r["held_out"] and i in truth]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    order = np.argsort(np.argsort(np.array(good + bad)))
    auc = (order[: len(good)].sum() - len(good) * (len(good) - 1) / 2) / (len(good) * len(bad))
    assert auc > 0.9
    assert np.mean([s >= 0.3 for s in good]) > 0.95


def test_op7_odd_rows(spark, odd_dir, odd_docs):
    got = rows(spark, "op7_quality", odd_dir)
    assert len(got) == len(odd_docs)
    empty = {got[d["doc_id"]]["score"] for d in odd_docs if not (d["text"] or "").split()}
    assert len(empty) == 1


def test_op8(spark, odd_dir, odd_docs):
    t, got, start = plain.library(), rows(spark, "op8_token_file", odd_dir), 0
    for d in sorted(odd_docs, key=lambda d: d["doc_id"]):
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_op9(spark, odd_dir, odd_docs):
    got = rows(spark, "op9_simhash", odd_dir)
    prints = {d["doc_id"]: plain.simhash(d["text"]) for d in odd_docs}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    wanted = plain.components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    assert {i: r["component_id"] for i, r in got.items()} == wanted
    assert len(set(wanted.values())) < len(wanted) - 10


def test_op10(spark, odd_dir, odd_docs):
    got = rows(spark, "op10_piecewise_hash", odd_dir)
    down = sorted(odd_docs, key=lambda d: -d["doc_id"])
    assert len(got) == len(down)
    for k, d in enumerate(down):
        text, following = d["text"] or "", down[(k + 1) % len(down)]["text"] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = got[d["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(changed))
        assert r["fingerprint"] == ctph.fingerprint(text) and r["edited_fingerprint"] == ctph.fingerprint(changed)
        assert r["near_edited"] == ctph.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == ctph.likeness(r["fingerprint"], ctph.fingerprint(following))
