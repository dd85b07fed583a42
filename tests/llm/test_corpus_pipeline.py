"""The pipeline's stages, each over what the one before it kept, against plain versions; and over an empty table."""

import importlib.util
import zlib

import duckdb
import pyarrow.parquet as pq
import pytest

import plain
from dugout.llm import mixing, quality, secrets

pipeline = pytest.importorskip("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") else pytest.skip("no pipeline", allow_module_level=True)


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: r["doc_id"])


def test_stages_against_plain_versions(spark, odd_dir, tmp_path):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality", "simhash", "secrets", "mixing", "bpe"]

    def staged(name, before):
        path = str(tmp_path / name)
        stages[name](spark, before, odd_dir).write.parquet(path)
        return spark.read.parquet(path)

    # rejected documents go: the same model, applied text by text
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{odd_dir}/labels.parquet").to_pylist() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    texts = {r["doc_id"]: r["text"] or "" for r in rows(docs)}
    taught = sorted(i for i in labels if i in texts)
    model = quality.fit([quality.features(texts[i]) for i in taught], pipeline.quality.np.array([labels[i] for i in taught]))
    good = staged("quality", docs)
    assert good.columns == docs.columns
    assert rows(good) == [r for r in rows(docs) if model.score(r["text"] or "") >= 0.3]

    one = staged("simhash", good)
    least = plain.near_copies({r["doc_id"]: r["text"] for r in rows(good)})
    assert rows(one) == [r for r in rows(good) if least[r["doc_id"]] == r["doc_id"]]

    clean = staged("secrets", one)
    cuts = secrets.learn_cuts(one)
    for before, after in zip(rows(one), rows(clean), strict=True):
        text = before["text"]
        wanted = text and secrets.redact_text(text, secrets.scan_text(text, cuts))
        assert after == before | {"text": wanted, "n_chars": before["n_chars"] if text is None else len(wanted)}
        assert not any(k == "access" for k, _, _ in plain.base_spans(after["text"]))

    mixed = staged("mixing", clean)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/secrets/*.parquet'")
        kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({mixing.oracle_sql()}) WHERE kept").fetchall()}
    assert rows(mixed) == [r for r in rows(clean) if r["doc_id"] in kept] and 0 < len(kept)

    library = plain.library()
    for r, d in zip(rows(staged("bpe", mixed)), rows(mixed), strict=True):
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        assert (r["doc_id"], r["ids"], r["n_tokens"]) == (d["doc_id"], ids, len(ids))
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_empty(spark, empty_dir):
    assert pipeline.run(spark, empty_dir).collect() == []
