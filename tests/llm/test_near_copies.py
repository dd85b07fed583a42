"""The pipeline's near-copy stage against all pairs by brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

import corpus_pipeline
import plain
from dugout.llm import simhash


def test_stage_finds_edited_copies(spark):
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(2000)]
    texts = []
    for _ in range(25):
        base = rng.choice(vocabulary, 300).tolist()
        texts.append(" ".join(base))
        for edits in (2, 4, 6, 9, 14, 30):  # about 0.94 to 0.33 of the shingles in common
            copy = list(base)
            for at in rng.choice(300, edits, replace=False):
                copy[at] = "edited"
            texts.append(" ".join(copy))
    texts += ["", " ", "one two", "One  two", "two one", " ".join(["again"] * 500), " ".join(["again"] * 500 + ["more"])]
    sets = {i: simhash.shingle_set(t, 5)[:, 0].tobytes() for i, t in enumerate(texts)}
    near = lambda a, b: simhash.similarity(a, b) >= 0.8
    wanted = plain.components(sets, near)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, docs, "").collect())
    assert kept == sorted(i for i in wanted if wanted[i] == i) and len(kept) < len(texts) - 75


def test_chain_in_one_bucket(spark):
    """Members of a bucket that its least isn't similar to are compared with one another too."""
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[k * 15 : k * 15 + 200]) for k in range(8)]
    sets = [simhash.shingle_set(t)[:, 0].tobytes() for t in texts]
    assert simhash.similarity(sets[0], sets[-1]) < 0.8
    wanted = plain.components(dict(enumerate(sets)), lambda a, b: simhash.similarity(a, b) >= 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    assert got == wanted == dict.fromkeys(range(8), 0)


def test_closest_links():
    """As many links as it takes, components as of all pairs, and no link where a chain of nearer ones leads too."""
    rng = np.random.default_rng(2)
    for n in (2, 3, 40, 150):
        seeds = rng.integers(0, 1 << 63, (4, 4), dtype=np.uint64)
        prints = seeds[rng.integers(0, 4, n)].copy()
        for row in prints:
            for bit in rng.integers(0, 256, rng.integers(0, 34)):
                row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        apart = lambda a, b: int(np.bitwise_count(a ^ b).sum())
        rows = {i: i for i in range(n)}
        wanted = plain.components(rows, lambda a, b: apart(prints[a], prints[b]) <= 56)
        a, b = simhash.closest_links(prints, 56)
        at = {p.tobytes(): i for i, p in enumerate(prints)}
        links = {(at[x.tobytes()], at[y.tobytes()]) for x, y in zip(a, b, strict=True)}
        got = plain.components(rows, lambda x, y: (prints[x] == prints[y]).all() or (x, y) in links or (y, x) in links)
        assert got == wanted and len(a) == n - len(set(wanted.values()))


@pytest.fixture
def in_process(monkeypatch):
    """Arrow functions run in this process, so that a test can count what they call."""

    def run(df, function, schema):
        kind = to_arrow_schema(T._parse_datatype_string(schema))
        return df.sparkSession.createDataFrame(pa.Table.from_batches(list(function(iter(df.toArrow().to_batches()))), kind), schema)

    monkeypatch.setattr(DataFrame, "mapInArrow", run)


@pytest.mark.parametrize("small", [128, 8])
@pytest.mark.parametrize("across", [False, True])
def test_chance_members_of_buckets(spark, in_process, monkeypatch, small, across):
    """The links are those of each whole bucket by itself; but for large buckets only members near others are searched."""
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 64, (1500, simhash.PRINTS), np.uint64)
    for k in range(0, 60, 6):  # ten groups of six, in which 20 bits or so lie between two
        prints[k : k + 6] = prints[k]
        for row in prints[k + 1 : k + 6]:
            for bit in rng.choice(256, 10, replace=False):
                row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    signed = prints.view(np.int64)
    roots = np.arange(len(prints)) % 3
    masks = [simhash.narrowed(simhash.covering_masks(5), 6, word)[:3] for word in range(simhash.PRINTS)]

    wanted, search, at = set(), simhash.closest_links, np.lexsort(signed.T[::-1])
    for word, own in enumerate(masks):
        for mask in own:
            key = signed[at, word] & mask
            for some in (at[key == k] for k in np.unique(key)):
                a, b = simhash.nearest_across(prints[some], roots[some], 56) if across else search(prints[some], 56)
                wanted |= {frozenset((x.tobytes(), y.tobytes())) for x, y in zip(a, b, strict=True)}

    calls = []
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "closest_links", lambda p, radius: calls.append(len(p)) or search(p, radius))
    rows = [(*p, r) for p, r in zip(signed.tolist(), roots.tolist(), strict=True)]
    table = spark.createDataFrame(rows, [*simhash._WORDS, "root"]).drop(*["root"] * (not across))
    found = simhash.colliding(table, masks, 56, "test-buckets", across).collect()
    assert {frozenset(np.array(x, np.int64).tobytes() for x in (r[:4], r[4:])) for r in found} == wanted and wanted
    if small == 128:
        assert sum(calls) <= 60 * 3 * simhash.PRINTS


def test_texts_are_joined_by_the_number_of_nodes(spark, monkeypatch):
    """Pairs, which are several for a node, don't decide whether the texts are shuffled."""
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(8):
        base = rng.integers(0, 3000, 250).astype(str)
        for _ in range(6):
            copy = base.copy()
            copy[rng.integers(250)] = "x"
            texts.append(" ".join(copy))
    asked, sets_of = [], simhash._sets_of
    monkeypatch.setattr(simhash, "_sets_of", lambda source, wanted, n, words: asked.append((n, wanted.count())) or sets_of(source, wanted, n, words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in simhash.near_copies(docs).collect()} == set(range(0, 48, 6))
    assert asked == [(48, 48)]
