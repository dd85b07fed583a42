"""Language ID against plain counts: lists of n-grams in dicts, and out-of-place sums."""

from collections import Counter

import pyarrow.parquet as pq

from dugout.llm import langid

SMALL = "/root/testdata/sf0.001/documents.parquet"


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    found = Counter()
    for w in words:
        padded = f" {w} "
        found.update(w)
        found.update(padded[i : i + 2] for i in range(len(padded) - 1))
        found.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return found


def best(counts):
    code = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][: langid.RANKS]


def predicted(text, profiles):
    own = best(grams(text))
    if not own:
        return "und", 0.0
    apart = {lang: sum(abs(ranks[g] - i) if g in ranks else langid.RANKS for i, g in enumerate(own)) for lang, ranks in profiles.items()}
    alike = {lang: 1 - d / (langid.RANKS * len(own)) for lang, d in apart.items()}
    first = min(sorted(apart), key=apart.get)
    return first, alike[first] / sum(alike.values()) if sum(alike.values()) else 1 / len(alike)


def test_same_as_plain_counts(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in pq.read_table(SMALL).to_pylist()]
    odd = [None, "", "12 34 !?", "a", "ÄÖ ßß ßß", "日本語 日本", "ZZZZ zzzz", "the the the the"]
    rows += [(10_000 + i, t, [None, "xx"][i % 2]) for i, t in enumerate(odd)] + [rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sums = {}
    for _, text, lang in rows:
        if lang is not None and grams(text):
            sums.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: {g: i for i, g in enumerate(best(counts))} for lang, counts in sums.items()}
    learned = langid.learn_profiles(docs)
    assert learned.langs == sorted(profiles)
    got = langid.predict(docs, learned, keep=["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, score = predicted(r["text"], profiles)
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-9
