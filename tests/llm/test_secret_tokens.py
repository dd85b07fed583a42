"""Random values glued to names, in mixed runs, short or without digits; and cuts over distinct tokens."""

import numpy as np
import pytest

from dugout.llm import secrets


def drawn(rng, alphabet, n, fits=lambda t: True):
    """A random value that the battery doesn't reject by chance."""
    while True:
        value = "".join(rng.choice(list(secrets.ALPHABETS[alphabet]), n))
        if fits(value) and secrets.randomness(value) > 0.3:
            return value


def found(text):
    cuts = dict.fromkeys(range(secrets.N_STRATA), 0.2)
    return [text[a:b] for a, _, b, _ in secrets.scan_text(text, cuts)]


def test_values_glued_to_names():
    rng = np.random.default_rng(21)
    for n in (16, 20, 24, 40):
        value = drawn(rng, "base62", n)
        for text in (f"AWS_ACCESS_VALUE={value}", f"GET /path?client={value}&sig=x", f"export client_value={value} more", f"a={value}=b"):
            assert found(text) == [value]
        assert found(f"value={value}==") == [f"{value}=="]


def test_values_in_mixed_runs():
    rng = np.random.default_rng(22)
    signed = drawn(rng, "base64", 40, lambda t: "/" in t[1:-1] and "+" in t)
    assert found(f"my_name-{signed}") == [signed]
    signed = drawn(rng, "base64url", 40, lambda t: "-" in t[1:-1] and "_" in t)
    assert found(f"/static/files/{signed}") == [signed]
    assert found("/usr/local_dir/some-folder/with_long-names/and/more_of-them") == []


def test_values_without_digits():
    rng = np.random.default_rng(23)
    value = drawn(rng, "base62", 24, lambda t: not any(c.isdigit() for c in t))
    assert found(f"see {value} there") == [value]
    assert found("auxleouelleanque thanatlyreennder Donaudampfschifffahrtsgesellschaft") == []


@pytest.mark.parametrize("length", [15, 16])
def test_short_values(length):
    value = drawn(np.random.default_rng(24), "base62", length, lambda t: any(c.isdigit() for c in t))
    assert found(f"x {value} y") == ([value] if length >= 16 else [])


def test_cuts_count_distinct_tokens(spark):
    rng = np.random.default_rng(25)
    letters = list(secrets.ALPHABETS["base62"])
    true = ["1" + "".join(rng.choice(letters, 39)) for _ in range(600)]
    copied = next(t for t in true if 0.28 < secrets.randomness(t) < 0.32)
    high = next(t for t in true if secrets.randomness(t) > 0.9)
    words = [f"aaaabbbbccccdddd{k}aaaabbbbccccdddd" for k in range(300)]
    docs = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    once = secrets.learn_cuts(docs(true + words))
    for token in (copied, high):
        assert secrets.learn_cuts(docs(true + words + [f"{token} and {token}"] * 3000)) == once
    assert max(once.values()) < 0.3


def test_planted_secrets_and_false_discoveries(spark):
    """Of planted random values nearly all are found, beside the base spans that hold some; of what is found few are words."""
    rng = np.random.default_rng(26)
    letters = list(secrets.ALPHABETS["base62"])
    planted = ["".join(rng.choice(letters, int(rng.integers(20, 60)))) for _ in range(800)]
    words = ["".join(rng.choice(["ba", "na", "tra", "le", "se"], int(rng.integers(9, 16)))) + str(int(rng.integers(10))) for _ in range(800)]
    rows = [(i, f"{'password: ' if i % 4 == 0 else 'see '}{p} and {w} there") for i, (p, w) in enumerate(zip(planted, words, strict=True))]
    hits = wrong = 0
    for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found = {r["text"][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "random"}
        hits += planted[r["doc_id"]] in found
        wrong += len(found - {planted[r["doc_id"]]})
    assert hits > 0.9 * len(planted) and wrong < 0.1 * (hits + wrong)
