"""Fingerprints against a rolling hash byte by byte and edit distances in a table."""

import random

import xxhash

from dugout.llm import ctph

ODD = ["", "a", "ab" * 3000, "é" * 500, "\x00" * 5000, "line one\n" * 4000, "🙂 ü" * 700, "x" * 100_000]


def rolled(data):
    out = []
    for i in range(len(data)):
        h = sum(data[i - k] * int(ctph.AGES[k]) for k in range(min(ctph.WINDOW, i + 1))) % 2**32
        h ^= h >> 15
        h = h * 0x2C1B3C6D % 2**32
        out.append(h ^ h >> 13)
    return out


def signature(data, ends):
    cuts, apart = [], len(data) / 128 if len(ends) > 128 else 0
    for e in ends:
        if e + 1 - (cuts[-1] if cuts else 0) >= apart:
            cuts.append(e + 1)
    bounds = [0, *cuts] + ([len(data)] if (cuts or [0])[-1] < len(data) else [])
    return "".join(ctph.LETTERS[xxhash.xxh32_intdigest(data[a:b]) % 64] for a, b in zip(bounds, bounds[1:], strict=False))


def fingerprint(text):
    data = text.encode()
    h, blocks = rolled(data), [3 * 2**k for k in range(24)]
    ends = {b: [i for i, x in enumerate(h) if x % b == b - 1] for b in blocks}
    block = max((b for b in blocks[:-1] if len(ends[b]) >= 32), default=3)
    return f"{block}:{signature(data, ends[block])}:{signature(data, ends[2 * block])}"


def alike(a, b):
    if a == b:
        return 1.0
    k = min(4, len(a), len(b))
    if not k or not {a[i : i + k] for i in range(len(a) - k + 1)} & {b[i : i + k] for i in range(len(b) - k + 1)}:
        return 0.0
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row = row, [i]
        for j, d in enumerate(b, 1):
            row.append(last[j - 1] if c == d else 1 + min(last[j], row[-1]))
    return 1 - row[-1] / (len(a) + len(b))


def test_fingerprints():
    r = random.Random(9)
    texts = ODD + [" ".join(r.choice(["alpha", "beta", "gamma", "ß", str(r.random())]) for _ in range(n)) for n in (1, 5, 40, 200, 1500)]
    for t in texts:
        assert ctph.fingerprint(t) == fingerprint(t)


def test_likeness():
    r = random.Random(3)
    for _ in range(200):
        a = "".join(r.choice("ABCD") for _ in range(r.randint(0, 64)))
        b = "".join(c for c in a if r.random() < 0.9) + "".join(r.choice("ABCD") for _ in range(r.randint(0, 9)))
        assert abs(ctph.signature_likeness(a, b) - alike(a, b)) < 1e-12


def test_the_whole_text_counts():
    """Half of a long text replaced shows, also where lines repeat."""
    r = random.Random(5)
    words = lambda n: " ".join(str(r.random()) for _ in range(n))
    for text in ("the same line over and over again\n" * 2000, words(4000)):
        edited = text[: len(text) // 2] + words(len(text))[: len(text) - len(text) // 2]
        assert ctph.likeness(ctph.fingerprint(text), ctph.fingerprint(edited)) < 0.8
    text = words(3000)
    small = text[:20_000] + "one word more" + text[20_000:]
    assert ctph.likeness(ctph.fingerprint(text), ctph.fingerprint(small)) > 0.8
