"""Plain versions of what the operators compute, over lists, for comparison."""

import hashlib
import re

import xxhash
from tokenizers import Tokenizer

from dugout.llm.queries import vocabulary


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def library():
    t = Tokenizer.from_file(vocabulary())
    t.no_padding()
    t.no_truncation()
    return t


KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(KINDS) for m in p.finditer(text or "") if len(m[g]) >= least]
    return [(KINDS[k][0], a, b) for a, k, b in sorted(found)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def simhash(text, words=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(items, linked):
    """Least member of each item's component, by comparing all pairs."""
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    names = list(items)
    for a in range(len(names)):
        for b in range(a):
            if linked(items[names[a]], items[names[b]]):
                x, y = find(names[a]), find(names[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def shingles(text, words=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def near_copies(texts):
    """Least member of each text's component: all pairs at a Jaccard similarity of 0.8 or more of their five-word shingles."""
    sets = {i: shingles(t) for i, t in texts.items()}

    def linked(a, b):
        x, y = sets[a], sets[b]
        return x == y or len(x & y) >= 0.8 * len(x | y)

    return components({i: i for i in texts}, linked)
