"""Plain versions of the operators' results, and small inputs with awkward rows."""

import hashlib
from collections import Counter

import numpy as np
import xxhash

EXTRA = {"fp": "x", "n": 1, "score": 0.5, "t": 3, "size": 4, "state": "same", "kept": False, "train": True, "path": "p", "batch": None}
SCHEMA = "doc_id bigint, text string, lang string, source string, fp string, n int, score double, t int, size int, state string, kept boolean, path string, batch string"


def awkward(spark, texts):
    """A table of (doc_id, text) with other columns whose names the operators use themselves, partly null."""
    rows = []
    for k, (i, text) in enumerate(texts):
        spare = (None,) * 9 if k % 3 == 0 else ("x", 1, 0.5, 3, 4, "same", False, "p", None)
        rows.append((i, text, None if k % 4 == 0 else "en", None if k % 5 == 0 else "src0", *spare))
    return spark.createDataFrame(rows, SCHEMA)


TEXTS = [
    (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, None), (4, ""), (5, "  \n\t "), (6, "A B C D"), (7, "a  b c d"), (8, "ab c d"), (9, "a b c d"),
    (9, "a b c d"), (10, "é è ê ü ñ " * 30), (11, "word " * 4000), (12, "word " * 4000), (None, None), (None, "alone without an id"), (13, "123 456 !!"), (13, "the same id again"),
]


def union(nodes, pairs):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[top(a)] = top(b)
    return {n: top(n) for n in nodes}


def fingerprint(text, width=3):
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in (text or "").encode().split()]
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < width else [b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingle_set(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def repeats(sequences, width, join):
    """(length, removed, runs, sha256 of what is kept) per sequence."""
    seen = Counter(join(s[p : p + width]) for s in sequences for p in range(len(s) - width + 1))
    out = []
    for s in sequences:
        gone = np.zeros(len(s), bool)
        for p in range(len(s) - width + 1):
            if seen[join(s[p : p + width])] > 1:
                gone[p : p + width] = True
        kept = [s[k : k + 1] if isinstance(s, bytes) else s[k] for k in np.flatnonzero(~gone)]
        runs = int(gone[0]) + int((np.diff(gone.astype(int)) == 1).sum()) if len(s) else 0
        out.append((len(s), int(gone.sum()), runs, hashlib.sha256(join(kept) if not isinstance(s, bytes) else b"".join(kept)).hexdigest()))
    return out
