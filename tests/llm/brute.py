"""Plain reference versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

WS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WS.findall(text or "")


def substring(rows, window=35):
    """rows: (id, text). Per row: n_words, kept words."""
    all_words = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in all_words for i in range(len(w) - window + 1))
    out = []
    for w in all_words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), [x for i, x in enumerate(w) if i not in gone]))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
