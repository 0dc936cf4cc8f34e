import random

import brute
import numpy as np
import pytest
from loreforge.llm import words as W
from loreforge.llm.substring import _greedy, op4_substring_dedup, substring_dedup


def check(spark, rows, window=35, kind="long"):
    got = substring_dedup(spark.createDataFrame(rows, f"doc_id {kind}, text string"), window=window).collect()
    want = Counter2((i, n, " ".join(k)) for (i, _), (n, k) in zip(rows, brute.substring(rows, window), strict=True))
    assert Counter2((r.doc_id, r.n_words, r.kept_text) for r in got) == want
    for r in got:
        assert r.n_removed <= sum(f.length for f in r.factors)
        assert (r.n_removed > 0) == bool(r.factors)
    words = {r.row: brute.words(t) for r in got for i, t in rows if i == r.doc_id and len(brute.words(t)) == r.n_words}
    for r in got:
        for f in r.factors:  # every factor stands, whole or window by window, in the text that it names
            mine, ref = words[r.row][f.start : f.start + f.length], words[f.ref_row]
            some = {tuple(ref[i : i + window]) for i in range(len(ref) - window + 1)}
            assert sum(tuple(mine[i : i + window]) in some for i in range(len(mine) - window + 1)) >= 1


def Counter2(x):
    from collections import Counter

    return Counter(x)


def test_planted(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(80)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 200))]
        if i % 3 == 0:
            lo = rng.randint(0, 40)
            at = rng.randint(0, len(w))
            w[at:at] = passage[lo : lo + rng.randint(30, 40)]
        rows.append((i, " ".join(w)))
    rows += [(60, rows[1][1]), (1, rows[1][1]), (None, rows[2][1]), (None, None), (61, ""), (62, " \t\n"), (63, "aa " * 90), (64, "aa bb " * 40), (65, "x" * 9000 + " y"), (66, None)]
    check(spark, rows)
    check(spark, rows, window=8)
    check(spark, [(None if i is None else f"d{i}", t) for i, t in rows], kind="string")


def test_greedy_takes_the_longest():
    start, end = np.array([0, 5, 9, 20]), np.array([4, 8, 12, 25])
    refs = [(1, 2), (2, 3), (2, 3), (7, 9)]
    assert list(_greedy(start, end, refs, own=9)) == [(0, 12, 2), (20, 25, 7)]
    assert list(_greedy(start, end, [(1, 1), (2, 3), (3, 3), (9, 9)], own=9)) == [(0, 4, 1), (5, 12, 3), (20, 25, 9)]


def test_hot_rows(spark):
    # one id for all, no id for many, the same row again and again
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(1, same)] * 50 + [(None, same)] * 50 + [(1, f"own {i} " + same) for i in range(30)] + [(None, f"n{i} " * 40) for i in range(20)]
    check(spark, rows)
    check(spark, [(3, "long " * 200_000), (4, " ".join(f"u{i}" for i in range(100_000)))])


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(df).count() == 0
    df = spark.createDataFrame([(1, "a b", "z", 3)], "doc_id long, text string, k1 string, found int")
    assert substring_dedup(df).collect()[0].kept_text == "a b"
    with pytest.raises(ValueError):
        substring_dedup(df, window=65)


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = {(i, n, n - len(k), brute.sha(" ".join(k))) for (i, _), (n, k) in zip(rows, brute.substring(rows), strict=True)}
    assert {tuple(r)[:4] for r in op4_substring_dedup(spark, small).collect()} == want


def test_hash_of_long_words():
    for n in (5, 4096, 4097, 9000):
        a = np.frombuffer(b"q" * n + b" " + b"q" * n, np.uint8)
        s, e, _ = W.spans(a, np.array([0, len(a)]))
        h = W.hashes(a, s, e)
        assert len(h) == 2 and h[0] == h[1]
    a = np.frombuffer(b"a" * 4096 + b"b" * 4096 + b" " + b"b" * 4096 + b"a" * 4096, np.uint8)
    s, e, _ = W.spans(a, np.array([0, len(a)]))
    h = W.hashes(a, s, e)
    assert h[0] != h[1]
