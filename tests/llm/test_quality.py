import math
import random
from collections import Counter

import numpy as np
import pytest
from loreforge.llm.quality import LEAST_RATIO, PSEUDO, START, estimate, op1_quality_rules, quality, rules

from brute import words


def base(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n")]
    seen, dup = set(), 0
    for x in lines:
        if words(x):
            dup += x in seen
            seen.add(x)
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cov = set()
    for i in range(len(w) - 2):
        if three[tuple(w[i : i + 3])] > 1:
            cov.update((i, i + 1, i + 2))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cov)


def check(got, rows):
    want = Counter((i, *base(t)) for i, t in rows)
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_counts(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(["a", "bé", " ", " ", "\n", "\t", "#", "| ", "x y z ", "\x0b", " ", "日本"]) for _ in range(rng.randint(0, 200)))) for i in range(120)]
    rows += [(5, rows[5][1]), (None, "a b c\na b c\n"), (200, None), (201, ""), (202, "\n\n"), (203, "w" * 9000 + "\n" + "w" * 9000), (204, "x\nx")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, posterior int")
    check(quality(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect(), rows)
    assert quality(df.limit(0)).count() == 0


def test_estimate_recovers_chances():
    rng = np.random.default_rng(1)
    bad = rng.random(60000) < 0.15
    # how often each rule votes bad on bad and on good texts; it abstains on a tenth and else votes good
    on_bad, on_good = np.array([0.9, 0.6, 0.5, 0.7]), np.array([0.02, 0.01, 0.05, 0.03])
    u = rng.random((60000, 4))
    low = np.where(bad[:, None], on_bad, on_good)
    votes = np.where(u < low, -1, np.where(u < low + 0.1 * (1 - low), 0, 1))
    pattern, n = np.unique(votes, axis=0, return_counts=True)
    share, chances = estimate(pattern.astype(float), n.astype(float))
    assert abs(share - 0.85) < 0.02
    assert np.abs(chances[0, 0] - on_bad).max() < 0.05 and np.abs(chances[1, 0] - on_good).max() < 0.02


def plain_posteriors(votes):
    """EM text by text: START, PSEUDO and LEAST_RATIO are the operator's parameters."""
    n_rules = len(votes[0])
    share, ch = 0.85, [[[float(START[y][v])] * n_rules for v in (0, 1)] for y in (0, 1)]
    prior = [(1 - 0.85) * PSEUDO, 0.85 * PSEUDO]
    start = ch
    for _ in range(300):
        post = []
        for row in votes:
            log = [math.log(1 - share), math.log(share)]
            for j, v in enumerate(row):
                if v:
                    for y in (0, 1):
                        log[y] += math.log(ch[y][v > 0][j])
            post.append(1 / (1 + math.exp(max(-500.0, min(500.0, log[0] - log[1])))))
        new = [[[0.0] * n_rules for _ in (0, 1)] for _ in (0, 1)]
        for j in range(n_rules):
            for y in (0, 1):
                part = [start[y][v][j] * prior[y] + sum((p if y else 1 - p) for p, row in zip(post, votes, strict=True) if row[j] and (row[j] > 0) == bool(v)) for v in (0, 1)]
                new[y][0][j], new[y][1][j] = (x / sum(part) for x in part)
            low = min(max(new[0][0][j], LEAST_RATIO * new[1][0][j]), 0.98)
            new[0][0][j], new[0][1][j] = low, 1 - low
        share = min(max((sum(post) + PSEUDO * 0.85) / (len(votes) + PSEUDO), 0.05), 0.99)
        ch = new
    out = []
    for row in votes:
        logit = math.log(share / (1 - share)) + sum(math.log(ch[1][v > 0][j] / ch[0][v > 0][j]) for j, v in enumerate(row) if v)
        out.append(1 / (1 + math.exp(-logit)))
    return out


def test_posterior_text_by_text(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = quality(df).collect()
    names = [f"vote_{r.name}" for r in rules()]
    want = plain_posteriors([[r[n] for n in names] for r in got])
    assert {v for r in got for v in (r[n] for n in names)} == {-1, 0, 1}
    for r, p in zip(got, want, strict=True):
        assert r.posterior == pytest.approx(p, abs=1e-5)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_query_agrees_with_labels(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    got = op1_quality_rules(spark, sf).collect()
    check(got, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(r.kept, label[r.doc_id]) for r in got if r.doc_id in label and not r.base_failed]
    good, bad = [k for k, q in judged if q == 1], [k for k, q in judged if q == 0]
    assert np.mean(good) > 0.97 and (not bad or np.mean(bad) < 0.3)
