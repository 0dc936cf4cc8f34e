import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from brute import words
from loreforge.llm import audit
from loreforge.llm import words as W
from loreforge.llm.audit import COUNTS, filter_audit, scan, text_failures

DOCS = "doc_id long, text string, lang string, id string, digest int, fails int, n int, part int"
LABELS = "doc_id long, quality int, toxic int, id int"


def brute(rows, labels):
    flags = {}
    for i, quality, toxic in labels:
        good, bad = flags.get(i, (False, False))
        flags[i] = (good or quality == 1, bad or toxic == 1)
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, lang in rows:
        text = text or ""
        w = words(text)
        bad = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and i > least[text],
        }
        good, toxic = flags.get(i, (False, False)) if i is not None else (False, False)
        docs.append((lang or "", {x for x in bad if bad[x]}, good, toxic))
    out = {}
    for part in {d[0] for d in docs}:
        removals = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            whole = left
            for step, x in enumerate(order, 1):
                hit = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                failing = sum(x in d[1] for d in whole)
                out[part, order, step] = [len(left), len(hit), failing - len(hit), sum(d[1] == {x} for d in whole), sum(d[2] for d in hit), sum(d[3] for d in hit)]
                removals[x] += len(hit)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removals[order[step - 1]])
    return out


def check(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], DOCS)
    got = filter_audit(docs, spark.createDataFrame([(*r, 0) for r in labels], LABELS))
    assert got.columns[:3] == ["part", "filter_order", "step"]
    have = got.collect()
    want = brute(rows, labels)
    assert len(have) == len(want)
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in have} == want


def test_against_plain_version(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "one", "é" * 40, "A" * 10, "a # b", " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(199)), "Same " * 250, "AB " * 4 + "x y z " * 80]
    texts += [" ".join(rng.choice(["Word", "other", "#", "x y", "日本", f"{i}"]) for i in range(rng.randint(0, 400))) for _ in range(12)]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(120)]
    rows += rows[:10]
    labels = [(rng.choice([None, *range(50)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    check(spark, rows, labels)


def test_empty_tables(spark):
    check(spark, [], [])
    check(spark, [(None, None, None)], [])
    check(spark, [(1, "a b", "en"), (0, "a b", "en"), (0, "a b", "en")], [])


def scanned(texts):
    arr = pa.array(texts, pa.string())
    return {c: np.concatenate([scan(buf, offs)[c] for _, _, buf, offs in W.chunks(arr)]).tolist() for c in COUNTS}


TEXTS = ["", "a a b", "aa a aa", "\n", "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999 + "y", "É E # é", "", "b a", "same same same"]


def counted(texts):
    ws = [words(t) for t in texts]
    return {"n_words": [len(w) for w in ws], "n_distinct": [len(set(w)) for w in ws], "n_capitals": [len(re.findall("[A-Z]", t)) for t in texts], "n_symbols": [len(re.findall(r"[#$%&*|]", t)) for t in texts], "n_chars": [len(t) for t in texts]}


def test_counts():
    assert scanned(TEXTS) == counted(TEXTS)


@pytest.mark.parametrize("weak", [0, 3])
def test_words_that_share_a_hash_are_told_apart(monkeypatch, weak):
    monkeypatch.setattr(W, "hashes", lambda buf, starts, ends: ((ends - starts).astype(np.uint64) & np.uint64(weak)) << np.uint64(60))
    assert scanned(TEXTS) == counted(TEXTS)


def test_comparison_in_parts(monkeypatch):
    monkeypatch.setattr(W, "CHUNK_BYTES", 7)
    assert scanned(TEXTS) == counted(TEXTS)


def test_very_long_text(spark):
    rows = spark.createDataFrame([(1, "tic tac " * 400_000, "en")], "doc_id long, text string, lang string")
    r = text_failures(rows).first()
    assert (r.n_words, r.n_distinct, r.n_chars, r.fails) == (800_000, 2, 3_200_000, "B")


def test_query_uses_every_row(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in audit.op13_filter_audit(spark, small).collect()} == brute(rows, labels)
