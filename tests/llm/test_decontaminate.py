import hashlib
import random
import re

from loreforge.llm.decontaminate import contamination, op9_decontamination, without_spans

PAT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def norm(t):
    return PAT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))


def brute(docs, bench):
    wins = {}
    for item, text in bench:
        w = norm(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    lens = {len(k) for k in wins}
    out = []
    for i, text in docs:
        w, hit, items = norm(text), set(), set()
        for n in lens:
            for s in range(len(w) - n + 1):
                k = tuple(w[s : s + n])
                if k in wins:
                    hit.update(range(s, s + n))
                    items |= {str(x) for x in wins[k] if x is not None}
        out.append((i, len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def key(x):
    return sorted(map(str, x))


def test_fixture(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["A", "b", "cé", "É", "d-9", "x_y", "ßQ", "e"]) + str(rng.randint(0, 30))
    bench = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 13, 14, 30])))) for i in range(25)]
    bench += [(3, bench[5][1]), (None, "null item id here"), (99, None), (98, ""), (97, "..."), (96, "same " * 40)]
    docs = []
    for i in range(80):
        w = [word() for _ in range(rng.randint(0, 60))]
        if i % 2:
            b = rng.choice(bench)[1] or ""
            w[rng.randint(0, len(w)) : 0] = b.upper().split() if i % 4 == 1 else b.split()
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(1, docs[3][1]), (3, docs[3][1]), (None, "same " * 20), (None, None), (200, ""), (201, "a null ITEM id here é"), (202, "same " * 13)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    for words in (0, 10**6):
        got = contamination(d, b, broadcast_words=words)
        rows = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got.collect()]
        assert key(rows) == key(brute(docs, bench))
    left = {(r.doc_id, r.text) for r in without_spans(got).collect()}
    assert (202, "") in left and (200, "") in left and (None, None) in left
    assert len([x for x in left if x[0] == 201]) == 1 and (201, "a é") in left


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b", "q")], "doc_id long, text string, gram string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.gram) for r in contamination(d, none).collect()] == [(2, 0, "q")]
    named = spark.createDataFrame([("x", "q a b c"), ("y", None), (None, "a b " * 100_000)], "doc_id string, text string")
    stock = spark.createDataFrame([(i, f"a b {i}" if i else "a b") for i in range(300)], "item_id long, text string")
    assert sorted((str(r.doc_id), r.n_hit) for r in contamination(named, stock).collect()) == [("None", 200_000), ("x", 2), ("y", 0)]
    assert contamination(d.limit(0), d.selectExpr("doc_id item_id", "text")).count() == 0


def test_query(spark, small):
    d = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    b = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = [(i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), c) for i, n, h, x, c in brute(d, b)]
    assert key(tuple(r) for r in op9_decontamination(spark, small).collect()) == key(want)
