import random
from collections import Counter

import numpy as np
from loreforge.llm.components import components
from loreforge.llm.near_dup import banded_distance, near_dedup, near_duplicates, op6_near_dedup

from brute import words


def shingles(text, k=5):
    w = words(text)
    seen, out = Counter(), set()
    for i in range(len(w) - k + 1):
        g = tuple(w[i : i + k])
        out.add((g, seen[g]))
        seen[g] += 1
    return out


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def brute(rows, t=0.8):
    """Class ids by comparing all texts."""
    texts = sorted({x for _, x in rows if x is not None})
    sh, root = [shingles(x) for x in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            same = len(sh[i] & sh[j])
            if same and same >= t * len(sh[i] | sh[j]):
                a, b = words(texts[i]), words(texts[j])
                if 1 - distance(a, b) / max(len(a), len(b)) >= t:
                    root[find(i)] = find(j)
    no = {x: find(i) for i, x in enumerate(texts)}
    least = {}
    for i, x in rows:
        if x is not None and i is not None:
            least[no[x]] = min(i, least.get(no[x], i))
    return [(i, i if x is None else least.get(no[x])) for i, x in rows]


def sort(x):
    return sorted(x, key=str)


def test_distance():
    rng = random.Random(2)
    pairs, want = [], []
    for _ in range(200):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 60))]
        b = [x if rng.random() > 0.1 else rng.randint(0, 9) for x in a if rng.random() > 0.05] if rng.random() < 0.8 else [rng.randint(0, 3) for _ in range(rng.randint(0, 60))]
        most = rng.randint(0, 40)
        pairs.append((np.array(a, np.int64), np.array(b, np.int64), most))
        d = distance(a, b)
        want.append(d if d <= most else -1)
    assert banded_distance([p[:2] for p in pairs], np.array([p[2] for p in pairs])).tolist() == want


def edited(rng, w, share):
    return [x if rng.random() > share else f"new{rng.random()}" for x in w]


def test_groups(spark):
    rng = random.Random(4)
    rows = []
    for g in range(25):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(3, 300))]
        for c in range(rng.choice([1, 2, 3, 30])):
            rows.append((g * 100 + c, " ".join(base if c % 3 == 1 else edited(rng, base, 0.012) if c else base)))
    rows += [(9000, None), (9001, None), (None, rows[0][1]), (9002, ""), (9003, ""), (9004, "a b"), (9005, "a b"), (9006, "a  b"), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.class_id) for r in near_duplicates(df).collect()]
    assert sort(got) == sort(brute(rows))
    kept = [(r.doc_id, r.text) for r in near_dedup(df.withColumn("class_no", df.doc_id)).collect()]
    heads = {(c, rows.index((i, x))) for (i, x), (_, c) in zip(rows, brute(rows), strict=True) if x is not None and i == c}
    want = {}
    for c, at in heads:
        want.setdefault((c, rows[at][1]), rows[at])
    assert sort(kept) == sort([*want.values(), *(r for r in rows if r[1] is None)])


def test_links_past_the_hubs(spark):
    """A group of 60 copies, and twenty texts that are near to one text of it each, none of them a hub."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    copies = [[*base[:j], f"c{i}", *base[j + 1 :]] for i in range(60) for j in [rng.randint(0, 299)]]
    far = []
    for i in range(20):
        first, n = copies[i + 20], 0
        # distant from all the group, then linked through a chain of two texts
        for n, share in enumerate((0.018, 0.018)):
            first = [x if rng.random() > share else f"f{i}-{n}-{j}" for j, x in enumerate(first)]
            far.append(first)
    rows = [(i, " ".join(x)) for i, x in enumerate(copies + far)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.class_id) for r in near_duplicates(df).collect()]
    assert sort(got) == sort(brute(rows))


def test_empty_and_names(spark):
    df = spark.createDataFrame([(1, "a", 1, 2)], "doc_id long, text string, node long, id long")
    assert [tuple(r)[:2] for r in near_duplicates(df).collect()] == [(1, 1)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sort((r.doc_id, r.class_id) for r in op6_near_dedup(spark, small).collect()) == sort(brute(rows))
