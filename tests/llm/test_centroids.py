import hashlib
import random

import numpy as np
import pytest
from loreforge.llm import centroids as C
from loreforge.llm.centroids import Ring, cluster_vectors, op11_centroid_clustering

SCHEMA = "vec_id long, embedding array<double>, id string, v int, cluster string, distance string"


def floor_of(x):
    return [int(np.floor(64 * float(y))) for y in x]


def brute(rows, k=16, rounds=3, dim=64):
    kept = [(i, floor_of(e)) for i, e in rows if e is not None and len(e) == dim and all(x is not None and np.isfinite(x) for x in e)]
    if not kept:
        return []
    key = {i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest() for i, _ in kept}
    cs = [v for i, v in sorted(kept, key=lambda r: (key[r[0]], r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cs))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        new = []
        for n, c in enumerate(cs):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == n]
            new.append([sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else c)
        cs = new
    found = [(i, *near(v)) for i, v in kept]
    per = {n: sum(d for _, d, m in found if m == n) for n in range(len(cs))}
    return sorted(((i, n, d, per[n], sum(per.values()), hashlib.sha256(",".join(map(str, cs[n])).encode()).hexdigest()) for i, d, n in found), key=repr)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, e, "a", 1, "b", "c") for i, e in rows], SCHEMA)
    return sorted((tuple(r) for r in cluster_vectors(df, **how)[0].collect()), key=repr)


def test_against_plain_version(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, rng.choice([0.1, 1, 30])) for _ in range(64)]) for i in range(90)]
    rows += [(200 + i, [0.25] * 64) for i in range(10)] + rows[:5]
    rows += [(None, rows[7][1]), (None, None), (300, []), (301, [0.0] * 63), (302, [0.0] * 65), (303, [None] + [0.0] * 63), (304, [float("nan")] + [0.0] * 63), (305, [float("-inf")] + [0.0] * 63), (306, [-0.0] * 64)]
    assert run(spark, rows) == brute(rows)


def test_few_vectors_and_none(spark):
    assert run(spark, []) == [] == brute([])
    assert run(spark, [(1, None), (2, [1.0])]) == []
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert run(spark, rows) == brute(rows)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x)] * 2) for i, x in enumerate([-1, 1, 0, 0, 3, -3, 2, -2])]
    assert run(spark, rows, k=4, dim=2) == brute(rows, k=4, dim=2)


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e30] * 64)])


def test_ring_misses_nothing():
    rng = np.random.default_rng(1)
    for scale in (3, 1000, 1 << 26):
        cs = rng.integers(-scale, scale, (50, 8))
        cs[10], cs[20] = cs[3], -cs[3]
        x = np.concatenate([rng.integers(-scale, scale, (400, 8)), cs, np.zeros((1, 8), np.int64)])
        cluster, dist = Ring(cs).nearest(x)
        d = ((x[:, None, :] - cs[None]) ** 2).sum(2)
        assert (dist == d.min(1)).all() and (cluster == d.argmin(1)).all()


def test_ring_leaves_out_what_cannot_be_nearest():
    cs = np.array([[r * 100, 0] for r in range(1, 200)])
    x = np.array([[r * 100 + 3, 4] for r in range(1, 200)])
    lo, hi = Ring(cs).between(x)
    assert (hi - lo).max() <= 2 and (Ring(cs).nearest(x)[0] == np.arange(199)).all()


def test_blocks_of_pairs(monkeypatch):
    monkeypatch.setattr(C, "_PAIRS", 3)
    test_ring_misses_nothing()


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted((tuple(r) for r in op11_centroid_clustering(spark, small).collect()), key=repr) == brute(rows)
