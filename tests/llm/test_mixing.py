import hashlib
import random
from collections import Counter, defaultdict

from loreforge.llm.mixing import mix, op7_mixing, schedule

from brute import words


def targets(size):
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    out, left, open_ = {}, float(sum(size.values())), set(size)
    while True:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * size[s]
            left -= out[s]
            open_.discard(s)
        if not open_:
            return out


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, s int").repartition(3)
    per, pieces = mix(df, **more)
    per, pieces = per.collect(), pieces.collect()
    size = defaultdict(int)
    for _, t, s, _ in rows:
        size[s] += len(words(t))
    want = targets(dict(size))
    by = {r.rid: r for r in per}
    assert len(per) == len(rows)
    assert Counter((r.doc_id, r["size"]) for r in per) == Counter((i, len(words(t))) for i, t, _, _ in rows)
    for r in per:
        assert 0 <= r.taken <= 3 * r["size"]
        assert any(abs(r.target - want[s]) < 1e-6 * (1 + want[s]) and r.source_size == size[s] for s in want)
    for s in want:
        mine = [r for r in per if r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s])]
        same = [x for x in want if size[x] == size[s] and abs(want[x] - want[s]) < 1e-6 * (1 + want[s])]
        assert abs(sum(r.taken for r in mine) - len(same) * want[s]) <= len(same)
    slots = defaultdict(int)
    for p in pieces:
        assert 0 <= p.doc_from < p.doc_from + p.words <= by[p.rid]["size"]
        slots[p.slot] += p.words
    assert all(n <= more.get("block", 2048) for n in slots.values())
    at = defaultdict(set)
    for p in pieces:
        at[p.rid].add(p.slot)
    assert all((r.n_slots, r.first_slot) == (len(at[r.rid]), min(at[r.rid], default=None)) for r in per)
    return per


def test_fixture(spark):
    rng = random.Random(7)
    rows = []
    for i in range(150):
        s = rng.choice(["b", "b", "b", "a", "é", "Z", None, ""])
        rows.append((i, " ".join("w" for _ in range(rng.randint(0, 60))), s, i))
    rows += [(200, "x " * 3000, "long", 1), (201, None, "none", 1), (202, "one", "tiny", 1), (None, "q r s", "b", 1), (5, rows[5][1], "b", 1)]
    a = run(spark, rows, block=32)
    assert sorted(map(str, a)) != [] and Counter((r.doc_id, r["size"], r.taken) for r in a) == Counter((r.doc_id, r["size"], r.taken) for r in run(spark, rows, block=32))
    run(spark, rows)


def test_schedule_spreads(spark):
    plan = spark.createDataFrame([(0, 64000), (1, 32000), (2, 320), (3, 0)], "s int, due long")
    rows = sorted((r.slot, r.s, r["rank"]) for r in schedule(spark, plan, 32).collect())
    assert Counter(s for _, s, _ in rows) == {0: 2000, 1: 1000, 2: 10}
    seen = Counter()
    for i, (_, s, rank) in enumerate(rows[:2900], 1):
        assert rank == seen[s]
        seen[s] += 1
        assert abs(seen[0] - i * 2000 / 3010) < 8


def test_empty(spark):
    per, pieces = mix(spark.createDataFrame([], "doc_id long, text string, source string"))
    assert per.count() == 0 and pieces.count() == 0
    per, pieces = mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string"))
    assert [(r.taken, r.n_slots, r.first_slot) for r in per.collect()] == [(0, 0, None)] and pieces.count() == 0


def test_query(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source").collect()
    size = defaultdict(int)
    for r in rows:
        size[r.source] += len(words(r.text))
    want, line, out = targets(dict(size)), defaultdict(int), set()
    for r in sorted(rows, key=lambda r: hashlib.md5(f"{r.doc_id}|{len(words(r.text))}".encode()).hexdigest()):
        n, at, due = len(words(r.text)), line[r.source], int(want[r.source] + 0.5)
        out.add((r.doc_id, sum(max(0, min(p * size[r.source] + at + n, due) - p * size[r.source] - at) for p in range(3))))
        line[r.source] += n
    assert {(r.doc_id, r.taken) for r in op7_mixing(spark, small).collect()} == out
