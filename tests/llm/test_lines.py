import random

from loreforge.llm.lines import line_dedup, op8_line_dedup

from brute import words

WHITE = " \t\n\x0b\x0c\r"


def brute(rows, w=2, long=50):
    """rows in order of place: (id, text)."""
    first, out = {}, []

    def runs(body):
        some = {(i, w) for i in range(len(body) - w + 1)} | {(i, 1) for i, x in enumerate(body) if len(words(x)) >= long}
        return [(i, n, tuple(body[i : i + n])) for i, n in sorted(some)]

    for d, (_, text) in enumerate(rows):
        for i, _, run in runs([y for x in (text or "").split("\n") if (y := x.strip(WHITE))]):
            first.setdefault(run, (d, i))
    for d, (key, text) in enumerate(rows):
        lines = (text or "").split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(WHITE)]
        gone = set()
        for i, n, run in runs([lines[i].strip(WHITE) for i in at]):
            if first[run] < (d, i):
                gone.update(at[i : i + n])
        out.append((key, len(at), len(gone), None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def test_long_lines(spark):
    line = " ".join(f"w{i}" for i in range(50))
    short = line.rpartition(" ")[0]
    rows = [(1, f"a\n{line}\nb"), (2, line), (3, f"c\n {line}\nd"), (4, f"e\n{short}\nf"), (5, short), (6, f"{line}\n{line}"), (7, "long " * 300_000 + "\n" + "x" * 500_000), (8, "long " * 300_000)]
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, rows[0][1]), 2: (1, ""), 3: (1, "c\nd"), 4: (0, rows[3][1]), 5: (0, short), 6: (2, ""), 7: (0, rows[6][1]), 8: (1, "")}


def test_fixture(spark):
    rng = random.Random(5)
    for w in (1, 2, 3, 4):
        rows = [(i, "\n".join(rng.choice(["a b", " a b\t", "c", "dé", "", "  ", "e", "f", "g", f"u{rng.random()}"]) for _ in range(rng.randint(0, 25)))) for i in range(60)]
        rows += [(60, None), (61, ""), (62, "c\n" * 50), (63, rows[3][1]), (64, "\n\n\n")]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {tuple(r) for r in line_dedup(df, min_run=w).select("doc_id", "n_lines", "n_removed", "kept_text").collect()}
        assert got == set(brute(rows, w))


def test_repeats_nulls_names(spark):
    rows = [(1, "a\nb\nc", 7), (1, "a\nb\nc", 7), (None, "b\nc", 8), (None, "x\ny", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 int")
    got = sorted((str(r.doc_id), r.kept_text, r.k1) for r in line_dedup(df).collect())
    assert got == [("1", "a", 7), ("1", "a", 7), ("None", "b\nc", 8), ("None", "x\ny", 8)]
    assert line_dedup(df.limit(0)).count() == 0
    named = spark.createDataFrame([("x", "a\nb"), ("y", "a\nb"), (None, "q")], "doc_id string, text string")
    assert sorted(r.n_removed for r in line_dedup(named).collect()) == [0, 0, 2]


def test_query(spark, small):
    import hashlib

    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    want = {(i, n, g, hashlib.sha256((k or "").encode()).hexdigest()) for i, n, g, k in brute(rows)}
    assert {tuple(r) for r in op8_line_dedup(spark, small).collect()} == want
