import random
import sys
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from loreforge.llm import packing as P
from loreforge.llm.packing import best_fit, fillings, lower_bound, op12_packing, pack, plan, sequences
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, id string, rid int, piece string, length int, ids string, task int"


def fewest(sizes, capacity):
    """The least number of sequences, by trying all ways."""

    @cache
    def more(left, rooms):
        if not left:
            return len(rooms)
        best = more(left[1:], tuple(sorted((*rooms, capacity - left[0]))))
        for room in set(rooms):
            if room >= left[0]:
                rest = list(rooms)
                rest.remove(room)
                best = min(best, more(left[1:], tuple(sorted((*rest, room - left[0])))))
        return best

    return more(tuple(sorted(sizes, reverse=True)), ())


def content(patterns, capacity):
    got = Counter()
    for filling, times in patterns:
        assert sum(s * c for s, c in filling) <= capacity and times > 0
        for s, c in filling:
            got[s] += c * times
    return got


def test_as_few_as_possible():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([10, 20, 31])
        low = rng.choice([1, capacity // 5])
        sizes = [rng.randint(low, capacity - 1) for _ in range(rng.randint(0, 9))]
        counts = Counter(sizes)
        found, want = plan(counts, capacity), fewest(sizes, capacity)
        assert content(found.patterns, capacity) == counts == content(best_fit(counts, capacity), capacity)
        assert found.bound <= want == found.sequences
        assert not found.proven or found.sequences == want


def test_better_than_best_fit():
    # best fit takes three: 7 + 4, 6 + ..., where 7 + 3, 6 + 4 and so on fill two
    counts = Counter([6, 5, 4, 3, 2])
    assert plan(counts, 10).sequences == 2 == lower_bound(counts, 10)
    rng = random.Random(1)
    counts = Counter(rng.randint(200, 400) for _ in range(300))
    assert plan(counts).sequences == plan(counts).bound < sum(m for _, m in best_fit(counts, 2048))


@pytest.mark.parametrize(("low", "high", "n"), [(1, 2047, 300_000), (300, 700, 20_000), (400, 420, 2001), (1, 100, 5000), (2047, 2047, 5)])
def test_large_counts(low, high, n):
    rng = random.Random(n)
    counts = Counter(rng.randint(low, high) for _ in range(n))
    found = plan(counts)
    assert content(found.patterns, 2048) == counts
    assert found.bound <= found.sequences <= sum(m for _, m in best_fit(counts, 2048))
    assert len(found.patterns) <= 3 * 2048


def test_undominated_fillings():
    found, whole, _ = fillings({5: 1, 4: 1, 3: 1, 2: 1, 1: 1}, 6, 6)
    assert whole and found[0] == ((5, 1), (1, 1))
    assert ((3, 1), (2, 1), (1, 1)) not in found  # 5 can stand for 3 and 2, and 4 for 3 and 1
    assert fillings({6: 2, 5: 1, 1: 1}, 6, 6)[0] == [((6, 1),)]
    assert fillings({9: 1}, 6, 0)[0] == [] and fillings({9: 1}, 6, 6)[0] == [()]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_tokenizers_library(plain):
    fast = P._encoder("byte_bpe_50k.json")
    rng = random.Random(4)
    points = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    texts = ["", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "<|endoftext", " \n\n  x\t\t y  ", "it's I'LL we're 'd", "\x00\x01  　x", " " * 5000, "ab" * 5000, "\n" * 3000 + "x"]
    texts += ["".join(points[i : i + 512]) for i in range(0, len(points), 512)]
    texts += ["".join(x for c in points[i : i + 400] for x in (c, "a ", c, "1", c, "\n")) for i in range(0, 0x3400, 400)]
    texts += ["".join(rng.choice([" ", "  ", "\n", "a", "Z9", "'s", "é", "日", " ", "‍", "-", "…", "1"]) for _ in range(200)) for _ in range(200)]
    for t in texts:
        assert fast(t).tolist() == plain.encode(t, add_special_tokens=False).ids, t[:40]


def check(rows, got, plain, capacity, end_id=0):
    """got: doc_id, piece, start, length, ids, sequence_id, offset."""
    want = Counter()
    for i, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, end_id]
        first = len(ids) % capacity or capacity
        lo = [0, *range(first, len(ids), capacity)]
        for n, (a, b) in enumerate(zip(lo, [*lo[1:], len(ids)], strict=True)):
            want[i, n, a, b - a, np.array(ids[a:b], "<u4").tobytes()] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got) == want
    laid = defaultdict(list)
    for r in got:
        laid[r.sequence_id].append((r.offset, r.length))
    for parts in laid.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(laid)


def test_round_trip(spark, plain):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 2, i]), rng.choice([None, "", "<|endoftext|>", "x", "word " * rng.randint(1, 90), "é日 " * rng.randint(1, 20)])) for i in range(150)]
    rows += rows[:20] + [(7, "long text " * 30_000)]
    df = spark.createDataFrame([(*r, "a", 1, "b", 2, "c", 3) for r in rows], SCHEMA)
    packed, found = pack(df, capacity=64)
    got = packed.collect()
    n = check(rows, got, plain, 64)
    full = sum(r.length == 64 for r in got)
    assert n == found.sequences + full
    whole = sequences(packed).collect()
    assert len(whole) == n and all(len(r.ids) == 4 * r.n_tokens <= 4 * 64 for r in whole)
    held = {(r.sequence_id, r.offset): bytes(r.ids) for r in got}
    assert all(bytes(r.ids) == b"".join(held[k] for k in sorted(k for k in held if k[0] == r.sequence_id)) for r in whole)


def test_empty_table_and_one_text(spark, plain):
    none = spark.createDataFrame([], SCHEMA)
    assert pack(none)[0].count() == 0 == pack(none)[1].sequences
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    r = pack(one)[0].first()
    assert (r.doc_id, r.piece, r.start, r.length, bytes(r.ids), r.sequence_id, r.offset) == (1, 0, 0, 1, b"\0\0\0\0", 0, 0)
    exact = spark.createDataFrame([(1, None)] * 8, "doc_id long, text string")
    assert check([(1, None)] * 8, pack(exact, capacity=1)[0].collect(), plain, 1) == 8


def test_query(spark, small, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    whole = {(r.doc_id, r.piece): r for r in pack(spark.read.parquet(f"{small}/documents.parquet"))[0].collect()}
    assert check(rows, whole.values(), plain, 2048) >= sum(r.length for r in whole.values()) / 2048
    digest = op12_packing(spark, small).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in digest} == {k: (r.start, r.length, zlib.crc32(r.ids)) for k, r in whole.items()}
    assert len(digest) == len(whole) and len({r.sequence_id for r in digest}) == len({r.sequence_id for r in whole.values()})
