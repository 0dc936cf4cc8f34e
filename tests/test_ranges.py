import random

import pytest
from loreforge.operators.chunking import pack
from loreforge.operators.ranges import Fills, packed


def test_fills_of_a_range():
    rng = random.Random(1)
    for most in (10, 50):
        sizes = [rng.randint(1, most + 5) for _ in range(200)]
        f = Fills(most)
        for s in sizes:
            f.add(s)
        spans = f.result()
        for start in range(most + 1):
            held, opened = start, 0
            for s in sizes:
                if held and held + s > most:
                    held, opened = 0, opened + 1
                held += s
            span = [x for x in spans if x[0] <= start][-1]
            assert span[1:] == (held, opened)


@pytest.mark.parametrize("parts", [1, 7])
def test_a_group_over_many_ranges(spark, parts):
    rng = random.Random(parts)
    rows = [(g, i, rng.choice([1, 5, 20, 99, 150])) for g, n in (("hot", 3000), (None, 40), ("a", 1), ("z", 300)) for i in range(n)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g string, id long, n int").withColumnRenamed("g", "grp").repartition(5)
        got = {(r.grp, r.id): r.batch for r in packed(df, ["grp"], "id", "n", 100).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for g in ("hot", None, "a", "z"):
        mine = [(i, n) for x, i, n in rows if x == g]
        want = pack([n for _, n in mine], 100)
        first = want[0]
        assert [got[g, i] for i, _ in mine] == [w - first for w in want]
    assert packed(df.limit(0), ["grp"], "id", "n", 100).count() == 0
