import __spark_entry__ as entry
import pytest
from loreforge.plans import changes, more, registry  # noqa: F401


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES)))
def test_same_as_sql(spark, small, name):
    import duckdb

    rows = registry.QUERIES[name](spark, small).collect()
    if name not in registry.ORACLES:
        assert rows
        return
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    got = con.execute(registry.ORACLES[name])
    cols = [c[0] for c in got.description]
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted([show(r[c]) for c in cols] for r in rows) == sorted([show(v) for v in r] for r in got.fetchall())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "id", "score", "pos"] and df.count() > 0
