import pytest
from loreforge.sources import migrations as M
from loreforge.sources.migrations import LATEST, Layouts
from loreforge.sources.scratch import shared_path
from pyspark.sql import functions as F


def old(spark):
    job = lambda i, state, payload, kind="extract_session": (i, kind, state, payload)
    return {
        "notes": spark.createDataFrame([(1, "a"), (2, None)], "id long, text string"),
        "tasks": spark.createDataFrame([(1, "t", "2024-01-02")], "id long, title string, updated_at string"),
        "media": spark.createDataFrame([(1, "/x")], "id long, path string"),
        "raws": spark.createDataFrame([(i, f"t{i}") for i in range(1, 8)], "id long, at string"),
        "jobs": spark.createDataFrame(
            [job(1, "queued", '{"raw_id": 1}'), job(2, "running", '{"raw_id":"2"}'), job(3, "done", '{"raw_id":3}'), job(4, "failed", '{"session_id":"s"}'), job(5, "queued", "broken"), job(6, "queued", None), job(7, "queued", '{"raw_id":5}', "other"), job(8, "failed", '{"raw_id":6}')],
            "id long, type string, state string, payload string",
        ),
    }


def test_an_old_layout_becomes_new(spark):
    store = Layouts(spark, shared_path(spark, "test-layout"))
    with pytest.raises(ValueError):
        store.upgrade()
    store.write(1, old(spark))
    assert store.upgrade() == list(range(2, LATEST + 1)) and store.version() == LATEST
    t = store.read()
    assert {r.id: r.extracted_at for r in t["raws"].collect()} == {1: None, 2: None, 3: "t3", 4: "t4", 5: "t5", 6: None, 7: "t7"}
    assert t["notes"].filter("status = 'active' and meta = '{}' and project is null").count() == 2
    assert t["tasks"].first().created_at == "2024-01-02" and t["media"].first().last_error == ""
    assert set(t) == set(old(spark)) and store.read(1)["raws"].columns == ["id", "at"]  # the copy is kept
    assert store.upgrade() == []
    assert store.keep(1) == LATEST - 1 and store.versions() == [LATEST]


def test_a_step_that_was_cut_off_is_done_again(spark):
    path = shared_path(spark, "test-layout")
    calls = []

    def fails(t):
        calls.append(1)
        if len(calls) == 1:
            raise KeyboardInterrupt
        return {"notes": t["notes"].withColumn("x", F.lit(1))}

    steps = {2: M.media_errors, 3: fails}
    store = Layouts(spark, path, steps)
    store.write(1, old(spark))
    with pytest.raises(KeyboardInterrupt):
        store.upgrade()
    old(spark)["notes"].write.parquet(f"{path}/v3/notes")  # half of it was there
    assert Layouts(spark, path, steps).version() == 2
    assert Layouts(spark, path, steps).upgrade() == [3]
    assert store.read()["notes"].columns == ["id", "text", "x"]
    with pytest.raises(ValueError, match="known"):
        store.write(9, {}) or store.upgrade()
