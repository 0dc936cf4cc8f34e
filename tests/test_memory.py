import datetime as dt
import gzip
import json

import numpy as np
import pytest
from loreforge.functions import vectors
from loreforge.operators import memory, state, writing
from loreforge.operators import extraction as X
from pyspark.sql import functions as F


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_sessions(spark):
    kind = "id string, client string, space_id long, started_at int, last_seen_at int, cwd string, project string"
    old = spark.createDataFrame([("a", "c", 1, 5, 6, None, "p")], kind)
    new = spark.createDataFrame([("a", "d", 2, 7, 9, "/x", "q"), ("a", None, 2, 8, 8, "/y", None), ("b", None, 3, 1, 1, None, None)], kind)
    got = {r.id: tuple(r)[1:] for r in memory.upsert_sessions(old, new).collect()}
    assert got == {"a": ("c", 1, 5, 9, "/x", "p"), "b": (None, 3, 1, 1, None, None)}


def test_meta(spark):
    meta = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    writes = spark.createDataFrame([("a", "9", "1"), ("b", "9", "1"), ("c", "9", ""), ("d", "9", "8"), ("e", "9", None)], "key string, value string, expect string")
    got = {r.key: (r.value, r.changed) for r in memory.set_meta(meta, writes).collect()}
    assert got == {"a": ("9", True), "b": ("2", False), "c": ("9", True), "e": ("9", True)}


def test_tags(spark):
    df = spark.createDataFrame([([" a", "b", "a ", "", None],), (None,)], "t array<string>")
    assert [r.t for r in df.select(memory.normal_tags(F.col("t")).alias("t")).collect()] == [["a", "b"], None]
    assert [r.v for r in df.select(memory.has_all_tags(F.col("t"), ["b"]).alias("v")).collect()] == [True, False]
    assert df.filter(memory.has_all_tags(F.col("t"), [])).count() == 2


def test_deltas(spark):
    files = spark.createDataFrame([(1, bytearray("é\nb\nha".encode())), (2, bytearray(b"x\n")), (3, bytearray(b"none")), (4, bytearray(b"a\nb\n"))], "session_id long, content binary")
    offsets = spark.createDataFrame([(1, 3), (2, 99), (4, 4)], "session_id long, offset long")
    got = sorted(tuple(r) for r in memory.read_deltas(files, offsets).select("session_id", "expect_offset", "new_offset", "content").collect())
    assert got == [(1, 3, 5, "b\n"), (2, 0, 2, "x\n")]
    # a line that is half written, inside a character
    half = spark.createDataFrame([(1, bytearray("é\nx é".encode()[:-1])), (2, bytearray("日\n".encode()[:2]))], "session_id long, content binary")
    assert [tuple(r)[:3] for r in memory.read_deltas(half, offsets.limit(0)).collect()] == [(1, 0, "é\n")]
    raws = spark.createDataFrame([(bytearray(gzip.compress(b"hi")),), (None,)], "content binary")
    assert [r.content for r in memory.gunzip(raws).collect()] == ["hi", None]


def test_debounce_does_not_slide(spark):
    rows = [(1, ts(f"2024-01-01 00:{m:02d}:00")) for m in (0, 9, 10, 11, 20, 22)]
    got = sorted((r.fires_at, r.n) for r in memory.debounce(spark.createDataFrame(rows, "session_id long, at timestamp")).collect())
    assert [n for _, n in got] == [3, 2, 1] or [n for _, n in got] == [3, 3]
    assert got[0][0] - rows[0][1] == dt.timedelta(minutes=10) and got[1][0] - rows[3][1] == dt.timedelta(minutes=10)


def test_media(spark):
    now = ts("2024-01-01 12:00:00")
    old = ts("2024-01-01 11:00:00")
    rows = [(1, "/a.MP3", b"1", old), (1, "/b.mp3", b"1", old), (2, "/b.mp3", b"1", old), (1, "/c.txt", b"1", old), (1, "/d.png", b"2", now), (1, "/e.png", b"3", old), (2, "/e.png", b"3", old), (1, "/f.m4v", b"4", old), (1, "/g.webp", b"5", old)]
    files = spark.createDataFrame([(s, p, bytearray(c), t) for s, p, c, t in rows], "space_id long, path string, content binary, modified timestamp")
    known = files.filter("path = '/e.png' and space_id = 1").select("space_id", F.sha2("content", 256).alias("sha256"))
    got = {(r.space_id, r.path): r.outcome for r in memory.media_outcomes(files, known, F.lit(now)).collect()}
    assert got == {(1, "/a.MP3"): "ingested", (1, "/b.mp3"): "already", (2, "/b.mp3"): "ingested", (1, "/c.txt"): "type", (1, "/d.png"): "fresh", (1, "/e.png"): "already", (2, "/e.png"): "ingested", (1, "/f.m4v"): "ingested", (1, "/g.webp"): "unsupported"}


def test_merges(spark):
    batch = spark.createDataFrame([(i, "fact" if i < 6 else "decision") for i in range(8)], "id long, kind string")
    rows = [(1, "fact", "t", [0, 1]), (2, "fact", " ", [2, 3]), (3, "fact", "t", [2]), (4, "fact", "t", [2, 2]), (5, "fact", "t", [4, 99]), (6, "fact", "t", [5, 6]), (7, "fact", "t", [0, 3])]
    got = {r.merge_id: r.error for r in memory.valid_merges(spark.createDataFrame(rows, "merge_id long, kind string, text string, ids array<long>"), batch).collect()}
    assert got == {1: "shared", 2: "text", 3: "few", 4: "repeated", 5: "foreign", 6: "kind", 7: "shared"}
    notes = spark.createDataFrame([(1, 1, "fact", None, ["b", "a"], "old"), (2, 1, "fact", None, ["c", "b"], "new")], "id long, space_id long, kind string, project string, tags array<string>, text string")
    new, gone = memory.apply_merges(notes, spark.createDataFrame([(1, "new ", [2, 1])], "merge_id long, text string, ids array<long>"))
    assert new.first().tags == ["c", "b", "a"] and [r.id for r in gone.collect()] == [1]


def test_dedupe_plan(spark):
    kind = "id long, space_id long, kind string, opening string, vec array<double>"
    near, far = [1.0, 0.0], [0.6, 0.8]
    new = spark.createDataFrame([(1, 1, "fact", "x", near), (2, 1, "fact", "y", near), (3, 2, "fact", None, near), (4, 1, "note", "x", near), (10, 1, "fact", "q", [0.99, 0.14])], kind)
    old = spark.createDataFrame(
        [(10, 1, "fact", "q", [0.99, 0.14]), (11, 1, "decision", "y", near), (12, 1, "fact", "y", far), (13, 2, "decision", "q", near), (14, 1, "note", "x", near)],
        kind,
    )
    # of its own space and kind only, events not at all, and never itself
    assert {r.id: r.replaces for r in memory.dedupe_plan(new, old).collect()} == {1: 10, 2: 10}
    assert {r.id: r.replaces for r in memory.dedupe_plan(new, old, replace_at=0.999).collect()} == {2: 12}
    # filters come before the cut: a hundred nearer notes of another kind hide nothing
    crowd = spark.createDataFrame([(100 + i, 1, "decision", None, near) for i in range(100)], kind)
    assert {r.id: r.replaces for r in memory.dedupe_plan(new, old.unionByName(crowd)).collect()} == {1: 10, 2: 10}


def test_embed(spark):
    chunks = spark.createDataFrame([(i, f"t{i}") for i in range(25)], "id long, text string")
    have = chunks.filter("id < 5").select("id")
    got = {r.id: r.vec for r in memory.embed_missing(chunks, have, memory.hash_embedder).collect()}
    assert set(got) == set(range(5, 25)) and got[7] == pytest.approx(memory.hash_embedder(["t7"])[0])
    with pytest.raises(Exception, match="wrong number"):
        memory.embed_missing(chunks, have, lambda texts: [[1.0]]).collect()


def test_usage_fields(spark):
    cases = {
        '{"prompt_tokens":5,"completion_tokens":2,"prompt_tokens_details":{"cached_tokens":3}}': (5, 2, 3),
        '{"input_tokens":5,"total_tokens":9,"prompt_cache_hit_tokens":0}': (5, 0, 0),
        '{"total_tokens":100,"completion_tokens":30}': (70, 30, -1),
        '{"prompt_tokens":0,"input_tokens":50}': (50, 0, -1),
        '{"prompt_tokens":5,"prompt_cache_hit_tokens":4,"prompt_tokens_details":{"cached_tokens":3}}': (5, 0, 4),
        '{"prompt_tokens":5,"prompt_tokens_details":null}': (5, 0, -1),
        "broken": (0, 0, -1),
    }
    got = {r.usage: tuple(r)[1:] for r in memory.usage_fields(spark.createDataFrame([(x,) for x in cases], "usage string")).collect()}
    assert got == cases


def test_summary_input_keeps_the_end(spark):
    rows = [(1, i, 0, f"{i}:" + "x" * 98) for i in range(50)] + [(2, 0, 0, "short")]
    got = {r.k: r.text for r in memory.summary_input(spark.createDataFrame(rows, "k long, seq int, part int, line string"), ["k"], 250).collect()}
    whole = "\n".join(r[3] for r in rows[:50])
    assert got == {1: "… [cut]\n" + whole[-250:], 2: "short"}


def test_captured_window(spark):
    rows = [("2024-01-10 03:59:00", "2024-01-07"), ("2024-01-10 04:00:00", "2024-01-09"), ("2024-01-10 12:00:00", "2024-01-10"), ("2024-01-10 12:00:00", "2024-01-02"), ("2024-01-10 12:00:00", None)]
    df = spark.createDataFrame(rows, "now string, last string").coalesce(1)
    a, b = memory.captured_window(F.col("now").cast("timestamp"), F.col("last").cast("date"))
    got = [(str(r.a)[:13], str(r.b)[:13]) for r in df.select(a.alias("a"), b.alias("b")).collect()]
    assert got == [("2024-01-07 04", "2024-01-09 04"), ("2024-01-09 04", "2024-01-10 04"), ("2024-01-09 04", "2024-01-10 04"), ("2024-01-09 04", "2024-01-10 04"), ("2024-01-09 04", "2024-01-10 04")]


def test_write_path(spark):
    kind = "space_id long, kind string, text string, tags array<string>, project string, why string, at int, seq int"
    old = state.fold_notes(spark.createDataFrame([(1, "fact", "known", ["a"], None, None, 1, 1)], kind))
    new = [(1, "fact", " known ", ["b"], "p", "w", 2, 2), (1, "fact", "key sk-abcdefghijklmnopqrstuvwx", [], None, "because", 3, 3), (1, "odd", "x", [], None, None, 4, 4), (1, "note", " \n", [], None, None, 5, 5), (1, None, "x", [], None, None, 6, 6)]
    done = writing.write_notes(old, spark.createDataFrame(new, kind))
    assert sorted((r.tags, r.fresh) for r in done.notes.collect()) == [([], True), (["a", "b"], False)]
    assert [r.indexed for r in done.fresh.collect()] == ["key [REDACTED:api-key]\nWhy: because"]
    assert done.chunks.count() == 1 and done.jobs.count() == 1 and done.refused.count() == 3
    have = spark.createDataFrame([(1, 0, "a")], "note_id long, ordinal int, text string")
    more = spark.createDataFrame([(1, 0, "b"), (1, 1, "c")], "note_id long, ordinal int, text string")
    assert sorted(tuple(r) for r in writing.insert_chunks(have, more).collect()) == [(1, 0, "a"), (1, 1, "c")]
    v = spark.createDataFrame([(1, "m", [1.0]), (1, "n", [2.0])], "chunk_id long, model string, vec array<double>")
    w = spark.createDataFrame([(1, "m", [3.0]), (2, "m", [4.0])], "chunk_id long, model string, vec array<double>")
    assert sorted(tuple(r) for r in writing.upsert_embeddings(v, w).collect()) == [(1, "m", [3.0]), (1, "n", [2.0]), (2, "m", [4.0])]


def test_extracted(spark):
    out = '{"notes":[{"kind":"fact","text":"a"}],"tasks":[{"title":"t","next_step":" ","due":"2024-01-02"}],"task_updates":[{"id":3,"status":"done"},{"id":4}],"relations":[{"from":"x","to":"y","type":"r","note_index":0},{"from":"x","to":"y","type":"r","note_index":5}]}'
    df = spark.createDataFrame([(1, 1, None, out), (2, 1, None, "no")], "session_id long, space_id long, project string, output string")
    x = X.extracted(df, spark.createDataFrame([(3,)], "id long"))
    assert [(r.kind, r.text, r.nth) for r in x.notes.collect()] == [("fact", "a", 0)]
    assert [(r.title, r.next_step, r.due_at) for r in x.tasks.collect()] == [("t", None, "2024-01-02")]
    assert [r.id for r in x.updates.collect()] == [3] and [r.id for r in x.bad_updates.collect()] == [4]
    assert sorted((r.nth, r.note_nth) for r in x.relations.collect()) == [(0, 0), (1, None)]
    assert [r.session_id for r in x.broken.collect()] == [2]


def test_small_columns(spark):
    df = spark.createDataFrame([("/a/b/", '{"a":1,"b":[1,2]}', '{"a":null,"c":{"d":"x"}}'), ("/root", "broken", '{"a":"é"}'), ("/", "{}", None)], "p string, o string, n string").coalesce(1)
    got = df.select(writing.project_of(F.col("p")).alias("p"), writing.merge_patch(F.col("o"), F.col("n")).alias("m")).collect()
    assert [r.p for r in got] == ["b", "", ""] and [json.loads(r.m) for r in got] == [{"b": [1, 2], "c": {"d": "x"}}, {"a": "é"}, {}]
    x = [1.5, -0.25, 0.0, 1e-39, 3.4e38, -1.1754944e-38]
    blobs = spark.createDataFrame([(bytearray(np.asarray(x, "<f4").tobytes()),), (bytearray(b"1234"),), (None,)], "b binary").coalesce(1)
    got = [r.v for r in blobs.select(vectors.legacy_vector(F.col("b"), 6).alias("v")).collect()]
    assert got[1:] == [None, None] and np.asarray(got[0], "<f4").tolist() == np.asarray(x, "<f4").tolist()
