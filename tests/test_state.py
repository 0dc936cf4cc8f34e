import datetime as dt

import numpy as np
import pytest
from loreforge.operators import reports, search, state, transcripts
from loreforge.sources.sinks import Versions, vault_notes, write_vault
from loreforge.streaming import capture
from pyspark.sql import functions as F


def test_upsert_is_a_refresh(spark):
    kind = "space_id long, kind string, text string, tags array<string>, project string, why string, at long, seq long"
    first = [(1, "fact", " a ", ["x"], None, None, 1, 1), (1, "fact", "b", ["y"], "p", "w", 1, 2)]
    later = [(1, "fact", "a", ["z", "x"], "q", "w1", 5, 3), (1, "fact", "a", [], "r", None, 6, 4), (2, "fact", "a", [], None, None, 5, 5)]
    old = state.fold_notes(spark.createDataFrame(first, kind))
    got = {(r.space_id, tuple(r.tags)): r for r in state.upsert_notes(old, spark.createDataFrame(later, kind)).collect()}
    a = got[1, ("x", "z")]
    assert (a.project, a.why, a.created_at, a.updated_at, a.fresh) == ("q", "w1", 1, 6, False)
    assert got[1, ("y",)].updated_at == 1 and got[2, ()].fresh
    assert state.upsert_notes(old, spark.createDataFrame([], kind)).count() == 2
    assert state.upsert_notes(old.limit(0), spark.createDataFrame(later, kind)).count() == 2


def test_patch(spark):
    df = spark.createDataFrame([("a", ""), ("a", None), ("a", "-"), ("a", "b"), (None, "b")], "o string, g string")
    assert [r.v for r in df.select(state.patch(F.col("o"), F.col("g")).alias("v")).collect()] == ["a", "a", None, "b", "b"]


def test_next_seq(spark):
    old = spark.createDataFrame([(1, 4)], "k long, seq int")
    new = spark.createDataFrame([(1, 9), (1, 8), (2, 1)], "k long, at int")
    assert sorted((r.k, r.at, r.seq) for r in state.next_seq(old, new, "k", ["at"]).collect()) == [(1, 8, 5), (1, 9, 6), (2, 1, 1)]


NOTES = "id long, kind string, status string, updated_h int, deleted_h int"


def test_purge_tiers_off(spark):
    n = spark.createDataFrame([(1, "note", "active", 0, None), (2, "note", "superseded", 0, None), (3, "fact", "active", 0, 1)], NOTES)
    owned = {"c": (spark.createDataFrame([(1,), (2,), (9,)], "note_id long"), "note_id")}
    keep, rest, report = state.purge(n, owned, state.purge_reason(10**6, 0, -1))
    assert {r.id for r in keep.collect()} == {1, 3} and {r.note_id for r in rest["c"].collect()} == {1, 9}
    assert [tuple(r) for r in report.collect()] == [("superseded", 1)]


def test_purge_spares_notes_in_their_grace_period(spark):
    day, now = 24, 24 * 1000
    rows = [
        (1, "note", "active", 0, now - 4 * day),  # an old event, forgotten four days ago
        (2, "fact", "superseded", 0, now - 4 * day),
        (3, "note", "active", 0, None),
        (4, "fact", "active", 0, now - 31 * day),
        (5, "fact", "active", 0, None),
        (6, "fact", "superseded", now, None),
        (7, "note", "active", now - 364 * day, None),
    ]
    n = spark.createDataFrame(rows, NOTES)
    got = {r.id: r.reason for r in n.withColumn("reason", state.purge_reason(now, 365, 30)).collect()}
    assert got == {1: None, 2: None, 3: "event", 4: "deleted", 5: None, 6: "superseded", 7: None}


def test_purge_tables(spark):
    now = dt.datetime(2024, 6, 1)
    old, new = now - dt.timedelta(days=400), now - dt.timedelta(days=1)
    at = lambda rows, kind: spark.createDataFrame(rows, kind)
    tables = {
        "tasks": at([(1, "open", old), (2, "done", old), (3, "done", new)], "id long, status string, updated_at timestamp"),
        "jobs": at([(1, "failed", old), (2, "dead", old), (3, "done", new)], "id long, state string, updated_at timestamp"),
        "raws": at([(1, now + dt.timedelta(days=1)), (2, new)], "id long, retained_until timestamp"),
        "episodes": at([(1, new), (2, old), (3, None)], "id long, at timestamp"),
        "media": at([(1, new), (2, old)], "id long, updated_at timestamp"),
        "relations": at([(1, 5, old), (2, 6, new), (3, None, old), (4, None, new)], "id long, source_note_id long, created_at timestamp"),
    }
    kept = state.purge_tables(tables, F.lit(now), 365, 30, spark.createDataFrame([(6,)], "id long"))
    assert {k: sorted(r.id for r in v.collect()) for k, v in kept.items()} == {"tasks": [1, 3], "jobs": [1, 3], "raws": [1], "episodes": [1, 3], "media": [1], "relations": [1, 4]}
    off = state.purge_tables({"tasks": tables["tasks"]}, F.lit(now), 0, 0)
    assert off["tasks"].count() == 3


def test_jobs_claim_and_settle(spark):
    now = dt.datetime(2024, 6, 1, 12)
    ago = lambda m: now - dt.timedelta(minutes=m)
    rows = [(1, "done", 1, ago(9), ago(9), ""), (2, "queued", 0, now + dt.timedelta(hours=1), ago(9), ""), (3, "failed", 5, ago(1), ago(9), "x"), (4, "running", 2, ago(60), ago(31), ""), (5, "running", 1, ago(60), ago(29), ""), (6, "queued", 0, ago(1), ago(9), "")]
    j = spark.createDataFrame(rows, "id long, state string, attempts int, run_after timestamp, updated_at timestamp, last_error string")
    got = {r.id: (r.claimed, r.state, r.attempts) for r in state.claim_jobs(j, F.lit(now), 2).collect()}
    assert got == {1: (False, "done", 1), 2: (False, "queued", 0), 3: (True, "running", 6), 4: (True, "running", 3), 5: (False, "running", 1), 6: (False, "queued", 0)}
    run = j.withColumns({"state": F.lit("running"), "attempts": F.element_at(F.array(*(F.lit(x) for x in (1, 5, 3, 1, 0, 2))), F.col("id").cast("int"))})
    ends = spark.createDataFrame([(1, "failed", "e", None), (2, "failed", "e", None), (3, "permanent", "p", None), (4, "deferred", "d", now + dt.timedelta(days=1)), (5, "deferred", "d", now), (99, "done", None, None)], "id long, outcome string, error string, until timestamp")
    out = {r.id: (r.state, r.attempts, r.last_error) for r in state.settle_jobs(run, ends, F.lit(now)).collect()}
    assert out == {1: ("failed", 1, "e"), 2: ("dead", 5, "e"), 3: ("dead", 3, "p"), 4: ("queued", 0, "d"), 5: ("queued", 0, "d"), 6: ("running", 2, "")}
    after = {r.id: r.run_after for r in state.settle_jobs(run, ends, F.lit(now)).collect()}
    assert after[1] == now + dt.timedelta(seconds=30) and after[4] == now + dt.timedelta(days=1)


def test_tasks_insert_and_update(spark):
    kind = "id long, space_id long, project string, title string, status string, next_step string, why string, updated_at timestamp"
    t0 = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([(3, 1, None, "Fix Bug!", "open", None, "w", t0), (7, 1, None, "fix bug", "done", None, None, t0)], kind)
    new = spark.createDataFrame([(1, 1, "", "fíx  bug", "n1", "w2"), (2, 1, "p", "fix bug", None, None), (3, 1, "p", "Fix bug", "n3", None), (4, 2, None, "fix bug", None, None)], "seq long, space_id long, project string, title string, next_step string, why string")
    got = sorted(tuple(r) for r in state.insert_tasks(old, new).select("id", "space_id", "project", "title", "status", "next_step", "why", "fresh").collect())
    assert got == [(3, 1, None, "Fix Bug!", "open", "n1", "w", False), (7, 1, None, "fix bug", "done", None, None, False), (8, 1, "p", "fix bug", "open", "n3", None, True), (9, 2, None, "fix bug", "open", None, None, True)]
    assert state.insert_tasks(old.limit(0), new.limit(0)).count() == 0
    up = spark.createDataFrame([(3, " DONE", "-", "x"), (7, "odd", None, "-"), (9, "done", None, None)], "id long, status string, next_step string, why string")
    now = dt.datetime(2024, 2, 2)
    full = old.withColumn("next_step", F.lit("s"))
    got = sorted(tuple(r) for r in state.update_tasks(full, up, F.lit(now)).select("id", "status", "next_step", "why", "updated_at").collect())
    assert got == [(3, "done", None, "x", now), (7, "done", "s", None, now)]


def test_search_edges(spark):
    chunks = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, ""), (4, None), (5, "gamma alpha")], "id long, text string")
    index = search.TextIndex.build(chunks)
    q = spark.createDataFrame([(1, "Alpha GAMMA gamma"), (2, "nothing"), (3, "")], "query_id long, query string")
    hits = search.bm25(index, q).orderBy("query_id", "pos").collect()
    assert [(r.query_id, r.id) for r in hits] == [(1, 5), (1, 2), (1, 1)]
    assert search.bm25(index, q, chunks.select("id").limit(0)).count() == 0
    assert search.bm25(search.TextIndex.build(chunks.limit(0)), q).count() == 0
    assert tuple(index.stats().first())[:2] == (5, 5)
    owner = spark.createDataFrame([(1, 10), (2, 10), (5, 20)], "id long, note_id long")
    assert sorted((r.id, r.chunk_id, r.pos) for r in search.collapse(search.bm25(index, q), owner).collect()) == [(10, 2, 2), (20, 5, 1)]
    stages = search.stages(search.bm25(index, q), None, False).first()
    assert (stages.vector, stages.rerank, stages.hits) == ("skipped:none", "skipped:off", "ok:3")


def test_vectors(spark):
    v = spark.createDataFrame([(4, [1.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0]), (5, None), (6, [])], "id long, vec array<float>").coalesce(1)
    q = v.withColumnRenamed("id", "query_id")
    got = search.vector_topk(v, q, 2, exclude_self=True, block=1, query_block=1).collect()
    assert sorted((r.query_id, r.pos, r.id, round(r.score, 6)) for r in got) == [(1, 1, 3, 1.0), (1, 2, 2, 0.0), (2, 1, 1, 0.0), (2, 2, 3, 0.0), (3, 1, 1, 1.0), (3, 2, 2, 0.0)]
    # a vector of another dimension in the first row hides nothing; equal numbers are different things
    one = search.vector_topk(v, q.filter("query_id = 1"), 1).collect()
    assert [(r.query_id, r.id) for r in one] == [(1, 1)]
    assert search.vector_topk(v.limit(0), q.limit(0)).count() == 0
    rng = np.random.default_rng(0)
    rows = [(i, "ab"[i % 2] if i % 5 else None, rng.normal(size=3).tolist()) for i in range(60)]
    w = spark.createDataFrame(rows, "id long, g string, vec array<double>")
    got = {(r.query_id, r.pos): r.id for r in search.vector_topk(w, w.withColumnRenamed("id", "query_id"), 3, group=("g",), exclude_self=True, block=7, query_block=4).collect()}
    for i, g, x in rows:
        near = sorted(((-np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y), j) for j, h, y in rows if h == g and j != i))[:3]
        assert [got[i, p] for p in (1, 2, 3)] == [j for _, j in near]


def test_recall_counts_notes(spark):
    chunks = spark.createDataFrame([(1, "alpha one"), (2, "alpha two"), (3, "alpha three and more words"), (4, "else")], "id long, text string")
    owner = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 30)], "id long, note_id long")
    q = spark.createDataFrame([(1, "alpha")], "query_id long, query string")
    index = search.TextIndex.build(chunks)
    first = spark.createDataFrame([(1, 4, 0.9, 1), (1, 2, 0.8, 2)], "query_id long, id long, score double, pos int")
    second = spark.createDataFrame([(1, 3, 0.99, 1), (1, 4, 0.1, 2)], "query_id long, id long, score double, pos int")
    got = search.recall(index, q, [first, second], owner=owner, rerank=None).orderBy("pos").collect()
    # note 10: first of both lists but one; the second policy's hits follow all of the first's
    assert [(r.id, r.chunk_id, round(r.score, 6)) for r in got] == [(10, 1, round(1 / 61 + 1 / 62, 6)), (20, 3, round(1 / 62 + 1 / 63, 6)), (30, 4, round(1 / 61, 6))]


def test_condense(spark):
    lines = [
        '{"type":"user","message":{"content":"hi <system-reminder>x</system-reminder>"}}',
        '{"type":"user","isMeta":true,"message":{"content":"meta"}}',
        '{"type":"assistant","isSidechain":true,"message":{"content":"sub"}}',
        '{"type":"assistant","message":{"content":[{"type":"thinking","text":"t"},{"type":"text","text":"yes"},{"type":"tool_use","name":"Bash","input":{"command":"ls  -l","description":" "}}]}}',
        '{"type":"attachment","attachment":{"type":"queued_command","prompt":"more","origin":{"kind":"human"}}}',
        '{"type":"user","message":"plain old"}',
        "not json",
        '{"broken": ',
        "  ",
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    got = [r.line for r in transcripts.condense(df, ["i"]).orderBy("i", "part").collect()]
    assert got == ["User: hi", "Assistant: yes", "Tool: Bash ls -l", "User: more", "User: plain old", "not json", '{"broken":']


def test_parse_extraction(spark):
    outs = [
        'Sure: ```json {"notes":[{"kind":" FACT ","text":"a"}],"tasks":[{"title":"t","due":"2024-13-01"}],"task_updates":[{"id":3,"status":"Done"},{"id":4,"status":"odd"}]} ```',
        '{"notes":[{"kind":"odd","text":"a"}]}',
        '{"notes":[],"tasks":[{"title":" "}]}',
        "no json",
    ]
    got = transcripts.parse_extraction(spark.createDataFrame([(i, o) for i, o in enumerate(outs)], "i int, output string")).orderBy("i").collect()
    assert [r.error for r in got] == [None, "note", "task", "json"]
    ex = got[0].ex
    assert ex.notes[0].kind == "fact" and ex.tasks[0].due == "" and [u.status for u in ex.task_updates] == ["done", ""]


def test_briefing_render(spark):
    rows = [(1, 1, 1, "- a" * 10), (1, 1, 2, "- " + "long " * 500), (1, 2, 1, "- b")]
    r = reports.render_briefing(spark.createDataFrame(rows, "space_id long, section int, nth int, line string"), {1: "One", 2: "Two"}, 100).first()
    assert r.n_cut == 1 and "## Two\n- b\n" in r.text and "long" not in r.text


def test_sequential_near_dups(spark):
    rows = [(0, 1, "fact", [1.0, 0.0]), (0, 2, "fact", [0.97, 0.243]), (0, 3, "fact", [0.9, 0.436]), (0, 4, "fact", [0.0, 0.0]), (0, 5, "note", [1.0, 0.0]), (0, 6, "note", [1.0, 0.0])]
    got = reports.sequential_near_dups(spark.createDataFrame(rows, "g long, id long, kind string, vec array<double>"), ["g"]).orderBy("id").collect()
    assert [r.copy_of for r in got] == [None, 1, None, None, None, 5]  # 3 is near 2, which was skipped


def test_guard(spark):
    df = spark.createDataFrame([(8, 5), (8, 4), (7, 7)], "size int, gone int")
    assert [r.skip for r in reports.merge_guard(df, F.col("gone")).collect()] == [True, False, False]


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "t"))
    assert v.write(spark.range(1), expect=0) == 1 and v.write(spark.range(2), expect=0) is None and v.write(spark.range(2), expect=1) == 2
    assert v.read().count() == 2 and v.keep(1) == 1 and v.versions() == [2]
    # a writer that claimed a number holds it, whatever the other one read
    assert v._claim(3) and v.write(spark.range(3), expect=2) is None and v.write(spark.range(3)) == 4


def test_vault(spark, tmp_path):
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    n = spark.createDataFrame([(1, 1, "fact", "Hello there\nx", 'to"ol', None, ["a", 'b"'], at, at, "s1"), (2, 9, "note", "gone", "tool", 5, [], at, at, None)], "id long, space_id long, kind string, text string, source string, deleted_h long, tags array<string>, created_at timestamp, updated_at timestamp, session_id string")
    assert [r.path for r in vault_notes(n, {1: "personal"}).collect()] == ["personal/fact/1-hello-there.md"]
    t = spark.createDataFrame([(1, 2, "done", "t", None), (1, 1, "open", "s", "go")], "space_id long, id long, status string, title string, next_step string")
    r = spark.createDataFrame([(1, "a", "b", "uses", 5), (2, "c", "d", "is", None)], "id long, from_ref string, to_ref string, rel_type string, source_note_id long")
    root = str(tmp_path / "v")
    assert write_vault(n, t, r, root, {1: "personal"}) == {"notes": 1, "tasks": 2, "relations": 2}
    assert (tmp_path / "v/personal/fact/1-hello-there.md").read_text() == '---\nkind: fact\ntags: ["a","b\\""]\ncreated: 2024-01-02T03:04:05Z\nupdated: 2024-01-02T03:04:05Z\nsource: "to\\"ol"\nsession: s1\n---\n\nHello there\nx\n'
    assert [x.value for x in spark.read.text(f"{root}/tasks/space_id=1").collect()] == ["- [ ] s — next: go", "- [x] t"]
    assert sorted(x.value for x in spark.read.text(f"{root}/relations").collect()) == ["- a → b (uses) — note #5", "- c → d (is)"]


def test_consolidation_batches(spark):
    rows = [(1, None if i % 2 else "p", "fact", i, "x" * 190) for i in range(400)] + [(2, "q", "fact", 1000, "alone")]
    n = spark.createDataFrame([(*r, "active", None) for r in rows], "space_id long, project string, kind string, id long, text string, status string, deleted_h int").repartition(7)
    got = {(r.proj, r.id): r.batch for r in reports.consolidation_batches(n, 2000).collect()}
    for proj in ("", "p"):
        ids = [i for _, p, _, i, _ in rows if (p or "") == proj]
        assert [got[proj, i] for i in ids if (proj, i) in got] == [k // 10 for k in range(200)]
    assert ("q", 1000) not in got


def test_sampling_numbers_calls_in_order(spark):
    rows = [(i, "op", "m", None if i % 3 else "p", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i % 3000)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, op string, model string, purpose string, ts timestamp").repartition(5)
    want = set()
    for p in (None, "p"):
        mine = sorted((r[4], r[0]) for r in rows if r[3] == p)
        want |= {(i, k) for k, (_, i) in enumerate(mine, 1) if k == 1 or k % 50 == 0}
    assert {(r.id, r.nth) for r in reports.sampled_calls(df).collect()} == want


DELTAS = [(1, 0, 10, "a"), (1, 10, 15, "b"), (1, 10, 15, "b"), (1, 99, 120, "lost"), (2, 0, 5, "c"), (2, 5, 5, "empty")]


def test_capture_is_exactly_once(spark, tmp_path):
    kind = "session_id long, expect_offset long, new_offset long, content string"
    src = tmp_path / "in"
    table = capture.Raws(spark, str(tmp_path / "raws"))
    for i, rows in enumerate([DELTAS, DELTAS, [(1, 15, 20, "d"), (2, 0, 7, "conflict")]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(src / f"b{i}"))
        stream = spark.readStream.schema(kind).parquet(str(src / "b*"))
        capture.capture(stream, table, str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.session_id, r.seq, r.content) for r in table.read().collect())
    assert got == [(1, 1, "a"), (1, 2, "b"), (1, 3, "d"), (2, 1, "c")]
    # a batch that is run again replaces itself
    again = table.add(spark.createDataFrame([(1, 15, 20, "d")], kind), 2)
    assert [(r.session_id, r.seq) for r in again.collect()] == [(1, 3)] and table.read().count() == 4
    assert {r.payload for r in capture.extract_jobs(table.read()).collect()} == {'{"session_id":1}', '{"session_id":2}'}


def test_streams_equal_batches(spark, small, tmp_path):
    from loreforge.sources.adapters import load

    events = load(spark, small, "events")
    usage = load(spark, small, "usage")
    end = dt.datetime(2030, 1, 1)
    for name, df, fn, keys in (("usage", usage, capture.hourly_usage, ["op", "model", "purpose", "hour"]), ("sessions", events, capture.sessions, ["user_id", "started_at"])):
        path = str(tmp_path / name)
        # a last row far ahead moves the watermark past all others
        last = df.limit(1).withColumn("ts", F.lit(end))
        df.coalesce(1).write.parquet(path)
        last.write.mode("append").parquet(path)
        last.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY")).write.mode("append").parquet(path)
        q = fn(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)).writeStream.format("memory").queryName(f"out_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / f"cp_{name}")).start()
        q.processAllAvailable()
        q.stop()
        batch = {tuple(r[k] for k in keys) + tuple(v for k, v in sorted(r.asDict().items()) if k not in keys) for r in fn(df).collect()}
        rows = [r for r in spark.table(f"out_{name}").collect()]
        stream = {tuple(r[k] for k in keys) + tuple(v for k, v in sorted(r.asDict().items()) if k not in keys) for r in rows}
        stream = {x for x in stream if not any(isinstance(v, dt.datetime) and v.year >= 2030 for v in x)}
        assert stream == batch


def test_recall_needs_a_space(spark):
    chunks = spark.createDataFrame([(1, "alpha"), (2, "alpha beta")], "id long, text string")
    q = spark.createDataFrame([(1, "beta")], "query_id long, query string")
    index = search.TextIndex.build(chunks)
    assert search.recall(index, q, notes=chunks.select("id", F.lit("p").alias("project")).limit(0)).count() == 0
    assert [r.id for r in search.recall(index, q).collect()] == [2]
    with pytest.raises(Exception):  # noqa: B017
        search.bm25(index, q, chunks.select("text")).collect()
