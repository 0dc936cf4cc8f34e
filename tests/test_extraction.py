import json
import random
from datetime import datetime

import numpy as np
import pytest
from loreforge.operators import extraction as X
from loreforge.operators import memory, reports, writing
from loreforge.operators.extraction import KEYS, SCHEMAS, TableSet
from loreforge.sources.scratch import shared_path
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def now():
    return F.lit("2024-05-01 10:00:00").cast("timestamp")


def store_with(spark, **rows):
    store = TableSet(spark, shared_path(spark, "test-tables"), SCHEMAS, KEYS)
    store.commit("load", {t: spark.createDataFrame(r, SCHEMAS[t]) for t, r in rows.items()})
    return store


def note(i, space, kind, text, **more):
    names = [x.split()[0] for x in SCHEMAS["notes"].split(", ")]
    base = {"id": i, "space_id": space, "kind": kind, "text": text, "tags": ["old"], "source": "tool:remember", "content_hash": None, "created_at": T0, "updated_at": T0, "status": "active"}
    return tuple((base | more).get(n) for n in names)


def task(i, space, title, **more):
    names = [x.split()[0] for x in SCHEMAS["tasks"].split(", ")]
    base = {"id": i, "space_id": space, "title": title, "status": "open", "created_at": T0, "updated_at": T0}
    return tuple((base | more).get(n) for n in names)


def said(i, session, seq, text):
    return (i, session, seq, json.dumps({"type": "user", "message": {"content": text}}), None)


VECTORS = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [0.7, 0.7]}


def embedder():
    known = dict(VECTORS)

    def embed(texts):  # goes to the workers by value
        return [known.get(t[0], [-1.0, float(len(t))]) for t in texts]

    return embed


def answers(spark, outs):
    df = spark.createDataFrame([(s, o, json.dumps(x) if isinstance(x, dict) else x) for (s, o), x in outs.items()], "session_id long, ordinal int, output string")
    return lambda prompts: prompts.select("session_id", "ordinal").join(df, ["session_id", "ordinal"])


def sessions(spark, *rows):
    return spark.createDataFrame(list(rows), "session_id long, space_id long, project string")


def test_one_batch_over_all_tables(spark, monkeypatch):
    monkeypatch.setattr(X, "WINDOW_CHARS", 40)
    real = X.session_windows
    monkeypatch.setattr(X, "session_windows", lambda raws: real(raws, 40))
    long = ["first window, some words here...", "second window, other words here"]
    store = store_with(
        spark,
        notes=[note(1, 7, "fact", "a old fact"), note(2, 7, "decision", "zz"), note(3, 7, "note", "b gone", deleted_at=T0, content_hash=None)],
        tasks=[task(1, 7, "Write docs", project="p"), task(2, 7, "Other", project="q"), task(3, 7, "Done one", status="done"), task(4, 8, "Elsewhere")],
        relations=[(5, 7, "x", "y", "r", 1, T0), (6, 7, "x", "z", "r", 2, T0)],
        raws=[said(1, 1, 1, long[0]), said(2, 1, 2, long[1]), said(3, 2, 1, "hello"), said(4, 3, 1, "bad"), said(5, 9, 1, "not asked for")],
        vectors=[(1, VECTORS["a"]), (2, VECTORS["c"])],
    )
    note_of = lambda kind, text, **m: {"kind": kind, "text": text} | m
    outs = {
        (1, 0): {"notes": [note_of("Fact", " a new fact ", tags=["t"], who=["Ann"], when=" 2024 ", as_of="x", ref="r", alternatives=["o"], scope="s", why="w"), note_of("note", "b event")], "tasks": [{"title": "write DOCS!", "next_step": "go", "constraints": "none"}],
                 "task_updates": [{"id": 2, "status": "done"}, {"id": 3, "status": "done"}, {"id": 4, "next_step": "n"}], "relations": [{"from": "A", "to": "B", "type": "t", "note_index": 1}, {"from": "A", "to": "C", "type": "t", "note_index": 2}]},
        (1, 1): {"notes": [note_of("fact", "a new fact, again"), note_of("decision", "new one")], "tasks": [{"title": "Fresh", "due": "2024-06-31"}], "relations": [{"from": "D", "to": "E", "type": "t", "note_index": 0}, {"from": "D", "to": "F", "type": "t", "note_index": 1}]},
        (2, 0): {"notes": [note_of("note", "b event")]},
        (3, 0): "no json",
    }
    seen = []
    model = answers(spark, outs)

    def asked(prompts):
        seen.extend(prompts.collect())
        return model(prompts)

    who = sessions(spark, (1, 7, "p"), (2, 7, None), (3, 7, None))
    assert X.extract(store, "x1", who, asked, embedder(), now())
    text = {(r.session_id, r.ordinal): r.text for r in seen}
    assert text[1, 1] == "Open tasks (id: title):\n#1: Write docs\n#2: Other\n\nTranscript:\nUser: second window, other words here\n"
    notes = {r.text: r for r in store.read("notes").collect()}
    assert set(notes) == {"zz", "b gone", "a new fact", "b event", "new one"}  # the old fact was replaced, its echo skipped
    a = notes["a new fact"]
    assert (a.kind, a.tags, a.who, a.when, a.as_of, a.ref, a.alternatives, a.scope, a.why, a.project, a.session_id, a.source) == ("fact", ["t"], ["Ann"], "2024", "x", "r", ["o"], "s", "w", "p", 1, "hook:stop")
    assert sorted(r.id for r in notes.values()) == [2, 3, 4, 5, 6]
    tasks = {r.title: r for r in store.read("tasks").collect()}
    assert (tasks["Write docs"].next_step, tasks["Write docs"].constraints, tasks["Write docs"].id) == ("go", "none", 1)
    assert (tasks["Fresh"].id, tasks["Fresh"].due_at, tasks["Fresh"].status, tasks["Fresh"].project) == (5, None, "open", "p")
    assert tasks["Other"].status == "done" and tasks["Elsewhere"].next_step is None and tasks["Elsewhere"].updated_at == T0
    rel = {(r.from_ref, r.to_ref): r.source_note_id for r in store.read("relations").collect()}
    assert rel == {("x", "z"): 2, ("A", "B"): notes["b event"].id, ("A", "C"): None, ("D", "E"): None, ("D", "F"): notes["new one"].id}
    raws = {r.id: r.extracted_at is not None for r in store.read("raws").collect()}
    assert raws == {1: True, 2: True, 3: True, 4: False, 5: False}
    assert {r.id for r in store.read("vectors").collect()} == {2, *(notes[t].id for t in ("a new fact", "b event", "new one"))}

    def never(prompts):
        raise AssertionError("asked twice")

    assert not X.extract(store, "x1", who, never, embedder(), now())
    before = {t: store.read(t).count() for t in SCHEMAS}
    assert store.compact("c") and {t: store.read(t).count() for t in SCHEMAS} == before


def test_a_killed_run_leaves_nothing(spark):
    store = store_with(spark, notes=[note(1, 7, "fact", "a old fact")], tasks=[], relations=[], raws=[said(1, 1, 1, "hello")], vectors=[(1, VECTORS["a"])])
    who, out = sessions(spark, (1, 7, None)), answers(spark, {(1, 0): {"notes": [{"kind": "fact", "text": "a fact"}]}})
    state = lambda: {t: sorted(map(repr, store.read(t).collect())) for t in SCHEMAS}
    before = state()
    real = store._seal

    def killed(path):
        raise KeyboardInterrupt

    store._seal = killed
    with pytest.raises(KeyboardInterrupt):
        X.extract(store, "x", who, out, embedder(), now())
    assert state() == before and store.batches() == ["load"]
    store._seal = real
    assert X.extract(store, "x", who, out, embedder(), now())
    assert {r.text for r in store.read("notes").collect()} == {"a fact"} and store.batches() == ["load", "x"]


def test_rewritten_note_is_revived_and_nothing_is_multiplied(spark):
    from loreforge.operators.state import content_hash

    h = spark.range(1).select(content_hash(F.lit(7), F.lit("note"), F.lit("b back"))).first()[0]
    store = store_with(spark, notes=[note(1, 7, "note", "b back", deleted_at=T0, status="superseded", content_hash=h, project="first", why="old", scope="kept")], tasks=[], relations=[], raws=[said(1, 1, 1, "x"), said(2, 2, 1, "y"), said(3, 3, 1, " ")], vectors=[])
    out = {(1, 0): {"notes": [{"kind": "note", "text": "b back ", "why": "new", "tags": ["z"]}]}, (2, 0): {}}
    assert X.extract(store, "x", sessions(spark, (1, 7, "p"), (2, 7, None), (3, 7, None)), answers(spark, out), embedder(), now())
    (r,) = store.read("notes").collect()
    assert (r.id, r.status, r.deleted_at, r.project, r.why, r.scope, r.tags, r.created_at) == (1, "active", None, "first", "new", "kept", ["old", "z"], T0)
    assert all(x.extracted_at for x in store.read("raws").collect())


def test_relations_of_two_outputs(spark):
    out = '{"notes":[{"kind":"fact","text":"a"}],"relations":[{"from":"x","to":"y","type":"r","note_index":0},{"from":"x","to":"z","type":"r","note_index":1}]}'
    df = spark.createDataFrame([(1, 1, None, 0, out), (1, 1, None, 1, out)], "session_id long, space_id long, project string, ordinal int, output string")
    x = X.extracted(df, spark.createDataFrame([], "id long"))
    assert sorted((r.nth, r.note_nth) for r in x.relations.collect()) == [(0, 0), (1, None), (2, 1), (3, None)]
    assert sorted((r.nth, r.text) for r in x.notes.collect()) == [(0, "a"), (1, "a")]


def sequential(rows, at):
    out, kept = {}, {}
    for g, i, kind, v in sorted(rows, key=lambda r: r[1]):
        m = np.asarray(v or [], float)
        of = None
        for j, w in kept.setdefault((g, kind), []):
            n = np.linalg.norm(m) * np.linalg.norm(w) if len(m) == len(w) else 0
            if n and m @ w / n >= at - 1e-12:
                of = j
                break
        out[i] = of
        if of is None:
            kept[g, kind].append((i, m))
    return out


def test_greedy_rule_in_rounds(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(3)), int(i), str(rng.choice(["fact", "note"])), [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(rng.uniform(0, 3, 300))]
    rows += [(0, 1000 + i, "fact", [0.0, 0.0]) for i in range(3)] + [(0, 1010, "fact", []), (0, 1011, "fact", None), (0, 1012, "fact", [1.0, 0.0, 0.0])] + [(0, 1020 + i, "fact", rows[0][3]) for i in range(5)]
    # a chain: each is like its neighbours only
    rows += [(9, 2000 + i, "fact", [float(np.cos(i * 0.2)), float(np.sin(i * 0.2))]) for i in range(15)]
    df = spark.createDataFrame(rows, "g long, id long, kind string, vec array<double>")
    got = {r.id: r.copy_of for r in reports.sequential_near_dups(df, ["g"], 0.98).collect()}
    assert got == sequential(rows, 0.98)


def test_greedy_rule_on_a_large_group(spark):
    rng = random.Random(2)
    rows = [(0, i, "fact", [rng.gauss(0, 1) for _ in range(4)]) for i in range(10_000)]
    df = spark.createDataFrame(rows, "g long, id long, kind string, vec array<double>")
    got = {r.id: r.copy_of for r in reports.sequential_near_dups(df, ["g"], 0.995).collect()}
    v = np.array([r[3] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    kept, want = np.zeros((0, 4)), {}
    names = []
    for i in range(len(v)):
        hit = np.flatnonzero(kept @ v[i] >= 0.995 - 1e-12)
        want[i] = names[hit[0]] if len(hit) else None
        if not len(hit):
            kept, names = np.vstack([kept, v[i]]), [*names, i]
    assert got == want


def test_merge_patch_to_any_depth(spark):
    cases = [('{"a":{"x":1,"y":2}}', '{"a":{"x":null}}', {"a": {"y": 2}}), ('{"a":1}', '{"a":{"b":{"c":null,"d":[1,null]}}}', {"a": {"b": {"d": [1, None]}}}), ('{"a":{"b":{"c":{"d":{"e":1,"f":2}}}}}', '{"a":{"b":{"c":{"d":{"e":null}}}}}', {"a": {"b": {"c": {"d": {"f": 2}}}}}), ("[1]", '{"a":"é"}', {"a": "é"}), ('{"a":1}', None, {"a": 1})]
    df = spark.createDataFrame([(i, o, p) for i, (o, p, _) in enumerate(cases)], "i int, o string, p string")
    assert {r.i: json.loads(r.m) for r in df.select("i", writing.merge_patch(F.col("o"), F.col("p")).alias("m")).collect()} == {i: w for i, (_, _, w) in enumerate(cases)}


def test_summary_input_at_every_bound(spark):
    rows = [(i, 0, "x" * (i % 5 + 1)) for i in range(12)]
    whole = "\n".join(r[2] for r in rows)
    df = spark.createDataFrame([(1, *r) for r in rows], "k long, seq int, part int, line string")
    for most in range(1, len(whole) + 2, 3):
        want = whole if len(whole) <= most else "… [cut]\n" + whole[-most:]
        assert memory.summary_input(df, ["k"], most).first().text == want, most
