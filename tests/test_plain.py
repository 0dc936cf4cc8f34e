"""Queries that SQL cannot express against plain versions of what they return."""

from collections import defaultdict

import numpy as np
from loreforge.operators import state, transcripts
from loreforge.plans import changes, more, registry  # noqa: F401
from loreforge.plans.registry import QUERIES, _records
from loreforge.sources.adapters import load


def test_near_dup_batches(spark, small):
    kind = {r.id: r.kind for r in load(spark, small, "notes").select("id", "kind").collect()}
    batches = defaultdict(list)
    for r in load(spark, small, "embeddings").collect():
        if r.vec_id in kind:
            v = np.asarray(r.embedding, np.float64)
            batches[r.vec_id // 50].append((r.vec_id, kind[r.vec_id], v / np.linalg.norm(v)))
    want = {}
    for b, rows in batches.items():
        kept = []
        for i, k, v in sorted(rows, key=lambda r: r[0]):
            near = [j for j, q, w in kept if q == k and float(w @ v) >= 0.3]
            want[b, i] = near[0] if near else None
            if not near:
                kept.append((i, k, v))
    assert {(r.batch, r.id): r.copy_of for r in QUERIES["near_dup_batches"](spark, small).collect()} == want
    assert any(x is not None for x in want.values())


def test_briefing_render(spark, small):
    titles = dict(enumerate(["Quá hạn / sắp đến hạn", "Đang chờ người khác", "Việc đang mở", "Quyết định gần đây", "Sở thích", "Liên quan", "Phiên gần đây", "Notes mới"], 1))
    spaces = defaultdict(list)
    for r in QUERIES["briefing_sections"](spark, small).collect():
        spaces[r.space_id].append((r.section, r.nth, r.line))
    want = {}
    for s, rows in spaces.items():
        text, cut, last = "# Briefing\n\n", 0, None
        for section, _, line in sorted(rows):
            more_text = line + "\n" if section == last else f"## {titles[section]}\n{line}\n"
            if (len(text) + len(more_text) + 3) // 4 > 1500:
                cut += 1
                continue
            text, last = text + more_text, section
        want[s] = (text + (f"… (còn {cut} mục bị cắt do ngân sách)\n" if cut else ""), cut)
    assert {r.space_id: (r.text, r.n_cut) for r in QUERIES["briefing_render"](spark, small).collect()} == want


def test_transcript_windows(spark, small):
    said = defaultdict(list)
    for r in transcripts.condense(_records(spark, small), ["session_id", "seq"]).collect():
        said[r.session_id].append((r.seq, r.part, r.line))
    want = set()
    for s, lines in said.items():
        windows = [""]
        for line in "\n".join(x for _, _, x in sorted(lines)).split("\n"):
            line += "\n"
            if windows[-1] and len(windows[-1]) + len(line) > 4000:
                windows.append("")
            windows[-1] += line
        windows[-1] = windows[-1][:-1]
        gone = max(0, len(windows) - 2)
        want |= {(s, i, w, gone) for i, w in enumerate(windows[gone:]) if w}
    assert {(r.session_id, r.ordinal, r.text, r.dropped) for r in QUERIES["transcript_windows"](spark, small).collect()} == want


def test_consolidate_batches(spark, small):
    groups = defaultdict(list)
    for r in load(spark, small, "notes").filter("status = 'active' and deleted_h is null").collect():
        if r.kind in state.KNOWLEDGE_KINDS:
            groups[r.space_id, r.project or "", r.kind].append((r.id, min(len(r.text), 200) + 8))
    want = set()
    for key, rows in groups.items():
        batches, size = [[]], 0
        for i, n in sorted(rows):
            if batches[-1] and size + n + 1 > 20_000:
                batches.append([])
                size = 0
            batches[-1].append(i)
            size += n + 1
        want |= {(*key, i, b) for b, ids in enumerate(batches) if len(ids) > 1 for i in ids}
    assert {tuple(r) for r in QUERIES["consolidate_batches"](spark, small).collect()} == want


def test_chunk_documents(spark, small):
    texts = {r.doc_id: r.text for r in load(spark, small, "documents").collect()}
    chunks = defaultdict(dict)
    for r in QUERIES["chunk_documents"](spark, small).collect():
        assert len(r.text) <= 1000 and r.token_count == (len(r.text) + 3) // 4
        chunks[r.id][r.ordinal] = r.text
    for i, text in texts.items():
        parts = [chunks[i][k] for k in range(len(chunks[i]))]
        # nothing but white space is lost, and the order stays
        assert "".join("".join(parts).split()) == "".join((text or "").split())
