import datetime as dt

from loreforge.operators import reports
from pyspark.sql import functions as F

NOW = "2026-10-06 09:00:00"
TASK = "id long, space_id long, title string, status string, project string, owner string, waiting_on string, next_step string, due_at date, updated_at timestamp"


def day(s, hour=8):
    return dt.datetime.fromisoformat(f"{s} {hour:02d}:00:00")


def test_lines_of_a_briefing(spark):
    at = F.lit(NOW).cast("timestamp")
    rows = [
        (1, 1, "Prepare the demo", "open", "p", None, None, None, None, day("2026-10-05")),
        (2, 1, "Report", "open", "q", "Ann", None, "part 2", None, day("2026-09-20")),
        (3, 1, "Late", "open", None, None, "Bob", "", dt.date(2026, 10, 5), day("2026-10-05")),
        (4, 1, "Soon", "open", "p", "", "", None, dt.date(2026, 10, 6), day("2026-10-05")),
    ]
    tasks = spark.createDataFrame(rows, TASK)
    got = {r.id: r.l for r in tasks.select("id", reports.task_line(tasks, F.to_date(at), at, "p").alias("l")).collect()}
    assert got == {
        1: "- #1 (cập nhật 2026-10-05): Prepare the demo",
        2: "- #2 (cập nhật 2026-09-20, stale): Report [q] — người làm: Ann — bước kế: part 2",
        3: "- #3 (QUÁ HẠN 2026-10-05): Late — chờ: Bob",
        4: "- #4 (hạn 2026-10-06): Soon",
    }
    notes = spark.createDataFrame([(1, "use x", "because x is fast", "web", "q"), (2, "y since z", "z", None, "p"), (3, "t", None, "", None)], "id long, text string, why string, scope string, project string")
    lines = {r.id: r.l for r in notes.select("id", reports.note_line(notes, F.lit("2026-10-03").cast("date"), "p").alias("l")).collect()}
    assert lines == {1: "- 2026-10-03: use x (vì: because x is fast) [web] [q]", 2: "- 2026-10-03: y since z", 3: "- 2026-10-03: t"}
    assert reports.briefing_head("2026-10-06") == "# Briefing — 2026-10-06"
    assert reports.briefing_head("2026-10-06", "p", "work") == "# Briefing — 2026-10-06 — project p — space work"


def test_render_within_the_budget(spark):
    items = spark.createDataFrame([(1, 3, 1, "- a"), (1, 3, 2, "- " + "x" * 900), (1, 4, 1, "- b")], "space_id long, section int, nth int, line string")
    r = reports.render_briefing(items, budget=40, head=reports.briefing_head("2026-10-06")).first()
    assert r.text == "# Briefing — 2026-10-06\n\n## Việc đang mở\n- a\n## Quyết định gần đây\n- b\n… (còn 1 mục bị cắt do ngân sách)\n" and r.n_cut == 1


def test_doctor(spark):
    good = spark.createDataFrame([(1,), (2,)], "id long")
    bad = spark.createDataFrame([(1,), (1,), (None,)], "id long")
    media = spark.createDataFrame([("/a",), ("/b",), ("",), (None,), ("/b",)], "path string")
    files = spark.createDataFrame([("/a",)], "path string")
    got = {r.name: (r.state, r.n) for r in reports.doctor_checks({"notes": (good, "id"), "tasks": (bad, "id")}, media, files, 8, 8).collect()}
    assert got == {"keys of notes": ("ok", 0), "keys of tasks": ("fail", 2), "schema version": ("ok", 0), "media files": ("warn", 1)}
    assert [r.path for r in reports.missing_media(media, files).collect()] == ["/b"]
