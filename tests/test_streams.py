import gzip
import time

import pytest
from loreforge.sources import pages
from loreforge.streaming import capture, debounce, transcripts
from pyspark.sql import functions as F
from test_documents import zipped


@pytest.fixture
def source(spark, tmp_path):
    transcripts.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()

    def run(**options):
        q = spark.readStream.format("transcripts").option("path", str(folder)).options(**options).load()
        done = []
        q = q.writeStream.foreachBatch(lambda df, n: done.extend((r.session_id, r.expect_offset, r.new_offset, r.content, r.reset) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(done)

    return folder, run


def test_transcripts_go_on_after_a_restart(source):
    folder, run = source
    a, b = folder / "a.jsonl", folder / "b.jsonl"
    a.write_bytes(b'{"x":1}\n{"half')
    (folder / "other.txt").write_bytes(b"no\n")
    assert run() == [("a", 0, 8, '{"x":1}\n', False)]
    assert run() == []
    with a.open("ab") as f:
        f.write('":"é"}\n{"y":'.encode())
    b.write_bytes(b"one\n")
    assert run() == [("a", 8, 22, '{"half":"é"}\n', False), ("b", 0, 4, "one\n", False)]
    a.write_bytes(b"new\n")  # begun anew, and shorter
    assert run() == [("a", 22, 4, "new\n", True)]
    with a.open("ab") as f:
        f.write(b"more\n")
    assert run() == [("a", 4, 9, "more\n", False)]


def test_rows_and_batches_are_bounded(source, monkeypatch):
    folder, run = source
    (folder / "a.jsonl").write_bytes(b"".join(b"%04d\n" % i for i in range(100)) + b"z" * 200 + b"\n" + b"end\nhalf")
    reader = transcripts.TranscriptReader({"path": str(folder), "maxBytesPerBatch": "50"})
    monkeypatch.setattr(transcripts, "ROW_BYTES", 32)
    monkeypatch.setattr(transcripts, "LOOK", 16)
    at, got, ends = reader.initialOffset(), [], []
    reader.known = at
    while (to := reader.latestOffset()) != at:
        for p in reader.partitions(at, to):
            got += reader.read(p)
        at = to
        ends.append(at["files"]["a.jsonl"]["end"])
    assert "".join(r[3] for r in got).encode() == (folder / "a.jsonl").read_bytes()[:-4]
    assert all(x[2] == y[1] for x, y in zip(got, got[1:], strict=False)) and not any(r[4] for r in got)
    assert max(b - a for a, b in zip([0, *ends], ends, strict=False)) <= 205 and len(ends) >= 10
    assert all(len(r[3]) <= 40 or "z" in r[3] for r in got)


def test_capture_from_transcripts(spark, source, tmp_path):
    folder, _ = source
    table = capture.Raws(spark, str(tmp_path / "raws"))
    table.SCHEMA = "session_id string, seq int, expect_offset long, new_offset long, content string"

    def run():
        s = spark.readStream.format("transcripts").option("path", str(folder)).load()
        capture.capture(s, table, str(tmp_path / "cp2")).awaitTermination()

    a = folder / "a.jsonl"
    for body in (b"1\n2\n", b"1\n2\n3\n", b"9\n", b"9\n8\n"):  # grown, begun anew, grown
        a.write_bytes(body)
        run()
    assert [(r.seq, r.content) for r in table.read().orderBy("seq").collect()] == [(1, "1\n2\n"), (2, "3\n"), (3, "9\n"), (4, "8\n")]


def test_spool_files(spark, tmp_path):
    names = ["s-1~0~5~17.gz", "s-1~5~9~18.gz", "s-1~50~60~19.gz", "old-id-17.gz", ".s~0~5~1.gz.tmp", "~0~5~1.gz", "s~x~5~1.gz", "a~b.gz", "s.txt"]
    for n in names:
        (tmp_path / n).write_bytes(gzip.compress(n.encode()))
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    got = capture.spool_files(files)
    assert sorted((r.session_id, r.expect_offset, r.new_offset) for r in got.collect()) == [("old-id", -1, 0), ("s-1", 0, 5), ("s-1", 5, 9), ("s-1", 50, 60)]
    none = spark.createDataFrame([], "session_id string, seq int, expect_offset long, new_offset long, content binary")
    took = capture.accept_deltas(none, got)
    assert sorted((r.session_id, r.expect_offset) for r in took.collect()) == [("old-id", -1), ("s-1", 0), ("s-1", 5)]


def test_jobs_of_a_session(spark):
    kind = "type string, payload string, state string, run_after timestamp, updated_at timestamp"
    late, now = F.lit("2024-05-02").cast("timestamp"), F.lit("2024-05-01").cast("timestamp")
    rows = [("extract", f'{{"session_id":{i}}}', s) for i, s in enumerate(["queued", "failed", "running", "done"])]
    jobs = spark.createDataFrame([(*r, None, None) for r in rows], kind).withColumn("run_after", late)
    new = spark.range(5).select(F.col("id").alias("session_id"))
    assert sorted(r.payload for r in capture.extract_jobs(new, jobs).collect()) == ['{"session_id":2}', '{"session_id":3}', '{"session_id":4}']
    after = capture.expedite(jobs, new, now)
    assert [r.state for r in after.filter(F.col("run_after") == now).collect()] == ["queued"]


def test_debounce_with_timers_over_a_restart(spark, tmp_path):
    spark.conf.set(*debounce.PROVIDER)
    kind = "session_id string, event string, at int"
    src, n = str(tmp_path / "in"), [0]

    def put(*rows):
        n[0] += 1
        spark.createDataFrame(list(rows), kind).coalesce(1).write.mode("append").json(src)

    put(("a", "delta", 1), ("a", "delta", 2), ("b", "delta", 1), ("f", "delta", 1), ("f", "failed", 2), (None, "delta", 1))

    def start():
        s = spark.readStream.schema(kind).json(src)
        return debounce.debounced(s, 15).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="500 milliseconds").start(str(tmp_path / "out"))

    def fired():
        try:
            return sorted((r.session_id, r.reason, r.n) for r in spark.read.schema(debounce.OUT).parquet(str(tmp_path / "out")).collect())
        except Exception:
            return []

    def wait_for(want):
        end = time.time() + 60
        while fired() != want and time.time() < end:
            time.sleep(0.5)
        assert fired() == want

    q = start()
    end = time.time() + 40
    while not (q.lastProgress and q.lastProgress["batchId"] >= 0 and sum(p["numInputRows"] for p in q.recentProgress) >= 6) and time.time() < end:
        time.sleep(0.2)
    q.stop()  # timers are in the state, and outlive the query
    put(("b", "end", 2), ("f", "delta", 3), ("f", "end", 4))
    q = start()
    wait_for([("a", "wait", 2), ("b", "end", 1)])
    put(("a", "delta", 5), ("f", "done", 5), ("f", "delta", 6))
    wait_for([("a", "wait", 1), ("a", "wait", 2), ("b", "end", 1), ("f", "wait", 1)])
    q.stop()


def test_documents_by_page(spark, tmp_path):
    slide = '<sld xmlns:a="urn:a"><a:p><a:r><a:t>s{}</a:t></a:r></a:p></sld>'
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/d.pptx").write_bytes(zipped({f"ppt/slides/slide{i}.xml": slide.format(i) for i in (10, 2)}))
    (tmp_path / "n.md").write_text("# A\n\ntext")
    (tmp_path / "x.docx").write_bytes(b"no zip")
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.txt").write_bytes(b"  ")
    pages.register(spark)
    got = spark.read.format("documents").option("path", str(tmp_path)).option("taskBytes", 1).load()
    rows = sorted((r.path, r.page, r.label, r.text, (r.error or "").split(":")[0]) for r in got.collect())
    assert rows == [("e.txt", 0, None, None, "empty"), ("n.md", 1, None, "⟦A⟧\n\n# A\n\ntext", ""), ("p.pdf", 0, None, None, "unsupported"), ("sub/d.pptx", 1, "slide 2", "s2", ""), ("sub/d.pptx", 2, "slide 10", "s10", ""), ("x.docx", 0, None, None, "BadZipFile")]
    assert got.rdd.getNumPartitions() == 5
    assert pages.dealt([("a", 100), ("b", 60), ("c", 50), ("d", 10)], 110) == [["a", "d"], ["b", "c"]]
