from loreforge.sources.logs import LogSink, log_calls


def test_rotation_and_replay(spark, tmp_path):
    kind = "id long, op string"
    sink = LogSink(spark, str(tmp_path / "log"), most=100)
    src = str(tmp_path / "in")
    for i in range(6):
        spark.createDataFrame([(i * 10 + j, "embed") for j in range(4)], kind).coalesce(1).write.mode("append").parquet(src)
        log_calls(spark.readStream.schema(kind).parquet(src), sink, str(tmp_path / "cp")).awaitTermination()
    assert len(sink.generations()) == 2 and sink.batches()[-1] == 5
    kept = {r.id for r in sink.read(kind).collect()}
    assert {50, 53} <= kept and 0 not in kept and all(sink.size(g) <= 250 for g in sink.generations())
    # a batch that is sent again is there already
    assert not sink.add(spark.createDataFrame([(99, "x")], kind), 5) and 99 not in {r.id for r in sink.read(kind).collect()}
