"""Incremental maintenance, in batches and as streams."""

import datetime as dt

from papyra.streaming import incremental as I


def test_maintained_index(spark, tmp_path):
    schema = "doc_id long, pos int, text string"
    src, out = str(tmp_path / "src"), str(tmp_path / "index")
    for rows in ([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], [(1, 0, "A")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        I.maintain(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.doc_id, r.pos, r.text) for r in I.current_index(spark, out).collect()) == [(1, 0, "A"), (2, 0, "c")]


def test_job_states(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(1, t(0), "queued"), (1, t(1), "building"), (1, t(2), "ready"), (2, t(0), "building"), (2, t(1), "queued")]
    schema = "doc_id long, ts timestamp, state string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "e"))
    q = I.job_states(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("jobs_t").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.doc_id, r.state, r.applied, r.refused) for r in spark.table("jobs_t").collect()} == {(1, "ready", 3, 0), (2, "queued", 1, 1)}


def test_windowed_counts(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h, m), "view") for h in (0, 1) for m in (1, 30)]
    spark.createDataFrame(rows, "ts timestamp, event_type string").coalesce(1).write.parquet(str(tmp_path / "w"))
    q = I.windowed_counts(spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "w"))).writeStream.format("memory").queryName("w_t").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("w_t").collect()] == [2, 2]
