"""Structured Streaming forms on small files."""

import datetime as dt

from lodestone.sources import tables
from lodestone.streaming import topup


def test_stream_top_up_is_idempotent(spark, tmp_path):
    tables.ensure_table(spark, "lode_stream", "chunk_id string, n int", reset=True)
    source = f"{tmp_path}/in"
    spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, n int").write.parquet(source)
    for k in range(2):
        stream = spark.readStream.schema("chunk_id string, n int").parquet(source)
        topup.top_up_stream(stream, "lode_stream", "chunk_id", f"{tmp_path}/cp{k}").awaitTermination(120)
    assert spark.table("lode_stream").count() == 2
    spark.sql("DROP TABLE lode_stream")


def test_windows_and_state(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(minutes=m), 1, "click", 1.0) for m in (0, 10, 70, 400)]
    spark.createDataFrame(rows, "ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema("ts timestamp, user_id long, event_type string, value double").parquet(f"{tmp_path}/ev")
    q = topup.windowed_counts(stream).writeStream.format("memory").queryName("lode_win").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    # the last event moves the watermark past the first two windows only
    assert sorted(r["n"] for r in spark.table("lode_win").collect()) == [1, 2]
    steps = stream.selectExpr("user_id as qid", "event_type as tool")
    q = topup.question_state(steps, 3).writeStream.format("memory").queryName("lode_state").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["qid"], r["steps"], r["done"]) for r in spark.table("lode_state").collect()] == [(1, 4, True)]


def test_sessions_and_first_rows(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(minutes=m), u) for m, u in ((0, 1), (20, 1), (90, 1), (5, 2), (600, 3))]
    spark.createDataFrame(rows, "ts timestamp, user_id long").write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema("ts timestamp, user_id long").parquet(f"{tmp_path}/ev")
    q = topup.sessions(stream).writeStream.format("memory").queryName("lode_ses").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["user_id"], r["n"]) for r in spark.table("lode_ses").collect()) == [(1, 1), (1, 2), (2, 1)]
    q = topup.first_by_key(stream, "user_id", "ts").writeStream.format("memory").queryName("lode_first").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["user_id"] for r in spark.table("lode_first").collect()) == [1, 2, 3]
