"""Streams give what the batch forms give."""

from brute import sessions

from wayspan.streaming.ingest import load_lines, stream_sessions


def test_lines(spark, rows, tmp_path):
    schema = "line_id bigint, feed_id bigint, line_no int, raw string"
    good = "1,2,1700000000,1700000600"
    lines = spark.createDataFrame([(1, 1, 1, "# 5 5"), (2, 1, 2, good), (3, 1, 3, "x"), (4, 1, 4, None)], schema)
    lines.write.parquet(f"{tmp_path}/in")
    feed = spark.createDataFrame([(1, ",", 4, 10, 10)], "feed_id bigint, sep string, n_cols int, n_upper bigint, n_lower bigint")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    load_lines(stream, feed, f"{tmp_path}/visits", f"{tmp_path}/rejects", f"{tmp_path}/check").awaitTermination(120)
    assert rows(spark.read.parquet(f"{tmp_path}/visits").select("rec_id", "u", "v", "ts", "te")) == [(2, 1, 2, 1700000000, 1700000600)]
    assert rows(spark.read.parquet(f"{tmp_path}/rejects").select("line_id", "reason")) == [(3, "columns"), (4, "columns")]


def test_sessions(spark, rows, tmp_path):
    data = [(1, 0), (1, 3600), (1, 3600), (1, 7201), (2, 5), (None, 4), (1, None), (3, 10_000_000)]
    df = spark.createDataFrame(data, "u bigint, ts bigint")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = stream_sessions(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    query = out.writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = [(u, a, b, n) for u, a, b, _, n, _ in sessions([(u, t, 1) for u, t in data], 3600) if u != 3]
    assert rows(spark.table("found").select("u", "s_start", "s_end", "n_starts")) == want
