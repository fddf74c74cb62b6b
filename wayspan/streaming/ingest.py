"""Structured Streaming forms of the loaders: lines as they arrive, and arrivals into open-ended sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from wayspan.sources.rejects import parse_lines


def load_lines(lines: DataFrame, feed: DataFrame, visits_path: str, rejects_path: str, checkpoint: str) -> StreamingQuery:
    """Parse a stream of raw lines: valid ones are appended to visits_path, the others with their reason to rejects_path.

    lines: a streaming DataFrame of line_id, feed_id, line_no, raw; feed: a static table. Both
    sinks of a batch are keyed by its number, so a batch that is run again replaces its own files.
    An empty batch writes nothing but empty files. checkpoint must be in a shared folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        parsed = parse_lines(batch, feed).persist()
        good = parsed.where("reason IS NULL").select(F.col("line_id").alias("rec_id"), "u", "v", "ts", "te", "note")
        good.write.mode("overwrite").parquet(f"{visits_path}/batch={number}")
        parsed.where("reason IS NOT NULL").select("line_id", "reason").write.mode("overwrite").parquet(f"{rejects_path}/batch={number}")
        parsed.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_sessions(arrivals: DataFrame, gap: int = 3600, late: int = 14 * 86_400) -> DataFrame:
    """Sessions of a stream of arrivals u, ts: u, s_start, s_end, n_starts, closed by the watermark.

    Rows with a null are left out, and equal (u, ts) count once. A gap of exactly `gap` seconds doesn't
    end a session, as in the batch form. Arrivals more than `late` seconds behind the latest are dropped
    by the watermark: choose it above the feeds' delay (the default is two weeks), at the price of state
    kept so long; sessions() over the stored arrivals gives what came later still.
    """
    rows = arrivals.where("u IS NOT NULL AND ts IS NOT NULL").select("u", F.timestamp_seconds("ts").alias("at"), "ts")
    # session_window ends gap seconds after its last row and joins what starts at or before that end
    window = F.session_window("at", f"{gap} seconds").alias("w")
    rows = rows.withWatermark("at", f"{late} seconds").groupBy("u", window)
    return rows.agg(F.min("ts").alias("s_start"), F.max("ts").alias("s_end"), F.size(F.collect_set("ts")).cast("bigint").alias("n_starts")).drop("w")
