"""Interval components and sessions within keys, of which a few hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from wayspan.operators.selection import bucket_of, key_splits
from wayspan.session import cut

#: Least rows of a bucket of a node, and buckets for each partition of a shuffle where their size is left open.
LEAST_BUCKET, BUCKETS = 256, 4


def interval_components(visits: DataFrame, rows_per_bucket: int | None = None) -> DataFrame:
    """Components of overlapping visits at every node: v, c_start, c_end, n (all BIGINT).

    Input: u, v, ts, te, of integer types; other columns are ignored. Rows with a null in one
    of the four, or te <= ts, don't count, and equal (u, v, ts, te) count once. In order of
    ts within v, a visit opens a component if ts is at or after the largest te so far, so
    touching visits part. n is the number of visits of the component. No rows, no components.

    Visits of one v and ts always share a component, so they are merged first, which bounds
    the rows of a node by the distinct instants. Nodes that still hold more than
    rows_per_bucket (left open: an even share of all rows, BUCKETS for each partition of a
    shuffle) are cut at exact quantiles of ts; each bucket is solved by itself, and at
    most two partial components a bucket are joined across its borders. There are at most
    rows / rows_per_bucket splits, which bounds what is broadcast by the partitions.
    """
    rows = visits.select(*[F.col(c).cast("bigint") for c in ("u", "v", "ts", "te")]).where("te > ts").dropna().distinct()
    rows = cut(rows.groupBy("v", "ts").agg(F.max("te").alias("te"), F.count("*").alias("n")))
    n = rows.count()
    size = rows_per_bucket or max(LEAST_BUCKET, -(-n // (BUCKETS * int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    splits = key_splits(rows, "v", "ts", size)
    hot = not splits.isEmpty()
    if hot:
        rows = rows.join(F.broadcast(splits), "v", "left").withColumn("bucket", F.coalesce(bucket_of("splits", "ts", n // size), F.lit(-1))).drop("splits")
    else:
        rows = rows.withColumn("bucket", F.lit(-1))
    before = W.partitionBy("v", "bucket").orderBy("ts").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("v", "bucket").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.max("te").over(before))
    rows = rows.withColumn("cid", F.sum(F.when(F.col("_end").isNull() | (F.col("ts") >= F.col("_end")), 1).otherwise(0)).over(upto))
    parts = rows.groupBy("v", "bucket", "cid").agg(F.min("ts").alias("c_start"), F.max("te").alias("c_end"), F.sum("n").alias("n"))
    if not hot:
        return parts.select("v", "c_start", "c_end", "n")
    parts = cut(parts)
    whole = parts.where("bucket = -1").select("v", "c_start", "c_end", "n")
    return whole.unionByName(_stitch(parts.where("bucket >= 0")))


def _stitch(parts: DataFrame) -> DataFrame:
    """Join partial components v, bucket, c_start, c_end, n over the borders of the buckets of each v.

    Only the buckets of a node, and two rows of each, meet in one task.
    """
    earlier = W.partitionBy("v").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = parts.groupBy("v", "bucket").agg(F.max("c_end").alias("_m")).select("v", "bucket", F.max("_m").over(earlier).alias("_carry"))
    parts = parts.join(carry, ["v", "bucket"]).withColumn("_opens", F.col("_carry").isNull() | (F.col("c_start") >= F.col("_carry")))
    last = parts.groupBy("v", "bucket").agg(F.max(F.when(F.col("_opens"), F.col("c_start"))).alias("_last"))
    parts = parts.join(last, ["v", "bucket"])
    inner = parts.where(F.col("_opens") & (F.col("c_start") < F.col("_last"))).select("v", "c_start", "c_end", "n")
    edge = parts.where(~F.col("_opens") | (F.col("c_start") == F.col("_last")))
    edge = edge.groupBy("v", "bucket", "_opens").agg(F.min("c_start").alias("c_start"), F.max("c_end").alias("c_end"), F.sum("n").alias("n"))
    order = W.partitionBy("v").orderBy("bucket", "_opens").rowsBetween(W.unboundedPreceding, 0)
    edge = edge.withColumn("_g", F.sum(F.col("_opens").cast("int")).over(order))
    joined = edge.groupBy("v", "_g").agg(F.min("c_start").alias("c_start"), F.max("c_end").alias("c_end"), F.sum("n").alias("n"))
    return inner.unionByName(joined.drop("_g"))


def sessions(arrivals: DataFrame, gap: int = 3600, width: int = 86_400, count_arrivals: bool = True) -> DataFrame:
    """Sessions of every visitor: u, s_start, s_end, duration, n_starts, n_arrivals (all BIGINT).

    Input: u, ts and v, of integer types; other columns are ignored. Rows with a null u or ts
    don't count. Equal (u, ts, v), null v included, are one arrival; n_arrivals counts those,
    n_starts the distinct ts; without count_arrivals v isn't read and n_arrivals is left out. A
    session ends where the next ts of its u is more than gap seconds later. duration is
    s_end - s_start. No rows, no sessions.

    Rows are put together once, by u and block of width seconds: at most width distinct instants
    meet there, whatever a visitor's share of all rows. Within it repeats go, a window flags gaps
    by lag and numbers sessions by the running sum of flags. Then the first and last session of
    each block are joined.
    """
    what = ["n_arrivals"] if count_arrivals else []
    rows = arrivals.select(F.col("u").cast("bigint"), F.col("ts").cast("bigint"), *[F.col("v") for _ in what]).where("u IS NOT NULL AND ts IS NOT NULL")
    place = ["u", "bucket"]
    rows = rows.withColumn("bucket", F.floor(F.col("ts") / F.lit(width)).cast("bigint")).repartition(*place)
    rows = rows.groupBy(*place, "ts", *["v" for _ in what]).agg(F.lit(1).alias("_one"))
    if what:
        rows = rows.groupBy(*place, "ts").agg(F.count("*").alias("n_arrivals"))
    within = W.partitionBy(*place).orderBy("ts")
    rows = rows.withColumn("_new", F.coalesce((F.col("ts") - F.lag("ts").over(within) > gap).cast("int"), F.lit(0)))
    rows = rows.withColumn("cid", F.sum("_new").over(within.rowsBetween(W.unboundedPreceding, 0)))
    parts = rows.groupBy(*place, "cid").agg(F.min("ts").alias("s_start"), F.max("ts").alias("s_end"), F.count("*").alias("n_starts"), *[F.sum(c).alias(c) for c in what])
    parts = cut(parts.withColumn("_last", F.max("cid").over(W.partitionBy(*place))))
    inner = parts.where("cid > 0 AND cid < _last")
    edge = parts.where("cid = 0 OR cid = _last")
    along = W.partitionBy("u").orderBy("s_start")
    edge = edge.withColumn("_new", F.coalesce((F.col("s_start") - F.lag("s_end").over(along) > gap).cast("int"), F.lit(1)))
    edge = edge.withColumn("_g", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    edge = edge.groupBy("u", "_g").agg(F.min("s_start").alias("s_start"), F.max("s_end").alias("s_end"), *[F.sum(c).alias(c) for c in ("n_starts", *what)])
    cols = ["u", "s_start", "s_end", "n_starts", *what]
    return inner.select(*cols).unionByName(edge.select(*cols)).select("u", "s_start", "s_end", (F.col("s_end") - F.col("s_start")).alias("duration"), "n_starts", *what)
