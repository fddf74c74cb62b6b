"""Generated visits and queries, by column expressions that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayspan.functions import power_law, uniform
from wayspan.operators.dag import clip_visits


def drawn_lengths(starts: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """starts with seconds, a visit length drawn for each key from the truncated power law."""
    return starts.withColumn("seconds", F.floor(power_law(uniform(F.col(key), seed))).cast("bigint"))


def visits_of_arrivals(arrivals: DataFrame, key: str = "rec_id", seed: int = 1) -> DataFrame:
    """u, v, ts, te of rows u, ts, v: ends are drawn, and clipped to the same visitor's next start. Nulls are left out."""
    rows = drawn_lengths(arrivals.select(key, "u", "v", "ts").dropna(), key, seed)
    return clip_visits(rows.select("u", "v", "ts", (F.col("ts") + F.col("seconds")).alias("te")))


def redrawn_ends(visits: DataFrame, key: str = "rec_id", seed: int = 2) -> DataFrame:
    """visits with all ends drawn again; key, u, v, ts, te, without rows that have a null."""
    rows = drawn_lengths(visits.select(key, "u", "v", "ts").dropna(), key, seed)
    return rows.select(key, "u", "v", "ts", (F.col("ts") + F.col("seconds")).alias("te"))


def drawn_queries(spark: SparkSession, n: int, n_upper: int, first: int, last: int, seed: int = 3) -> DataFrame:
    """qid, u, w, q_start, q_end: uniform visitors and uniform ordered windows in [first, last]."""
    rows = spark.range(n).withColumnRenamed("id", "qid")
    pick = lambda k, size: F.floor(uniform(F.col("qid") * 5 + k, seed) * F.lit(size)).cast("bigint")
    rows = rows.select("qid", pick(0, n_upper).alias("u"), pick(1, n_upper).alias("w"), (pick(2, last - first + 1) + first).alias("x"), (pick(3, last - first + 1) + first).alias("y"))
    return rows.select("qid", "u", "w", F.least("x", "y").alias("q_start"), F.greatest("x", "y").alias("q_end"))


def drawn_pairs(spark: SparkSession, n: int, size: int, seed: int = 4) -> DataFrame:
    """s, t of n drawn pairs of different vertices."""
    rows = spark.range(n)
    s = F.floor(uniform(F.col("id") * 2, seed) * F.lit(size)).cast("bigint")
    t = F.floor(uniform(F.col("id") * 2 + 1, seed) * F.lit(size - 1)).cast("bigint")
    return rows.select(s.alias("s"), F.when(t >= s, t + 1).otherwise(t).alias("t"))


def drawn_digraph(spark: SparkSession, n: int, n_edges: int, seed: int = 5) -> DataFrame:
    """a, b of distinct drawn edges a < b: an acyclic graph of at most n_edges edges."""
    pairs = drawn_pairs(spark, n_edges, n, seed)
    return pairs.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()
