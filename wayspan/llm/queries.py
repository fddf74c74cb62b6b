"""Queries of the problems on items and texts (3, 5, 6, 7, 8), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayspan.llm.frequent import shared_values, top_values
from wayspan.llm.packing import containers, page_keys
from wayspan.llm.pairs import cooccurrence
from wayspan.llm.sentences import sentence_ends
from wayspan.llm.tokens import token_ids, token_texts
from wayspan.session import cut, table

TOP = 100


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "arrival").select("u", F.floor(F.col("ts") / F.lit(86_400)).cast("bigint").alias("day"), "v")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccurrence(_baskets(spark, d), ["u", "day"], "v", min_together=6, min_lift=8)
    return pairs.select(F.col("a").alias("v_a"), F.col("b").alias("v_b"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccurrence(_baskets(spark, d), ["u", "day"], "v")
    return pairs.select(F.col("a").alias("v_a"), F.col("b").alias("v_b"), "n_ab", "n_a", "n_b", "lift", F.round("pmi", 6).alias("pmi"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_values(table(spark, d, "arrival"), "v", 2).select(F.col("x").alias("v"))


def p5_top(spark: SparkSession, d: str) -> DataFrame:
    return top_values(table(spark, d, "arrival"), "v", TOP).select(F.col("x").alias("v"), F.col("n").alias("n_rows"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"))


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    """The round trip: every text from its token ids."""
    return token_texts(token_ids(table(spark, d, "documents")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return containers(table(spark, d, "documents"), table(spark, d, "container_kind"))


def p7_placed(spark: SparkSession, d: str) -> DataFrame:
    """The pages that have a first piece in some container of each kind."""
    return p7_containers(spark, d).where("piece = 0").select("kind_id", "doc_id")


def p7_violations(spark: SparkSession, d: str) -> DataFrame:
    """What must not be, as kind_id and what: containers above their capacity, pages of which a token is
    missing or doubled, pieces of pages that would fit whole, and pieces that leave room but aren't the last."""
    kinds = table(spark, d, "container_kind").select("kind_id", "capacity")
    got = cut(p7_containers(spark, d)).join(F.broadcast(kinds), "kind_id")  # a fixed table
    over = got.groupBy("kind_id", "capacity", "container").agg(F.sum("n_tokens").alias("n")).where("n > capacity").select("kind_id", F.lit("capacity").alias("what"))
    pages = got.groupBy("kind_id", "capacity", "doc_id").agg(F.sum("n_tokens").alias("held"), F.count("*").alias("n_pieces"), F.countDistinct("first_token").alias("n_firsts"), F.max(F.col("first_token") + F.col("n_tokens")).alias("upto"))
    want = page_keys(table(spark, d, "documents")).select("doc_id", F.col("n_tokens").alias("n"))
    pages = cut(pages.join(want, "doc_id", "full").where("held IS NULL OR n IS NULL OR held <> n OR upto <> n OR n_firsts <> n_pieces OR n_pieces > greatest(1, ceil(n / capacity))"))
    missed = pages.where("held IS NULL OR n IS NULL OR held <> n OR upto <> n OR n_firsts <> n_pieces").select("kind_id", F.lit("page").alias("what"))
    torn = pages.where("n_pieces > greatest(1, ceil(n / capacity))").select("kind_id", F.lit("cut").alias("what"))
    return over.unionByName(missed).unionByName(torn)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each kind are, against the least number that could hold the tokens."""
    kinds = table(spark, d, "container_kind").select("kind_id", "capacity")
    used = p7_containers(spark, d).groupBy("kind_id").agg(F.countDistinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    least = F.ceil(F.col("n_tokens") / F.col("capacity"))
    return used.join(kinds, "kind_id").select("kind_id", "n_containers", "n_tokens", least.alias("least_containers"), (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("fill"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentence_ends(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_pairs, p5_found, p5_top, p6_ids, p6_texts, p7_containers, p7_placed, p7_violations, p7_fill, p8_found)}

_PAIRS = """
    WITH b AS (SELECT DISTINCT u, ts // 86400 AS day, v FROM arrival WHERE u IS NOT NULL AND ts IS NOT NULL AND v IS NOT NULL),
    t AS (SELECT count(*) AS n FROM (SELECT DISTINCT u, day FROM b)),
    s AS (SELECT v, count(*) AS n FROM b GROUP BY v),
    p AS (SELECT x.v AS v_a, y.v AS v_b, count(*) AS n_ab FROM b x JOIN b y ON x.u = y.u AND x.day = y.day AND x.v < y.v GROUP BY ALL),
    r AS (SELECT v_a, v_b, n_ab, a.n AS n_a, b.n AS n_b, t.n AS n FROM p JOIN s a ON a.v = v_a JOIN s b ON b.v = v_b CROSS JOIN t)
"""
SQL = {
    "p3_found": _PAIRS + "SELECT v_a, v_b FROM r WHERE n_ab >= 6 AND n_ab * n >= 8 * n_a * n_b",
    "p3_pairs": _PAIRS + "SELECT v_a, v_b, n_ab, n_a, n_b, CAST(n_ab * n AS DOUBLE) / CAST(n_a * n_b AS DOUBLE) AS lift, round(log2(CAST(n_ab * n AS DOUBLE) / CAST(n_a * n_b AS DOUBLE)), 6) AS pmi FROM r",
    "p5_found": "SELECT v FROM arrival WHERE v IS NOT NULL GROUP BY v HAVING 1000 * count(*) >= 2 * (SELECT count(v) FROM arrival)",
    "p5_top": f"SELECT v, count(*) AS n_rows FROM arrival WHERE v IS NOT NULL GROUP BY v ORDER BY n_rows DESC, v LIMIT {TOP}",
    "p7_placed": "SELECT kind_id, doc_id FROM documents, container_kind",
    "p7_violations": "SELECT kind_id, '' AS what FROM container_kind WHERE capacity < 0",
    "p6_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
