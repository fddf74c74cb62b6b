"""Queries of the general problems (1, 2, 4) over the tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayspan.operators.components import interval_components, sessions
from wayspan.operators.selection import key_quantiles
from wayspan.session import cut, table
from wayspan.sources.rejects import TIME_HIGH, TIME_LOW, parse_lines

SESSION_GAP = 3600
QUANTILES = {"p25": 0.25, "p50": 0.5, "p90": 0.9, "p99": 0.99}


def _visits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "visit").select("u", "v", "ts", "te")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return interval_components(_visits(spark, d)).where("n >= 2").select("v", "c_start", "c_end")


def p1_components(spark: SparkSession, d: str) -> DataFrame:
    return interval_components(_visits(spark, d))


def p1_quantiles(spark: SparkSession, d: str) -> DataFrame:
    visits = cut(_visits(spark, d).where("te > ts").dropna().distinct())
    return key_quantiles(visits.select("v", (F.col("te") - F.col("ts")).alias("seconds")), "v", "seconds", QUANTILES)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines(table(spark, d, "raw_visit"), table(spark, d, "feed"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).where("reason IS NOT NULL").select("line_id", "reason")


def p2_visits(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).where("reason IS NULL").select(F.col("line_id").alias("rec_id"), "u", "v", "ts", "te", "note")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "arrival"), SESSION_GAP, count_arrivals=False).where("n_starts >= 3").select("u", "s_start", "s_end")


def p4_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "arrival").select("u", "ts", "v"), SESSION_GAP)


QUERIES = {f.__name__: f for f in (p1_found, p1_components, p1_quantiles, p2_found, p2_visits, p4_found, p4_sessions)}

_COMPONENTS = """
    WITH d AS (SELECT DISTINCT u, v, ts, te FROM visit WHERE u IS NOT NULL AND v IS NOT NULL AND te > ts),
    m AS (SELECT *, max(te) OVER (PARTITION BY v ORDER BY ts, te, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d),
    k AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before THEN 1 ELSE 0 END) OVER (PARTITION BY v ORDER BY ts, te, u ROWS UNBOUNDED PRECEDING) AS g FROM m),
    c AS (SELECT v, min(ts) AS c_start, max(te) AS c_end, count(*) AS n FROM k GROUP BY v, g)
"""
_SESSIONS = f"""
    WITH a AS (SELECT DISTINCT u, ts, v FROM arrival WHERE u IS NOT NULL AND ts IS NOT NULL),
    d AS (SELECT u, ts, count(*) AS n FROM a GROUP BY u, ts),
    f AS (SELECT *, ts - lag(ts) OVER (PARTITION BY u ORDER BY ts) > {SESSION_GAP} AS opens FROM d),
    g AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY ts) AS k FROM f),
    s AS (SELECT u, min(ts) AS s_start, max(ts) AS s_end, max(ts) - min(ts) AS duration, count(*) AS n_starts, CAST(sum(n) AS BIGINT) AS n_arrivals FROM g GROUP BY u, k)
"""
_LINES = f"""
    WITH r AS (
        SELECT line_id, CASE WHEN raw LIKE '%' || chr(13) THEN left(raw, len(raw) - 1) ELSE raw END AS rec, n_cols, n_upper, n_lower, sep,
            regexp_escape(sep) AS s, CASE WHEN sep = ' ' THEN '' ELSE ' *' END AS b
        FROM raw_visit LEFT JOIN feed USING (feed_id) WHERE line_no > 1
    ),
    p AS (SELECT *, b || '(?:"(?:[^"]|"")*"' || b || '|[^"' || s || ']*)' AS field FROM r),
    q AS (SELECT *, regexp_full_match(rec, field || '(?:' || s || field || ')*') AS sound, regexp_full_match(rec, field || '(?:' || s || field || '){{' || (n_cols - 1) || '}}') AS shaped FROM p),
    f AS (
        SELECT *, CASE WHEN shaped THEN list_transform(regexp_extract_all(rec || sep, '(' || field || ')' || s, 1), lambda x:
            CASE WHEN contains(x, '"') THEN replace(regexp_extract(x, '^ *"((?:[^"]|"")*)" *$', 1), '""', '"') ELSE trim(x, ' ') END) END AS f FROM q
    ),
    n AS (SELECT *, list_transform(f[:4], lambda x: CASE WHEN regexp_full_match(x, '[0-9]{{1,18}}') THEN CAST(x AS BIGINT) END) AS n FROM f),
    t AS (
        SELECT line_id, n, f, CASE
            WHEN rec IS NULL OR sep IS NULL OR n_cols IS NULL OR n_upper IS NULL OR n_lower IS NULL THEN 'columns'
            WHEN NOT sound THEN 'quoting'
            WHEN NOT shaped THEN 'columns'
            WHEN n[1] IS NULL OR n[1] >= n_upper THEN 'upper'
            WHEN n[2] IS NULL OR n[2] >= n_lower THEN 'node'
            WHEN n[3] IS NULL OR n[3] NOT BETWEEN {TIME_LOW} AND {TIME_HIGH - 1} THEN 'start'
            WHEN n[4] IS NULL OR n[4] NOT BETWEEN {TIME_LOW} AND {TIME_HIGH - 1} OR n[4] <= n[3] THEN 'end' END AS reason
        FROM n
    )
"""
_AT = ", ".join(f"max(x) FILTER (i = {round(q * 10_000)} * (n - 1) // 10000) AS {c}" for c, q in QUANTILES.items())

SQL = {
    "p1_found": _COMPONENTS + "SELECT v, c_start, c_end FROM c WHERE n >= 2",
    "p1_components": _COMPONENTS + "SELECT v, c_start, c_end, n FROM c",
    "p1_quantiles": f"""
        WITH d AS (SELECT DISTINCT u, v, ts, te FROM visit WHERE u IS NOT NULL AND v IS NOT NULL AND te > ts),
        r AS (SELECT v, te - ts AS x, row_number() OVER (PARTITION BY v ORDER BY te - ts) - 1 AS i, count(*) OVER (PARTITION BY v) AS n FROM d)
        SELECT v, n, {_AT} FROM r GROUP BY v, n
    """,
    "p2_found": _LINES + "SELECT line_id, reason FROM t WHERE reason IS NOT NULL",
    "p2_visits": _LINES + "SELECT line_id AS rec_id, n[1] AS u, n[2] AS v, n[3] AS ts, n[4] AS te, nullif(f[5], '') AS note FROM t WHERE reason IS NULL",
    "p4_found": _SESSIONS + "SELECT u, s_start, s_end FROM s WHERE n_starts >= 3",
    "p4_sessions": _SESSIONS + "SELECT * FROM s",
}
