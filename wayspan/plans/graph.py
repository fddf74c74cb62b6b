"""Queries of the span-reachability operators over the tables visit and span_query, and their SQL."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayspan.operators import dag, reach
from wayspan.operators.blocks import with_rank
from wayspan.session import cut, stamp, table

DELTA = 86_400
FRAGMENTS = 8


class Index:
    """The tables that many queries share: built once for a session and folder, like an index. took has the seconds of each."""

    def __init__(self, spark: SparkSession, d: str):
        self.took: dict[str, float] = {}
        self.visits = self._built("visits", dag.clip_visits(table(spark, d, "visit")))
        meeting = self._built("components", lambda: dag.meeting_visits(self.visits)[0])
        self.slots = self._built("slots", dag.slots(meeting))
        self.moves = self._built("moves", dag.moves(dag.with_last_slot(meeting, self.slots)))
        self.edges = self._built("edges", dag.edges(self.slots, self.moves))
        self.meeting = self.moves.select("u", "v", "ts", "te", "c_start", "c_end", "last_start")

    def _built(self, name: str, rows) -> DataFrame:
        began = time.time()
        out = cut(rows() if callable(rows) else rows)
        self.took[name] = round(time.time() - began, 3)
        return out


def index(spark: SparkSession, d: str) -> Index:
    """The index of a folder; kept on the session, whose shared folder holds its tables, as long as the visits there are the same."""
    kept = spark.__dict__.setdefault("_wayspan_index", {})
    now = stamp(spark, f"{d}/visit.parquet")
    if d not in kept or kept[d][0] != now:
        kept[d] = now, Index(spark, d)
    return kept[d][1]


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "span_query")


def visits_clipped(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).visits


def contacts(spark: SparkSession, d: str) -> DataFrame:
    return dag.contacts(index(spark, d).visits)


def components(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).meeting.groupBy("v", "c_start", "c_end").agg(F.count("*").alias("n_visits"))


def slots(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).slots.select("v", "slot_start", "slot_end")


def dag_edges(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).edges


def dag_edges_delta_1d(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    return dag.edges(i.slots, i.moves, DELTA)


def dag_degree(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    return dag.degrees(i.slots, i.edges)


def dag_stats(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    degree = dag.degrees(i.slots, i.edges)
    nodes = degree.agg(
        F.count("*").alias("n_vertices"), F.sum("n_out").alias("n_edges"), F.count_if(F.col("n_in") == 0).alias("n_roots"), F.max("n_in").alias("most_in"), F.max("n_out").alias("most_out"), F.min("slot_start").alias("first_start"), F.max("slot_start").alias("last_start")
    )
    kinds = i.edges.agg(F.count_if(F.col("kind") == "chain").alias("n_chain"), F.count_if(F.col("kind") == "move").alias("n_move"))
    return nodes.join(F.broadcast(kinds), F.lit(True))  # one row each


def delta_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = dag.with_runs(index(spark, d).moves, DELTA)
    return rows.groupBy("u", "run").agg(F.count("*").alias("n_visits"), F.max("te").alias("run_end"))


def query_endpoints(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    return reach.endpoints(_queries(spark, d), i.meeting, i.slots).select("qid", "src_v", "src_start", "dst_v", "dst_start")


def _reach(spark: SparkSession, d: str, delta: int) -> DataFrame:
    i = index(spark, d)
    ends = reach.endpoints(_queries(spark, d), i.meeting, i.slots)
    return reach.reachable(_queries(spark, d), dag.with_runs(i.moves, delta), ends)


def span_reach(spark: SparkSession, d: str) -> DataFrame:
    return _reach(spark, d, dag.UNBOUNDED)


def span_reach_delta_1d(spark: SparkSession, d: str) -> DataFrame:
    return _reach(spark, d, DELTA)


def span_reach_delta_6h(spark: SparkSession, d: str) -> DataFrame:
    return _reach(spark, d, 21_600)


def reach_report(spark: SparkSession, d: str) -> DataFrame:
    """Answers of each window: how many queries, how many have both endpoints, how many are true."""
    i = index(spark, d)
    ends = cut(reach.endpoints(_queries(spark, d), i.meeting, i.slots))
    got = reach.reachable(_queries(spark, d), dag.with_runs(i.moves), ends)
    rows = got.join(ends.select("qid", F.lit(1).alias("_e")), "qid", "left")
    return rows.agg(F.count("*").alias("n_queries"), F.count("_e").alias("n_endpoints"), F.count_if("reachable").alias("n_true"))


def wedge_reach(spark: SparkSession, d: str) -> DataFrame:
    return reach.wedge_reachable(_queries(spark, d), index(spark, d).visits)


def _travel(spark: SparkSession, d: str) -> DataFrame:
    """The temporal graph of the moves: place to next place, leaving at the last slot, under way until the next visit."""
    rows = index(spark, d).moves.where("next_ts IS NOT NULL")
    return rows.select(F.col("v").alias("src"), F.col("next_v").alias("dst"), F.col("last_start").alias("depart"), F.col("gap").alias("duration")).distinct()


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """A source place for each query: where its u is found first in the window."""
    ask = reach.clean_queries(_queries(spark, d))
    return query_endpoints(spark, d).select("qid", F.col("src_v").alias("source")).join(ask.select("qid", F.col("q_start").alias("t_start"), F.col("q_end").alias("t_end")), "qid")


def earliest_arrival(spark: SparkSession, d: str) -> DataFrame:
    got = reach.earliest_arrival(_sources(spark, d), _travel(spark, d))
    return got.groupBy("qid").agg(F.count("*").alias("n_places"), F.sum("arrival").alias("sum_arrival"), F.max("arrival").alias("last_arrival"))


def windowed_reach(spark: SparkSession, d: str) -> DataFrame:
    """Whether the place where w is found last can be reached from that where u is found first, by moves within the window."""
    got = reach.earliest_arrival(_sources(spark, d), _travel(spark, d)).select("qid", F.col("vertex").alias("dst_v"), F.lit(True).alias("_yes"))
    return query_endpoints(spark, d).select("qid", "dst_v").join(got, ["qid", "dst_v"], "left").select("qid", F.coalesce("_yes", F.lit(False)).alias("reachable"))


def fastest(spark: SparkSession, d: str) -> DataFrame:
    """Fastest passages within each window."""
    got = reach.fastest(_sources(spark, d), _travel(spark, d))
    return got.groupBy("qid").agg(F.count("*").alias("n_places"), F.sum("seconds").alias("sum_seconds"), F.min("seconds").alias("least_seconds"))


QUERIES = {
    f.__name__: f
    for f in (
        visits_clipped, contacts, components, slots, dag_edges, dag_edges_delta_1d, dag_degree, dag_stats, delta_runs, query_endpoints,
        span_reach, span_reach_delta_1d, span_reach_delta_6h, reach_report, wedge_reach, earliest_arrival, windowed_reach, fastest,
    )
}

VISITS = """
    ok AS (SELECT DISTINCT u, v, ts, te FROM visit WHERE u IS NOT NULL AND v IS NOT NULL AND te > ts),
    nx AS (SELECT u, v, ts, te, lead(ts) OVER (PARTITION BY u ORDER BY ts, te, v) AS nts FROM ok),
    cv AS (SELECT u, v, ts, least(te, coalesce(nts, te)) AS te FROM nx WHERE nts IS NULL OR nts > ts)
"""
SLOTS = (
    VISITS
    + """,
    m AS (SELECT *, max(te) OVER (PARTITION BY v ORDER BY ts, te, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cv),
    k AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before THEN 1 ELSE 0 END) OVER (PARTITION BY v ORDER BY ts, te, u ROWS UNBOUNDED PRECEDING) AS cid FROM m),
    mv AS (SELECT u, v, ts, te, min(ts) OVER (PARTITION BY v, cid) AS c_start, max(te) OVER (PARTITION BY v, cid) AS c_end FROM k QUALIFY count(*) OVER (PARTITION BY v, cid) > 1),
    pt AS (SELECT DISTINCT v, c_start, c_end, t FROM (SELECT v, c_start, c_end, ts AS t FROM mv UNION ALL SELECT v, c_start, c_end, te FROM mv)),
    sl0 AS (SELECT v, c_start, c_end, t AS slot_start, lead(t) OVER (PARTITION BY v, c_start ORDER BY t) AS slot_end FROM pt),
    sl AS MATERIALIZED (SELECT * FROM sl0 WHERE slot_end IS NOT NULL),
    ls AS (SELECT mv.*, sl.slot_start AS last_start FROM mv JOIN sl ON sl.v = mv.v AND sl.slot_end = mv.te),
    mo AS MATERIALIZED (SELECT *, lead(ts) OVER w AS next_ts, lead(v) OVER w AS next_v, lead(c_start) OVER w AS next_c, lead(ts) OVER w - last_start AS gap FROM ls WINDOW w AS (PARTITION BY u ORDER BY ts))
"""
)


def edges_sql(delta: int = dag.UNBOUNDED) -> str:
    return (
        SLOTS
        + f""",
    ed AS MATERIALIZED (
        SELECT v AS src_v, slot_start AS src_start, v AS dst_v, slot_end AS dst_start, 'chain' AS kind FROM sl WHERE slot_end < c_end
        UNION ALL SELECT DISTINCT v, last_start, next_v, next_ts, 'move' FROM mo WHERE next_ts IS NOT NULL AND NOT (v = next_v AND c_start = next_c) AND gap <= {delta}
    )"""
    )


_ENDPOINTS = """,
    qs AS (SELECT DISTINCT qid, u, w, q_start, q_end FROM span_query WHERE qid IS NOT NULL AND u IS NOT NULL AND w IS NOT NULL AND q_start IS NOT NULL AND q_end IS NOT NULL AND q_start < q_end),
    sv AS (SELECT qid, mv.v, q_start, mv.ts, mv.te FROM qs JOIN mv ON mv.u = qs.u WHERE mv.te > q_start AND mv.ts < q_end QUALIFY row_number() OVER (PARTITION BY qid ORDER BY mv.ts) = 1),
    src AS (SELECT qid, sv.v AS src_v, min(slot_start) AS src_start FROM sv JOIN sl ON sl.v = sv.v AND slot_start >= ts AND slot_end <= te AND slot_end > q_start GROUP BY ALL),
    dv AS (SELECT qid, mv.v, q_end, mv.ts, mv.te FROM qs JOIN mv ON mv.u = qs.w WHERE mv.te > q_start AND mv.ts < q_end QUALIFY row_number() OVER (PARTITION BY qid ORDER BY mv.ts DESC) = 1),
    dst AS (SELECT qid, dv.v AS dst_v, max(slot_start) AS dst_start FROM dv JOIN sl ON sl.v = dv.v AND slot_start >= ts AND slot_end <= te AND slot_start < q_end GROUP BY ALL),
    ep AS MATERIALIZED (SELECT * FROM src JOIN dst USING (qid))
"""
#: Plain traversal of the slot graph, edge by edge: another algorithm than the fixpoint it checks.
_WALK = """,
    go AS (
        SELECT qid, src_v AS v, src_start AS t FROM ep WHERE src_start <= dst_start
        UNION
        SELECT go.qid, ed.dst_v, ed.dst_start FROM go JOIN ed ON ed.src_v = go.v AND ed.src_start = go.t JOIN ep ON ep.qid = go.qid WHERE ed.dst_start <= ep.dst_start
    ),
    yes AS (SELECT DISTINCT qid FROM go JOIN ep USING (qid) WHERE go.v = ep.dst_v AND go.t = ep.dst_start)
"""
_ANSWER = "SELECT qid, qid IN (SELECT qid FROM yes) AS reachable FROM (SELECT DISTINCT qid FROM span_query)"
_TRAVEL = """,
    tr AS MATERIALIZED (SELECT DISTINCT v AS src, next_v AS dst, last_start AS depart, gap AS duration FROM mo WHERE next_ts IS NOT NULL),
    so AS (SELECT qid, src_v AS source, q_start AS t_start, q_end AS t_end FROM ep JOIN qs USING (qid)),
    ea AS (
        SELECT qid, source AS vertex, t_start AS arrival, t_end FROM so
        UNION
        SELECT qid, dst, depart + duration, t_end FROM ea JOIN tr ON src = vertex WHERE depart >= arrival AND depart + duration <= t_end
    ),
    er AS (SELECT qid, vertex, min(arrival) AS arrival FROM ea GROUP BY ALL)
"""
SQL = {
    "visits_clipped": f"WITH {VISITS} SELECT u, v, ts, te FROM cv",
    "contacts": f"""WITH {VISITS} SELECT x.v, x.u AS a, x.ts AS a_ts, y.u AS b, y.ts AS b_ts, greatest(x.ts, y.ts) AS o_start, least(x.te, y.te) AS o_end
        FROM cv x JOIN cv y ON x.v = y.v AND x.u < y.u AND x.ts < y.te AND y.ts < x.te""",
    "components": f"WITH {SLOTS} SELECT v, c_start, c_end, count(*) AS n_visits FROM mv GROUP BY ALL",
    "slots": f"WITH {SLOTS} SELECT v, slot_start, slot_end FROM sl",
    "dag_edges": f"WITH {edges_sql()} SELECT * FROM ed",
    "dag_edges_delta_1d": f"WITH {edges_sql(DELTA)} SELECT * FROM ed",
    "dag_degree": f"""WITH {edges_sql()} SELECT v, slot_start, (SELECT count(*) FROM ed WHERE dst_v = v AND dst_start = slot_start) AS n_in, (SELECT count(*) FROM ed WHERE src_v = v AND src_start = slot_start) AS n_out FROM sl""",
    "dag_stats": f"""WITH {edges_sql()}, dg AS (SELECT v, slot_start, (SELECT count(*) FROM ed WHERE dst_v = v AND dst_start = slot_start) AS n_in, (SELECT count(*) FROM ed WHERE src_v = v AND src_start = slot_start) AS n_out FROM sl)
        SELECT count(*) AS n_vertices, CAST(sum(n_out) AS BIGINT) AS n_edges, count(*) FILTER (n_in = 0) AS n_roots, max(n_in) AS most_in, max(n_out) AS most_out, min(slot_start) AS first_start, max(slot_start) AS last_start,
            (SELECT count(*) FROM ed WHERE kind = 'chain') AS n_chain, (SELECT count(*) FROM ed WHERE kind = 'move') AS n_move FROM dg""",
    "delta_runs": f"""WITH {SLOTS},
        br AS (SELECT *, lag(gap) OVER w AS g, lag(v) OVER w = v AND lag(c_start) OVER w = c_start AS same FROM mo WINDOW w AS (PARTITION BY u ORDER BY ts)),
        rn AS (SELECT *, max(CASE WHEN g IS NULL OR (g > {DELTA} AND NOT same) THEN ts END) OVER (PARTITION BY u ORDER BY ts) AS run FROM br)
        SELECT u, run, count(*) AS n_visits, max(te) AS run_end FROM rn GROUP BY u, run""",
    "query_endpoints": f"WITH {SLOTS} {_ENDPOINTS} SELECT qid, src_v, src_start, dst_v, dst_start FROM ep",
    "span_reach": f"WITH RECURSIVE {edges_sql()} {_ENDPOINTS} {_WALK} {_ANSWER}",
    "span_reach_delta_1d": f"WITH RECURSIVE {edges_sql(DELTA)} {_ENDPOINTS} {_WALK} {_ANSWER}",
    "span_reach_delta_6h": f"WITH RECURSIVE {edges_sql(21_600)} {_ENDPOINTS} {_WALK} {_ANSWER}",
    "reach_report": f"WITH RECURSIVE {edges_sql()} {_ENDPOINTS} {_WALK} SELECT count(DISTINCT qid) AS n_queries, (SELECT count(*) FROM ep) AS n_endpoints, (SELECT count(*) FROM yes) AS n_true FROM span_query",
    "wedge_reach": f"""WITH RECURSIVE {VISITS},
        qa AS (SELECT DISTINCT qid, u, w, q_start, q_end FROM span_query WHERE u IS NOT NULL AND w IS NOT NULL AND q_start IS NOT NULL AND q_end IS NOT NULL AND q_start <= q_end),
        pr AS MATERIALIZED (SELECT x.u AS a, x.ts AS a_ts, x.te AS a_te, y.u AS b, y.te AS b_te FROM cv x JOIN cv y ON x.v = y.v AND x.u <> y.u AND x.ts < y.te AND y.ts < x.te),
        wd AS (
            SELECT qid, b AS who, b_te AS ready, q_end FROM qa JOIN pr ON pr.a = qa.u WHERE a_te > q_start AND a_ts < q_end AND b_te <= q_end
            UNION SELECT qid, b, b_te, q_end FROM wd JOIN pr ON pr.a = wd.who WHERE a_ts >= ready AND b_te <= q_end
        ),
        yes AS (SELECT qid FROM wd JOIN qa USING (qid) WHERE who = w UNION SELECT qid FROM qa WHERE u = w) {_ANSWER}""",
    "earliest_arrival": f"WITH RECURSIVE {SLOTS} {_ENDPOINTS} {_TRAVEL} SELECT qid, count(*) AS n_places, CAST(sum(arrival) AS BIGINT) AS sum_arrival, max(arrival) AS last_arrival FROM er GROUP BY qid",
    "windowed_reach": f"WITH RECURSIVE {SLOTS} {_ENDPOINTS} {_TRAVEL} SELECT ep.qid, count(er.qid) > 0 AS reachable FROM ep LEFT JOIN er ON er.qid = ep.qid AND er.vertex = ep.dst_v GROUP BY ep.qid",
    "fastest": f"""WITH RECURSIVE {SLOTS} {_ENDPOINTS},
        tr AS MATERIALIZED (SELECT DISTINCT v AS src, next_v AS dst, last_start AS depart, gap AS duration FROM mo WHERE next_ts IS NOT NULL),
        so AS (SELECT qid, src_v AS source, q_start AS t_start, q_end AS t_end FROM ep JOIN qs USING (qid)),
        fa AS (
            SELECT DISTINCT qid, source, depart AS leave, source AS vertex, depart AS arrival, t_end FROM so JOIN tr ON src = source WHERE depart BETWEEN t_start AND t_end
            UNION SELECT qid, source, leave, dst, depart + duration, t_end FROM fa JOIN tr ON src = vertex WHERE depart >= arrival AND depart + duration <= t_end
        ),
        fr AS (SELECT qid, vertex, min(arrival - leave) AS seconds FROM fa WHERE vertex <> source GROUP BY ALL)
        SELECT qid, count(*) AS n_places, CAST(sum(seconds) AS BIGINT) AS sum_seconds, min(seconds) AS least_seconds FROM fr GROUP BY qid""",
}
