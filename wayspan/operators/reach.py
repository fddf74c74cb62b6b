"""Batched reachability, earliest arrival and fastest passage over visits.

All queries of a table are answered together, as rows keyed by qid. Each round is two grouped
minima over equi-joins and keeps only rows that improved; state is cut into the shared folder,
so a lost executor costs at most a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wayspan.operators.blocks import as_of, by_cells
from wayspan.operators.sweep import passages, swept, wedges
from wayspan.session import cut, small

DAY = 86_400
#: Rounds after which a fixpoint is taken to be broken; each round is a change of place, of which a path has few.
MOST_ROUNDS = 500
#: Queries of a block that one task answers.
PASSAGE_LANES, WEDGE_LANES = 512, 1_024


def _sized(df: DataFrame) -> tuple[DataFrame, int]:
    """df cut, and its rows, which are counted from the files' footers."""
    df = cut(df)
    return df, df.count()


def clean_queries(queries: DataFrame) -> DataFrame:
    """Distinct queries that can be true: no null, q_start <= q_end."""
    rows = queries.select(*[F.col(c).cast("bigint") for c in ("qid", "u", "w", "q_start", "q_end")]).dropna().where("q_start <= q_end")
    return rows.distinct()


def endpoints(queries: DataFrame, meeting: DataFrame, slot: DataFrame) -> DataFrame:
    """Source and target slot of each query: qid, src_v, src_c, src_start, dst_v, dst_c, dst_start.

    Source: in the first visit of u that ends after q_start and starts before q_end, the earliest
    slot that ends after q_start. Target: in the last such visit of w, the latest slot that starts
    before q_end. Queries without one of both have no row; qid must be unique in queries. Visits of
    a visitor don't overlap, so each is an as-of look-up by an end or a start, and so is the slot:
    a window may reach as far as it likes.
    """
    ask = cut(clean_queries(queries).where("q_start < q_end"))
    seen = meeting.select("u", "ts", "te", "v", "c_start")
    sides = []
    for side, who in (("src", "u"), ("dst", "w")):
        rows = ask.select("qid", F.col(who).alias("u"), "q_start", "q_end", (F.col("q_start") + 1).alias("_from"), (F.col("q_end") - 1).alias("_to"))
        if side == "src":
            rows = as_of(rows, seen, ["u"], "_from", "te", "te", forward=True).join(seen, ["u", "te"])
        else:
            rows = as_of(rows, seen, ["u"], "_to", "ts", "ts").join(seen, ["u", "ts"])
        at = F.greatest("ts", "q_start") if side == "src" else F.least(F.col("te"), F.col("q_end")) - 1
        sides.append(rows.where("te > q_start AND ts < q_end").select("qid", F.lit(side).alias("side"), "v", "c_start", at.alias("at")))
    both = as_of(cut(sides[0].unionByName(sides[1])), slot, ["v"], "at", "slot_start", "slot_start")
    names = {"v": "v", "c_start": "c", "slot_start": "start"}
    found = [both.where(F.col("side") == side).select("qid", *[F.col(c).alias(f"{side}_{n}") for c, n in names.items()]) for side in ("src", "dst")]
    return found[0].join(found[1], "qid")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _news(made: DataFrame, parts: list[DataFrame], keys: list[str], value: str, least: bool = True) -> tuple[DataFrame, int]:
    """Rows of made that no part has as good a value for, cut, and their number. Parts may hold values that later ones have bettered."""
    if parts:
        had = _union(parts).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("_had"))
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(k) == F.col(f"_{k}"))
        made = made.join(had, same & ((F.col("_had") <= F.col(value)) if least else (F.col("_had") >= F.col(value))), "left_anti")
    return _sized(made)


def spread(seeds: DataFrame, visits: DataFrame, bound: DataFrame | None = None, goals: DataFrame | None = None) -> DataFrame:
    """Least slot start at which each qid enters each component it can reach: qid, v, c_start, at.

    seeds: qid, v, c_start, at. visits: u, run, v, c_start, ts, last_start. bound: qid, until; what
    starts after it is left out. From a component entered at `at`, every visit whose last slot
    starts at or after it leads to the later visits of its run. With goals (qid, v, c_start,
    dst_start) the result is the qids that enter their goal by dst_start, and such go no further.
    A round writes only what is new; what was known is looked up, never written again.
    """
    component, stretch = ["qid", "v", "c_start"], ["qid", "u", "run"]
    rows = cut(visits.select("u", "run", "v", "c_start", "ts", "last_start"))
    fresh, n = _sized(seeds.groupBy(*component).agg(F.min("at").alias("at")))
    entered, taken, hits = [fresh], [], [fresh.select("qid").limit(0)]
    until = lambda df: df if bound is None else df.join(bound, "qid").where("ts <= until").drop("until")
    for _ in range(MOST_ROUNDS):
        if n and goals is not None:
            hit, n_hit = _sized(fresh.join(goals, component).where("at <= dst_start").select("qid").distinct())
            if n_hit:
                hits.append(hit)
                fresh, n = _sized(fresh.join(small(hit), "qid", "left_anti"))
        if n:
            caught = until(fresh.join(rows, ["v", "c_start"]).where("last_start >= at")).groupBy(*stretch).agg(F.min("ts").alias("ts0"))
            better, n = _news(caught, taken, stretch, "ts0")
        if n:
            taken.append(better)
            went = until(better.join(rows, ["u", "run"]).where("ts > ts0")).groupBy(*component).agg(F.min("ts").alias("at"))
            fresh, n = _news(went, entered, component, "at")
            entered.append(fresh)
        if not n:
            return _union(hits) if goals is not None else _union(entered).groupBy(*component).agg(F.min("at").alias("at"))
    raise RuntimeError("no fixpoint was reached")


def reachable(queries: DataFrame, visits: DataFrame, ends: DataFrame) -> DataFrame:
    """qid and reachable of every distinct qid of queries, false where a query has no endpoints.

    A query with a null or a reversed window is false. visits as for spread, with runs for the
    latency; ends as endpoints() gives them.
    """
    ends = cut(ends)
    seeds = ends.select("qid", F.col("src_v").alias("v"), F.col("src_c").alias("c_start"), F.col("src_start").alias("at"), F.col("dst_start").alias("until"))
    goal = ends.select("qid", F.col("dst_v").alias("v"), F.col("dst_c").alias("c_start"), "dst_start")
    yes = spread(seeds.where("at <= until").drop("until"), visits, ends.select("qid", F.col("dst_start").alias("until")), goal)
    asked = queries.select(F.col("qid").cast("bigint")).distinct()
    return asked.join(yes.withColumn("_yes", F.lit(True)), "qid", "left").select("qid", F.coalesce("_yes", F.lit(False)).alias("reachable"))


def _improve(state: DataFrame, step, keys: list[str], value: str, least: bool = True) -> DataFrame:
    """Label correcting: state and what step() makes of its last improvements, until none is left.

    The better value is the least, or else the greatest.
    """
    agg = F.min if least else F.max
    fresh, n = _sized(state.groupBy(*keys).agg(agg(value).alias(value)))
    parts = [fresh]
    for _ in range(MOST_ROUNDS):
        if n:
            fresh, n = _news(step(fresh).groupBy(*keys).agg(agg(value).alias(value)), parts, keys, value, least)
            parts.append(fresh)
        if not n:
            return _union(parts).groupBy(*keys).agg(agg(value).alias(value))
    raise RuntimeError("no fixpoint was reached")


class _Timetable:
    """Edges of a temporal graph by their source and cell of departure.

    From an arrival, the edges of its own cell are looked at one by one, while of each later cell
    the least arrival at each target is enough. So a busy source is spread over its cells, and a
    label meets each target once a cell.
    """

    def __init__(self, edges: DataFrame, width: int = 10_800):
        self.width = width
        edge = edges.select("src", "dst", "depart", "duration").dropna().where("duration >= 0")
        edge = edge.select("src", "dst", "depart", (F.col("depart") + F.col("duration")).alias("_then"), F.floor(F.col("depart") / F.lit(width)).cast("bigint").alias("_cell"))
        self.edge = cut(edge.groupBy("src", "_cell", "dst", "depart").agg(F.min("_then").alias("_then")))
        self._whole = cut(self.edge.groupBy("src", "_cell", "dst").agg(F.min("_then").alias("_then")))
        self.first, self.last = (x or 0 for x in self.edge.agg(F.min("depart"), F.max("depart")).first())

    def onward(self, labels: DataFrame) -> DataFrame:
        """labels (vertex, arrival, t_end and others) moved over each edge that departs at or after arrival and arrives by t_end."""
        end = F.least(F.col("t_end"), F.lit(self.last))
        here = F.floor(F.greatest("arrival", F.lit(self.first)) / F.lit(self.width)).cast("bigint")
        labels = labels.withColumnRenamed("vertex", "src")
        near = labels.withColumn("_cell", here).join(self.edge, ["src", "_cell"]).where("depart >= arrival")
        cells = F.sequence(here + 1, F.floor(end / F.lit(self.width)).cast("bigint"))
        far = labels.where(F.floor(end / F.lit(self.width)) > here).withColumn("_cell", F.explode(cells)).join(self._whole, ["src", "_cell"])
        others = [c for c in labels.columns if c not in ("src", "arrival")]
        moved = lambda x: x.where("_then <= t_end").select(*others, F.col("dst").alias("vertex"), F.col("_then").alias("arrival"))
        return moved(near).unionByName(moved(far))


def _asked(sources: DataFrame) -> DataFrame:
    return cut(sources.select("qid", "source", "t_start", "t_end").dropna().where("t_start <= t_end").distinct())


def earliest_arrival(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """Least arrival of each query at each vertex of a temporal graph: qid, vertex, arrival.

    sources: qid, source, t_start, t_end. edges: src, dst, depart, duration. An edge is taken if it
    departs at or after the arrival at its source, and arrives by t_end. The source arrives at t_start.
    Rows with nulls are left out; negative durations are errors of the data and left out too.
    """
    times, ask = _Timetable(edges), _asked(sources)
    until = ask.select("qid", "t_end")
    start = ask.select("qid", F.col("source").alias("vertex"), F.col("t_start").alias("arrival"))
    return _improve(start, lambda fresh: times.onward(fresh.join(until, "qid")).drop("t_end"), ["qid", "vertex"], "arrival")


def latest_departure(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """The latest time at which each query can still be at each vertex and reach its target by t_end: qid, vertex, departure.

    targets: qid, target, t_start, t_end. The backward form of earliest_arrival: an edge is taken if it
    arrives at or before the departure at its end, and departs at or after t_start. The target has t_end.
    """
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (-(F.col("depart") + F.col("duration"))).alias("depart"), "duration")
    ask = targets.select("qid", F.col("target").alias("source"), (-F.col("t_end")).alias("t_start"), (-F.col("t_start")).alias("t_end"))
    return earliest_arrival(ask, back).select("qid", "vertex", (-F.col("arrival")).alias("departure"))


def first_departures(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """qid, first_departure, last_arrival: the first edge that leaves each query's source in [t_start, t_end], and the last that arrives at it there.

    sources: qid, source, t_start, t_end. Each is an as-of look-up. Queries without both have no row.
    """
    edge = edges.select("src", "dst", "depart", (F.col("depart") + F.col("duration")).alias("arrive")).dropna()
    ask = _asked(sources)
    out = as_of(ask, edge.select(F.col("src").alias("source"), "depart").distinct(), ["source"], "t_start", "depart", "first_departure", forward=True)
    out = as_of(out, edge.select(F.col("dst").alias("source"), "arrive").distinct(), ["source"], "t_end", "arrive", "last_arrival")
    inside = lambda c: F.when(F.col(c).between(F.col("t_start"), F.col("t_end")), F.col(c)).alias(c)
    return out.select("qid", inside("first_departure"), inside("last_arrival")).where("first_departure IS NOT NULL OR last_arrival IS NOT NULL")


def fastest(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """Least time of passage of each query to each other vertex it reaches: qid, vertex, seconds.

    A passage leaves with an edge of the source that departs in [t_start, t_end], and arrives by
    t_end; the least arrival - departure counts. Labels are pairs of departure and arrival; of those
    at one vertex only such are kept as no other leaves later and arrives no later. Labels that come
    back to the source are dropped, since leaving it anew is no slower. Input as for earliest_arrival.
    """
    edge = edges.select("src", "dst", F.col("depart").alias("t"), "duration").dropna().where("duration >= 0")
    edge = edge.groupBy(F.col("src").alias("a"), F.col("dst").alias("b"), "t").agg((F.col("t") + F.min("duration")).alias("till"))
    lanes = _asked(sources).select("qid", F.col("source").alias("who"), F.col("source").alias("goal"), F.col("t_start").alias("start"), F.col("t_start").alias("low"), F.col("t_end").alias("until"))
    got = swept(*[df.select(*[F.col(c).cast("bigint") for c in df.columns]) for df in (lanes, cut(edge))], passages, "qid bigint, vertex bigint, seconds bigint", PASSAGE_LANES)
    return got.groupBy("qid", "vertex").agg(F.min("seconds").alias("seconds"))


def wedge_reachable(queries: DataFrame, visits: DataFrame, width: int = DAY) -> DataFrame:
    """qid and reachable by the stricter meaning: who receives can pass on only in later visits.

    visits: u, v, ts, te, clipped. A carrier passes to a receiver whose visit overlaps its own and
    ends by q_end; the receiver is ready at that end and passes on in visits that start at or after it. The
    source may use a visit in progress at q_start, if it ends after it. u = w is true where the window
    isn't reversed; nulls and unknown ids are false.

    No pairs of visits are made: visits are taken once in order of time, for a block of queries at a time
    (sweep.wedges). What ends after the last visit of w that ends by q_end is of no use, and a query without
    one that ends after the source's first start is not followed. width: seconds of the cells by which visits find
    their blocks.
    """
    ask = cut(clean_queries(queries))
    seen = visits.select("u", "ts", "te")
    low = as_of(ask.where("q_start < q_end").select("qid", "u", "q_start", "q_end", (F.col("q_start") + 1).alias("_from")), seen, ["u"], "_from", "te", "te", forward=True)
    low = low.join(seen, ["u", "te"]).where("ts < q_end").select("qid", "u", "q_start", "q_end", F.col("ts").alias("low"))
    last = as_of(ask.select("qid", F.col("w").alias("u"), "q_start", "q_end"), seen, ["u"], "q_end", "te", "until").withColumnRenamed("u", "goal")
    lanes = low.join(last, ["qid", "q_start", "q_end"]).where("until > low")
    lanes = lanes.select("qid", F.col("u").alias("who"), "goal", F.col("q_start").alias("start"), "low", "until")
    rows = visits.select(F.col("ts").alias("t"), F.col("u").alias("a"), F.col("v").alias("b"), F.col("te").alias("till"))
    got = swept(cut(lanes), rows, wedges, "qid bigint", WEDGE_LANES, spans=True, width=width)
    yes = got.unionAll(ask.where("u = w").select("qid")).distinct()
    asked = queries.select(F.col("qid").cast("bigint")).distinct()
    return asked.join(yes.withColumn("_yes", F.lit(True)), "qid", "left").select("qid", F.coalesce("_yes", F.lit(False)).alias("reachable"))
