"""Queries of fragments, contraction, labels, general graphs, generators and files, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayspan.functions import LENGTH_HIGH, LENGTH_LOW, LENGTH_POWER, date_text
from wayspan.operators import fragments as fr
from wayspan.operators import generate, graphs, labels, reach
from wayspan.plans import graph
from wayspan.plans.graph import index
from wayspan.session import cut, shared_folder, table
from wayspan.sources import graph_files

def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Slots with fragments, and edges with those of their ends; kept like the index."""
    i = index(spark, d)
    if "parts" not in i.__dict__:
        frag = cut(fr.fragments(i.slots))
        i.parts = frag, cut(fr.with_fragments(i.edges, frag))
    return i.parts


def _classes(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    if "classes" not in i.__dict__:
        i.classes = cut(fr.classes(*_parts(spark, d)))
    return i.classes


def fragments(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d)[0].select("v", "slot_start", "frag")


def edge_cut(spark: SparkSession, d: str) -> DataFrame:
    return fr.edge_cut(_parts(spark, d)[1])


def fragment_matrix(spark: SparkSession, d: str) -> DataFrame:
    return fr.fragment_matrix(_parts(spark, d)[1])


def fragment_time_range(spark: SparkSession, d: str) -> DataFrame:
    return fr.fragment_times(_parts(spark, d)[0])


def perfect_partition_num(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    return spark.createDataFrame([(fr.least_fragments(i.slots, i.edges),)], "k bigint")


def border_vertices(spark: SparkSession, d: str) -> DataFrame:
    return fr.borders(_parts(spark, d)[1])


def out_classes(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).where("row = 'out'").select("v", "slot_start", F.col("n").alias("n_borders"))


def in_classes(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).where("row = 'in'").select("v", "slot_start", F.col("n").alias("n_borders"))


def contracted_size(spark: SparkSession, d: str) -> DataFrame:
    """Border slots, and classes of more than one border slot on either side: the vertices of the contracted graph."""
    sets = _classes(spark, d).agg(F.count_if((F.col("row") == "out_class") & (F.col("n") > 1)).alias("n_out_classes"), F.count_if((F.col("row") == "in_class") & (F.col("n") > 1)).alias("n_in_classes"))
    return border_vertices(spark, d).agg(F.count("*").alias("n_borders")).join(F.broadcast(sets), F.lit(True))  # one row each


def span_reach_contracted(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    parts, ends = _parts(spark, d), cut(reach.endpoints(table(spark, d, "span_query"), i.meeting, i.slots))
    yes = fr.contracted_reach(ends, *parts, fr.asked_classes(ends, *parts)).withColumn("_yes", F.lit(True))
    asked = table(spark, d, "span_query").select("qid").distinct()
    return asked.join(yes, "qid", "left").select("qid", F.coalesce("_yes", F.lit(False)).alias("reachable"))


def transitive_closure(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    return fr.whole_closure(i.slots, i.edges)


def level_labels(spark: SparkSession, d: str) -> DataFrame:
    return fr.levels(*_parts(spark, d))


def chain_labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels as text, `rank:at` by rank."""
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["rank"].cast("string"), x["at"].cast("string")))).alias(c)
    return fr.chain_labels(*_parts(spark, d)).select("v", "slot_start", text("lout"), text("lin"))


def label_tests(spark: SparkSession, d: str) -> DataFrame:
    """For each query with endpoints, whether its slots are the same, reach (yes) or don't (no); and what told it."""
    i = index(spark, d)
    parts, ends = _parts(spark, d), cut(reach.endpoints(table(spark, d, "span_query"), i.meeting, i.slots))
    found = fr.asked_classes(ends, *parts)
    if "labels" not in i.__dict__:  # numbers of classes don't depend on what is asked
        i.labels = cut(labels.label_table(*parts, found))
    return labels.label_verdicts(ends, *parts, found, i.labels)


def index_size(spark: SparkSession, d: str) -> DataFrame:
    """For each fragment: slots, border slots it leads to and holds, classes on either side, and bytes of their sets."""
    rows = _classes(spark, d)
    is_ = lambda r: F.col("row") == r
    return rows.groupBy("frag").agg(
        F.count_if(is_("out")).alias("n_slots"), F.count_if(is_("ghost")).alias("n_ghosts"), F.count_if(is_("entry")).alias("n_entries"),
        F.count_if(is_("out_class")).alias("n_out_classes"), F.count_if(is_("in_class")).alias("n_in_classes"), F.coalesce(F.sum(F.length("bits")), F.lit(0)).alias("n_bytes"),
    )


def split_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graphs.split_graph(graph._travel(spark, d))[0]


def split_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graphs.split_graph(graph._travel(spark, d))[1]


def _places(spark: SparkSession, d: str) -> DataFrame:
    """The graph of places: a, b where some visitor moved from place a to place b."""
    return index(spark, d).moves.where("next_v IS NOT NULL AND v <> next_v").select(F.col("v").alias("a"), F.col("next_v").alias("b"))


def weak_components(spark: SparkSession, d: str) -> DataFrame:
    return graphs.weak_components(index(spark, d).slots.select(F.col("v").alias("id")), _places(spark, d))


def strong_components(spark: SparkSession, d: str) -> DataFrame:
    return graphs.strong_components(index(spark, d).slots.select(F.col("v").alias("id")), _places(spark, d))


def _slot_pairs(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).edges.select(F.struct(F.col("src_v").alias("v"), F.col("src_start").alias("t")).alias("a"), F.struct(F.col("dst_v").alias("v"), F.col("dst_start").alias("t")).alias("b"))


def successor_classes(spark: SparkSession, d: str) -> DataFrame:
    return graphs.successor_classes(_slot_pairs(spark, d), 1)


def two_hop_classes(spark: SparkSession, d: str) -> DataFrame:
    return graphs.successor_classes(_slot_pairs(spark, d), 2)


def heaviest_parents(spark: SparkSession, d: str) -> DataFrame:
    rows = _places(spark, d).groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("weight"))
    return graphs.heaviest_parents(rows)


def power_law_durations(spark: SparkSession, d: str) -> DataFrame:
    rows = generate.drawn_lengths(table(spark, d, "arrival").select("rec_id").distinct(), "rec_id")
    return rows.select("rec_id", "seconds")


def generated_visits(spark: SparkSession, d: str) -> DataFrame:
    return generate.visits_of_arrivals(table(spark, d, "arrival"))


def redrawn_visits(spark: SparkSession, d: str) -> DataFrame:
    return generate.redrawn_ends(table(spark, d, "visit")).distinct()


def generated_queries(spark: SparkSession, d: str) -> DataFrame:
    low, high, n = table(spark, d, "visit").agg(F.min("ts"), F.max("ts"), F.max("u")).first()
    return generate.drawn_queries(spark, 10_000, (n or 0) + 1, low or 0, high or 0)


def bigraph_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Clipped visits, written as a graph file and read again."""
    path = f"{shared_folder(spark)}/bigraph-{uuid.uuid4().hex}"
    graph_files.write_visits(index(spark, d).visits, path)
    return graph_files.read_visits(spark, f"{path}/*")


def adjacency_export(spark: SparkSession, d: str) -> DataFrame:
    places = _places(spark, d)
    nodes = places.select(F.col("a").alias("id")).unionAll(places.select(F.col("b").alias("id")))
    return graph_files.adjacency_lines(nodes, places)


def metis_export(spark: SparkSession, d: str) -> DataFrame:
    places = _places(spark, d)
    nodes = places.select(F.col("a").alias("id")).unionAll(places.select(F.col("b").alias("id")))
    return graph_files.metis_lines(nodes, places)


def visits_by_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "visit").where("te > ts").groupBy(date_text(F.col("ts")).alias("day")).agg(F.count("*").alias("n_visits"), F.countDistinct("u").alias("n_visitors"))


def first_fifth(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 percent of visits by time, as a smaller graph to scale with."""
    return graph_files.first_percent(index(spark, d).visits, ["ts", "u"], 20)


QUERIES = {
    f.__name__: f
    for f in (
        fragments, edge_cut, fragment_matrix, fragment_time_range, perfect_partition_num, border_vertices, out_classes, in_classes, contracted_size, span_reach_contracted,
        transitive_closure, level_labels, chain_labels, label_tests, index_size, split_graph_nodes, split_graph_edges, weak_components, strong_components, successor_classes, two_hop_classes, heaviest_parents,
        power_law_durations, generated_visits, redrawn_visits, generated_queries, bigraph_roundtrip, adjacency_export, metis_export, visits_by_date, first_fifth,
    )
}


def _fragments_sql() -> str:
    return (
        graph.edges_sql()
        + f""",
    sz AS MATERIALIZED (SELECT CAST(ceil(count(*) / greatest({float(fr.LEAST_FRAGMENTS)}, ceil(count(*) / {float(fr.FRAGMENT_SLOTS)}))) AS BIGINT) AS size FROM sl),
    fg AS MATERIALIZED (SELECT v, slot_start, slot_end, (row_number() OVER (ORDER BY slot_start, slot_end, v) - 1) // (SELECT size FROM sz) AS frag FROM sl),
    ef AS MATERIALIZED (SELECT ed.*, a.frag AS src_frag, b.frag AS dst_frag FROM ed JOIN fg a ON a.v = src_v AND a.slot_start = src_start JOIN fg b ON b.v = dst_v AND b.slot_start = dst_start),
    bo AS MATERIALIZED (SELECT DISTINCT dst_v AS v, dst_start AS slot_start, dst_frag AS frag FROM ef WHERE src_frag <> dst_frag)"""
    )


_OUT = """,
    ot AS (
        SELECT DISTINCT src_v AS v, src_start AS t, dst_v AS bv, dst_start AS bt FROM ef WHERE src_frag <> dst_frag
        UNION SELECT src_v, src_start, bv, bt FROM ot JOIN ef ON dst_v = ot.v AND dst_start = ot.t AND src_frag = dst_frag
    ),
    os AS MATERIALIZED (SELECT v, t, count(*) AS n, list(DISTINCT [bt, bv] ORDER BY [bt, bv]) AS s FROM ot GROUP BY v, t)"""
_IN = """,
    nt AS (
        SELECT v, slot_start AS t, v AS bv, slot_start AS bt FROM bo
        UNION SELECT dst_v, dst_start, bv, bt FROM nt JOIN ef ON src_v = nt.v AND src_start = nt.t AND src_frag = dst_frag
    ),
    ns AS MATERIALIZED (SELECT v, t, count(*) AS n, list(DISTINCT [bt, bv] ORDER BY [bt, bv]) AS s FROM nt GROUP BY v, t)"""
_PLACES = graph.SLOTS + ", pl AS MATERIALIZED (SELECT v AS a, next_v AS b FROM mo WHERE next_v IS NOT NULL AND v <> next_v), nd AS MATERIALIZED (SELECT DISTINCT v AS id FROM sl UNION SELECT a FROM pl UNION SELECT b FROM pl)"
_P = LENGTH_POWER + 1
_LENGTH = f"CAST(floor(pow(({float(LENGTH_LOW) ** _P!r} - {float(LENGTH_HIGH) ** _P!r}) * Y + {float(LENGTH_HIGH) ** _P!r}, {1 / _P!r})) AS BIGINT)"


def _uniform_sql(key: str, seed: int) -> str:
    return f"(((((({key}) % 2147483648) * {2_654_435_761 % (1 << 31)} + {seed * 40_503}) % 2147483648) / 2147483648.0::DOUBLE))"


def _pick(k: int, size: str) -> str:
    return f"CAST(floor({_uniform_sql(f'i * 5 + {k}', 3)} * ({size})) AS BIGINT)"


_TRAVEL = graph.SLOTS + ", tr AS MATERIALIZED (SELECT DISTINCT v AS src, next_v AS dst, last_start AS depart, gap AS duration FROM mo WHERE next_ts IS NOT NULL AND gap >= 0), st AS (SELECT DISTINCT src AS vertex, depart AS time FROM tr), ar AS (SELECT DISTINCT dst AS vertex, depart + duration AS time FROM tr)"
_HOPS = """, e2 AS (SELECT DISTINCT [src_v, src_start] AS a, [dst_v, dst_start] AS b FROM ed)"""
_CLASSED = "sc AS (SELECT a, list(b ORDER BY b) AS s FROM (SELECT DISTINCT a, b FROM hp) GROUP BY a), cl AS (SELECT s, count(*) AS n_members FROM sc GROUP BY s) SELECT n_members, count(*) AS n_classes FROM cl GROUP BY n_members"
_UP = """,
    lf AS MATERIALIZED (SELECT src_v, src_start, dst_v, dst_start FROM ef WHERE src_frag = dst_frag)"""

SQL = {
    "fragments": f"WITH {_fragments_sql()} SELECT v, slot_start, frag FROM fg",
    "edge_cut": f"WITH {_fragments_sql()} SELECT count(*) AS n_edges, count(*) FILTER (src_frag <> dst_frag) AS n_cut, avg(CAST(src_frag <> dst_frag AS INT)) AS cut_ratio FROM ef",
    "fragment_matrix": f"WITH {_fragments_sql()} SELECT src_frag, dst_frag, count(*) AS n_edges FROM ef GROUP BY ALL",
    "fragment_time_range": f"WITH {_fragments_sql()} SELECT frag, count(*) AS n_slots, min(slot_start) AS first_start, max(slot_end) AS last_end FROM fg GROUP BY frag",
    "perfect_partition_num": f"""WITH {graph.edges_sql()},
        rk AS MATERIALIZED (SELECT v, slot_start, row_number() OVER (ORDER BY slot_start, slot_end, v) - 1 AS r FROM sl),
        lk AS MATERIALIZED (SELECT a.r AS x, b.r AS y FROM ed JOIN rk a ON a.v = src_v AND a.slot_start = src_start JOIN rk b ON b.v = dst_v AND b.slot_start = dst_start),
        sz AS (SELECT k, CAST(ceil((SELECT count(*) FROM sl) / k::DOUBLE) AS BIGINT) AS size FROM range(1, 257) t(k)),
        bo AS (SELECT k, size, count(DISTINCT y) AS n FROM sz, lk WHERE x // size <> y // size GROUP BY ALL)
        SELECT CAST(min(k) AS BIGINT) AS k FROM bo WHERE size <= 8 * n""",
    "index_size": f"""WITH RECURSIVE {_fragments_sql()} {_OUT} {_IN},
        gh AS (SELECT src_frag AS frag, count(DISTINCT (dst_v, dst_start)) AS n FROM ef WHERE src_frag <> dst_frag GROUP BY ALL),
        en AS (SELECT frag, count(*) AS n FROM bo GROUP BY frag),
        oc AS (SELECT frag, count(DISTINCT s) AS n FROM os JOIN fg ON fg.v = os.v AND fg.slot_start = os.t GROUP BY frag),
        ic AS (SELECT frag, count(DISTINCT s) AS n FROM ns JOIN fg ON fg.v = ns.v AND fg.slot_start = ns.t GROUP BY frag)
        SELECT frag, c AS n_slots, coalesce(gh.n, 0) AS n_ghosts, coalesce(en.n, 0) AS n_entries, coalesce(oc.n, 0) AS n_out_classes, coalesce(ic.n, 0) AS n_in_classes,
            coalesce(oc.n, 0) * ((coalesce(gh.n, 0) + 7) // 8) + coalesce(ic.n, 0) * ((coalesce(en.n, 0) + 7) // 8) AS n_bytes
        FROM (SELECT frag, count(*) AS c FROM fg GROUP BY frag) LEFT JOIN gh USING (frag) LEFT JOIN en USING (frag) LEFT JOIN oc USING (frag) LEFT JOIN ic USING (frag)""",
    "chain_labels": f"""WITH RECURSIVE {_fragments_sql()} {_UP},
        fc AS MATERIALIZED (SELECT fg.*, sl.c_start FROM fg JOIN sl USING (v, slot_start)),
        cr AS (SELECT frag, v, c_start, row_number() OVER (PARTITION BY frag ORDER BY count(*) DESC, min(slot_start), v) - 1 AS r FROM fc GROUP BY frag, v, c_start),
        cs AS MATERIALIZED (SELECT fc.v, fc.slot_start AS t, r FROM fc JOIN cr USING (frag, v, c_start)),
        fo AS (SELECT v, t, r, t AS tm FROM cs UNION SELECT src_v, src_start, r, tm FROM fo JOIN lf ON dst_v = fo.v AND dst_start = fo.t),
        fi AS (SELECT v, t, r, t AS tm FROM cs UNION SELECT dst_v, dst_start, r, tm FROM fi JOIN lf ON src_v = fi.v AND src_start = fi.t),
        lo AS (SELECT v, t, r, min(tm) AS tm FROM fo GROUP BY v, t, r QUALIFY row_number() OVER (PARTITION BY v, t ORDER BY r) <= 5),
        li AS (SELECT v, t, r, max(tm) AS tm FROM fi GROUP BY v, t, r QUALIFY row_number() OVER (PARTITION BY v, t ORDER BY r) <= 5)
        SELECT v, t AS slot_start, lout, lin FROM (SELECT v, t, string_agg(r || ':' || tm, ',' ORDER BY r) AS lout FROM lo GROUP BY v, t) JOIN (SELECT v, t, string_agg(r || ':' || tm, ',' ORDER BY r) AS lin FROM li GROUP BY v, t) USING (v, t)""",
    "border_vertices": f"WITH {_fragments_sql()} SELECT v, slot_start, frag FROM bo",
    "out_classes": f"WITH RECURSIVE {_fragments_sql()} {_OUT} SELECT sl.v, sl.slot_start, coalesce(n, 0) AS n_borders FROM sl LEFT JOIN os ON os.v = sl.v AND os.t = sl.slot_start",
    "in_classes": f"WITH RECURSIVE {_fragments_sql()} {_IN} SELECT sl.v, sl.slot_start, coalesce(n, 0) AS n_borders FROM sl LEFT JOIN ns ON ns.v = sl.v AND ns.t = sl.slot_start",
    "contracted_size": f"""WITH RECURSIVE {_fragments_sql()} {_OUT} {_IN}
        SELECT (SELECT count(*) FROM bo) AS n_borders, (SELECT count(DISTINCT (frag, s)) FROM os JOIN fg ON fg.v = os.v AND fg.slot_start = os.t WHERE n > 1) AS n_out_classes,
            (SELECT count(DISTINCT (frag, s)) FROM ns JOIN fg ON fg.v = ns.v AND fg.slot_start = ns.t WHERE n > 1) AS n_in_classes""",
    "span_reach_contracted": graph.SQL["span_reach"],
    "transitive_closure": f"""WITH RECURSIVE {graph.edges_sql()},
        rk AS MATERIALIZED (SELECT v, slot_start, CAST(row_number() OVER (ORDER BY slot_start, slot_end, v) - 1 AS INT) AS r FROM sl),
        lk AS MATERIALIZED (SELECT DISTINCT a.r AS x, b.r AS y FROM ed JOIN rk a ON a.v = src_v AND a.slot_start = src_start JOIN rk b ON b.v = dst_v AND b.slot_start = dst_start),
        tc AS (SELECT r AS x, r AS y FROM rk UNION SELECT tc.x, lk.y FROM tc JOIN lk ON lk.x = tc.y)
        SELECT v, slot_start, count(*) AS n_reached FROM tc JOIN rk ON rk.r = tc.x GROUP BY v, slot_start""",
    "level_labels": f"""WITH RECURSIVE {_fragments_sql()} {_UP},
        up AS (SELECT v, slot_start AS t, 0 AS n FROM sl UNION SELECT dst_v, dst_start, n + 1 FROM up JOIN lf ON src_v = up.v AND src_start = up.t),
        dn AS (SELECT v, slot_start AS t, 0 AS n FROM sl UNION SELECT src_v, src_start, n + 1 FROM dn JOIN lf ON dst_v = dn.v AND dst_start = dn.t),
        um AS (SELECT v, t, max(n) AS up FROM up GROUP BY v, t), dm AS (SELECT v, t, max(n) AS down FROM dn GROUP BY v, t)
        SELECT v, t AS slot_start, CAST(up AS BIGINT) AS up, CAST(down AS BIGINT) AS down FROM um JOIN dm USING (v, t)""",
    "split_graph_nodes": f"WITH {_TRAVEL} SELECT vertex, time, 'start' AS kind FROM st UNION ALL SELECT vertex, time, 'arrive' FROM ar",
    "split_graph_edges": f"""WITH {_TRAVEL},
        ch AS (SELECT vertex, time, kind, lead(time) OVER (PARTITION BY vertex, kind ORDER BY time) AS then_ FROM (SELECT *, 'start' AS kind FROM st UNION ALL SELECT *, 'arrive' FROM ar))
        SELECT vertex AS from_v, time AS from_t, kind AS from_kind, vertex AS to_v, then_ AS to_t, kind AS to_kind, 'chain' AS link FROM ch WHERE then_ IS NOT NULL
        UNION ALL SELECT ar.vertex, ar.time, 'arrive', st.vertex, st.time, 'start', 'wait' FROM ar ASOF JOIN st ON ar.vertex = st.vertex AND ar.time <= st.time
        UNION ALL SELECT src, depart, 'start', dst, depart + duration, 'arrive', 'travel' FROM tr""",
    "weak_components": f"""WITH RECURSIVE {_PLACES}, bt AS MATERIALIZED (SELECT a, b FROM pl UNION SELECT b, a FROM pl),
        w AS (SELECT id, id AS label FROM nd UNION SELECT b, label FROM w JOIN bt ON a = id WHERE label < b) SELECT id, min(label) AS label FROM w GROUP BY id""",
    "strong_components": f"""WITH RECURSIVE {_PLACES}, c AS (SELECT id AS a, id AS b FROM nd UNION SELECT c.a, pl.b FROM c JOIN pl ON pl.a = c.b)
        SELECT x.a AS id, min(x.b) AS label FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a""",
    "successor_classes": f"WITH {graph.edges_sql()} {_HOPS}, hp AS (SELECT a, b FROM e2), {_CLASSED}",
    "two_hop_classes": f"WITH {graph.edges_sql()} {_HOPS}, hp AS (SELECT a, b FROM e2 UNION SELECT x.a, y.b FROM e2 x JOIN e2 y ON x.b = y.a), {_CLASSED}",
    "heaviest_parents": f"WITH {_PLACES}, wt AS (SELECT a AS src, b AS dst, count(*) AS weight FROM pl GROUP BY ALL) SELECT src, dst, weight FROM wt QUALIFY row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) = 1",
    "power_law_durations": f"SELECT DISTINCT rec_id, {_LENGTH.replace('Y', _uniform_sql('rec_id', 1))} AS seconds FROM arrival",
    "generated_visits": f"""WITH ok AS (SELECT DISTINCT u, v, ts, ts + {_LENGTH.replace('Y', _uniform_sql('rec_id', 1))} AS te FROM arrival WHERE rec_id IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL AND ts IS NOT NULL),
        nx AS (SELECT *, lead(ts) OVER (PARTITION BY u ORDER BY ts, te, v) AS nts FROM ok) SELECT u, v, ts, least(te, coalesce(nts, te)) AS te FROM nx WHERE nts IS NULL OR nts > ts""",
    "redrawn_visits": f"SELECT DISTINCT rec_id, u, v, ts, ts + {_LENGTH.replace('Y', _uniform_sql('rec_id', 2))} AS te FROM visit WHERE rec_id IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL AND ts IS NOT NULL",
    "generated_queries": f"""WITH b AS (SELECT min(ts) AS low, max(ts) AS high, max(u) + 1 AS n FROM visit),
        r AS (SELECT i AS qid, {_pick(0, 'n')} AS u, {_pick(1, 'n')} AS w, {_pick(2, 'high - low + 1')} + low AS x, {_pick(3, 'high - low + 1')} + low AS y FROM range(10000) t(i), b)
        SELECT qid, u, w, least(x, y) AS q_start, greatest(x, y) AS q_end FROM r""",
    "bigraph_roundtrip": graph.SQL["visits_clipped"],
    "adjacency_export": f"WITH {_PLACES}, d AS (SELECT DISTINCT a, b FROM pl), i AS (SELECT a AS id FROM d UNION SELECT b FROM d) SELECT id AS node, id || ':' || coalesce(' ' || string_agg(b, ' ' ORDER BY b), '') || ' #' AS line FROM i LEFT JOIN d ON a = id GROUP BY id",
    "metis_export": f"WITH {_PLACES}, d AS (SELECT a, b FROM pl UNION SELECT b, a FROM pl) SELECT a + 1 AS node, string_agg(b + 1, ' ' ORDER BY b) AS line FROM d GROUP BY a",
    "visits_by_date": "SELECT strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y.%m.%d') AS day, count(*) AS n_visits, count(DISTINCT u) AS n_visitors FROM visit WHERE te > ts GROUP BY 1",
    "first_fifth": f"WITH {graph.VISITS} SELECT u, v, ts, te FROM cv QUALIFY (row_number() OVER (ORDER BY ts, u) - 1) * 100 < (SELECT count(*) FROM cv) * 20",
}
