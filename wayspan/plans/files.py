"""Queries that write the text formats and read them again, and those of the small tools, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayspan import functions as fn
from wayspan.operators import generate, graphs, reach
from wayspan.operators.blocks import with_rank
from wayspan.plans import graph, pipeline
from wayspan.plans.graph import index
from wayspan.plans.problems import SQL as PROBLEMS
from wayspan.plans.structure import _PLACES, _TRAVEL, _fragments_sql, _parts, _places, _uniform_sql
from wayspan.session import cut, shared_folder, table
from wayspan.sources import graph_files as gf
from wayspan.streaming.ingest import load_lines

LONG_WINDOW = 43_200
N_PAIRS, N_NODES = 5_000, 1_000


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return reach.clean_queries(table(spark, d, "span_query"))


def arrivals_file(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals written as lines of starts, and read again."""
    path = _path(spark, "arrivals")
    table(spark, d, "arrival").select("u", "ts", "v").dropna().select(F.concat_ws(" ", "u", "ts", "v").alias("value")).write.text(path)
    return gf.read_arrivals(spark, path)


def queries_file(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "queries")
    gf.write_queries(_asked(spark, d), path)
    return gf.read_queries(spark, path).drop("qid")


def labelled_queries_file(spark: SparkSession, d: str) -> DataFrame:
    """Queries in two files by a label, here whether their window is long, and read again with it."""
    path = _path(spark, "labelled")
    asked = _asked(spark, d).withColumn("expected", F.col("q_end") - F.col("q_start") >= LONG_WINDOW)
    for wanted in (True, False):
        gf.write_queries(asked.where(F.col("expected") == wanted), f"{path}_{int(wanted)}")
    return gf.read_labelled_queries(spark, path).drop("qid")


def queries_by_label_file(spark: SparkSession, d: str) -> DataFrame:
    """Queries with a file of labels beside them, line by line; those labelled 1, of which at most 100,000 are read, as the format's reader has it."""
    path = _path(spark, "by-label")
    asked = _asked(spark, d)
    gf.write_in_order(asked.select("qid", F.concat_ws(" ", "u", "w", "q_start", "q_end").alias("line")), f"{path}/q", "qid")
    gf.write_in_order(asked.select("qid", F.when(F.col("q_end") - F.col("q_start") >= LONG_WINDOW, "1").otherwise("0").alias("line")), f"{path}/l", "qid")
    return gf.read_queries_by_label(spark, f"{path}/q", f"{path}/l", True).drop("qid")


def pairs_file(spark: SparkSession, d: str) -> DataFrame:
    """Drawn pairs of different vertices, written and read again."""
    path = _path(spark, "pairs")
    generate.drawn_pairs(spark, N_PAIRS, N_NODES).select(F.concat_ws(" ", "s", "t").alias("value")).write.text(path)
    return gf.read_pairs(spark, path).select("u", "w")


def random_digraph(spark: SparkSession, d: str) -> DataFrame:
    return generate.drawn_digraph(spark, N_NODES, N_PAIRS)


def edge_list_file(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "edges")
    gf.write_lines(_places(spark, d).distinct().select(F.concat_ws(" ", "a", "b").alias("line")), path, [str(index(spark, d).slots.select("v").distinct().count())])
    return gf.read_edge_list(spark, f"{path}/*")


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    rows = _places(spark, d).groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("weight"))
    return with_rank(rows, ["src", "dst"], "edge_id").select("src", "dst", "edge_id", "weight")


def weighted_file(spark: SparkSession, d: str) -> DataFrame:
    """The graph of places with the number of moves as weights, written and read again."""
    path = _path(spark, "weighted")
    gf.write_lines(gf.weighted_lines(cut(_weighted(spark, d))), path, ["graph_for_greach", "0"])
    return gf.read_weighted(spark, f"{path}/*")


def gdl_export(spark: SparkSession, d: str) -> DataFrame:
    return gf.gdl_lines(_weighted(spark, d))


def chains_file(spark: SparkSession, d: str) -> DataFrame:
    """Components of a place as chains of their slots, numbered by time, written and read again."""
    path = _path(spark, "chains")
    slot = index(spark, d).slots
    ids = with_rank(slot.select("v", "c_start", "slot_start", "slot_end"), ["slot_start", "slot_end", "v"], "node")
    number = with_rank(slot.select("v", "c_start").distinct(), ["c_start", "v"], "chain")
    rows = ids.join(number, ["v", "c_start"]).select("chain", F.col("slot_start").alias("place"), "node")
    gf.write_in_order(gf.chain_lines(rows), path, "chain")
    return gf.read_chains(spark, path).withColumn("place", F.col("place").cast("bigint"))


def part_report(spark: SparkSession, d: str) -> DataFrame:
    """Fragments written as a file of part ids, a line for each slot in order of time, read as an outside partition and reported on."""
    path = _path(spark, "parts")
    order = ["slot_start", "slot_end", "v"]
    gf.write_in_order(with_rank(_parts(spark, d)[0], order, "node").select("node", F.col("frag").cast("string").alias("line")), path, "node")
    return pipeline.part_report(spark, index(spark, d).visits, gf.read_parts(spark, path))


def adjacency_from_one(spark: SparkSession, d: str) -> DataFrame:
    """Adjacency lines with ids from 1 and no closing mark."""
    places = _places(spark, d)
    nodes = places.select(F.col("a").alias("id")).unionAll(places.select(F.col("b").alias("id")))
    return gf.adjacency_lines(nodes, places, 1, "")


def graphviz_edges(spark: SparkSession, d: str) -> DataFrame:
    return gf.graphviz_lines(_places(spark, d).distinct())


def graphviz_slots(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    ids = cut(with_rank(i.slots.select("v", "slot_start", "slot_end"), ["slot_start", "slot_end", "v"], "id"))
    a = ids.select(F.col("v").alias("src_v"), F.col("slot_start").alias("src_start"), F.col("id").alias("a"))
    b = ids.select(F.col("v").alias("dst_v"), F.col("slot_start").alias("dst_start"), F.col("id").alias("b"))
    return gf.graphviz_slots(ids, i.edges.join(a, ["src_v", "src_start"]).join(b, ["dst_v", "dst_start"]).select("a", "b"))


def event_graph_lines(spark: SparkSession, d: str) -> DataFrame:
    return gf.event_graph_lines(*graphs.split_graph(graph._travel(spark, d)))


def event_info_lines(spark: SparkSession, d: str) -> DataFrame:
    return gf.event_info_lines(graphs.split_graph(graph._travel(spark, d))[0])


def report_file(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of the slot graph, written as a report and read again."""
    path = _path(spark, "report")
    gf.write_report(graph.dag_stats(spark, d), path)
    return spark.read.json(path)


def visits_json(spark: SparkSession, d: str) -> DataFrame:
    visits = index(spark, d).visits
    return visits.select("u", "ts", gf.as_json(visits).alias("line"))


def stream_visits(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines of raw_visit, loaded as a stream of files."""
    path = _path(spark, "stream")
    incoming = f"{path}/incoming"  # a folder, as a stream of files needs
    table(spark, d, "raw_visit").write.parquet(incoming)
    lines = spark.readStream.schema(table(spark, d, "raw_visit").schema).parquet(incoming)
    load_lines(lines, table(spark, d, "feed"), f"{path}/visits", f"{path}/rejects", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/visits").drop("batch")


def text_tools(spark: SparkSession, d: str) -> DataFrame:
    """Parts of each feed's name between its marks and digits, and the stem of a path made of it."""
    feed = table(spark, d, "feed")
    return feed.select("feed_id", F.concat_ws("|", fn.tokens(F.col("feed_name"), "_0")).alias("parts"), fn.file_stem(F.concat(F.lit("/feeds/a.b/"), "feed_name", F.lit(".v1.txt"))).alias("stem"))


def packed_keys(spark: SparkSession, d: str) -> DataFrame:
    """Visitor and place of each clipped visit in one number."""
    return index(spark, d).visits.select("u", "ts", fn.packed(F.col("u"), F.col("v")).alias("key"))


def place_sets(spark: SparkSession, d: str) -> DataFrame:
    """For each visitor the places of even and of odd days: all of them, and those of one kind of day only, ascending."""
    rows = index(spark, d).visits.withColumn("odd", F.pmod(F.floor(F.col("ts") / F.lit(86_400)), F.lit(2)) == 1).select("u", "v", "odd").distinct()
    sets = rows.groupBy("u").agg(*[F.collect_list(F.when(c, F.col("v"))).alias(n) for n, c in (("a", ~F.col("odd")), ("b", F.col("odd")))])
    text = lambda x: F.concat_ws(",", F.transform(x, lambda y: y.cast("string")))
    return sets.select("u", text(fn.merged_unique(F.col("a"), F.col("b"))).alias("places"), text(fn.symmetric_difference(F.col("a"), F.col("b"))).alias("single"))


QUERIES = {
    f.__name__: f
    for f in (
        arrivals_file, queries_file, labelled_queries_file, queries_by_label_file, pairs_file, random_digraph, edge_list_file, weighted_file, gdl_export, chains_file, part_report,
        adjacency_from_one, graphviz_edges, graphviz_slots, event_graph_lines, event_info_lines, report_file, visits_json, stream_visits, text_tools, packed_keys, place_sets,
    )
}

_ASKED = "SELECT DISTINCT qid, u, w, q_start, q_end FROM span_query WHERE qid IS NOT NULL AND u IS NOT NULL AND w IS NOT NULL AND q_start IS NOT NULL AND q_end IS NOT NULL AND q_start <= q_end"


def _pairs_sql(seed: int) -> str:
    first = f"CAST(floor({_uniform_sql('i * 2', seed)} * {N_NODES}) AS BIGINT)"
    second = f"CAST(floor({_uniform_sql('i * 2 + 1', seed)} * {N_NODES - 1}) AS BIGINT)"
    return f"SELECT s, CASE WHEN t >= s THEN t + 1 ELSE t END AS t FROM (SELECT {first} AS s, {second} AS t FROM range({N_PAIRS}) r(i))"


_WEIGHTED = _PLACES + ", wt AS (SELECT a AS src, b AS dst, row_number() OVER (ORDER BY a, b) - 1 AS edge_id, count(*) AS weight FROM pl GROUP BY a, b)"
_IDS = ", id AS MATERIALIZED (SELECT v, slot_start, slot_end, c_start, row_number() OVER (ORDER BY slot_start, slot_end, v) - 1 AS node FROM sl)"
_EVENTS = _TRAVEL + """,
    ev AS MATERIALIZED (SELECT vertex, time, kind, row_number() OVER (ORDER BY vertex, time, kind) - 1 AS id FROM (SELECT *, 'start' AS kind FROM st UNION ALL SELECT *, 'arrive' FROM ar))"""

SQL = {
    "arrivals_file": "SELECT u, ts, v FROM arrival WHERE u IS NOT NULL AND ts IS NOT NULL AND v IS NOT NULL",
    "queries_file": f"SELECT u, w, q_start, q_end FROM ({_ASKED})",
    "labelled_queries_file": f"SELECT u, w, q_start, q_end, q_end - q_start >= {LONG_WINDOW} AS expected FROM ({_ASKED})",
    "queries_by_label_file": f"SELECT u, w, q_start, q_end FROM ({_ASKED}) WHERE q_end - q_start >= {LONG_WINDOW}",
    "pairs_file": f"SELECT s AS u, t AS w FROM ({_pairs_sql(4)})",
    "random_digraph": f"SELECT DISTINCT least(s, t) AS a, greatest(s, t) AS b FROM ({_pairs_sql(5)})",
    "edge_list_file": f"WITH {_PLACES} SELECT DISTINCT a, b FROM pl",
    "weighted_file": f"WITH {_WEIGHTED} SELECT * FROM wt",
    "gdl_export": f"""WITH {_WEIGHTED} SELECT 'edge: {{ sourcename: "' || src || '" targetname: "' || dst || '" label: "' || weight || '" }}' AS line FROM wt""",
    "chains_file": f"""WITH {graph.SLOTS} {_IDS}, cn AS (SELECT v, c_start, row_number() OVER (ORDER BY c_start, v) - 1 AS chain FROM (SELECT DISTINCT v, c_start FROM sl))
        SELECT chain, row_number() OVER (PARTITION BY chain ORDER BY slot_start) - 1 AS place, node FROM id JOIN cn USING (v, c_start)""",
    "part_report": f"""WITH {_fragments_sql()}, tm AS (SELECT frag, min(slot_start) AS first_start, max(slot_end) AS last_end FROM fg GROUP BY frag)
        SELECT src_frag AS src_part, dst_frag AS dst_part, count(*) AS n_edges, first_start, last_end FROM ef JOIN tm ON frag = src_frag GROUP BY ALL""",
    "adjacency_from_one": f"WITH {_PLACES}, d AS (SELECT DISTINCT a, b FROM pl), i AS (SELECT a AS id FROM d UNION SELECT b FROM d) SELECT id + 1 AS node, (id + 1) || ':' || coalesce(' ' || string_agg(b + 1, ' ' ORDER BY b), '') AS line FROM i LEFT JOIN d ON a = id GROUP BY id",
    "graphviz_edges": f"WITH {_PLACES} SELECT DISTINCT a || ' -> ' || b || ';' AS line FROM pl",
    "graphviz_slots": f"""WITH {graph.edges_sql()} {_IDS}, kd AS (SELECT DISTINCT a.node AS a, b.node AS b FROM ed JOIN id a ON a.v = src_v AND a.slot_start = src_start JOIN id b ON b.v = dst_v AND b.slot_start = dst_start)
        SELECT node, '{{rank="same";' || node || '[label = "id=' || node || '|start=' || slot_start || '|end=' || slot_end || '"]}};' || coalesce(string_agg(node || '->' || b || ';', '' ORDER BY b), '') AS line FROM id LEFT JOIN kd ON a = node GROUP BY node, slot_start, slot_end""",
    "event_graph_lines": f"""WITH {_EVENTS},
        ch AS (SELECT id, lead(id) OVER (PARTITION BY vertex, kind ORDER BY time) AS kid FROM ev),
        wa AS (SELECT x.id, y.id AS kid FROM (SELECT * FROM ev WHERE kind = 'arrive') x ASOF JOIN (SELECT * FROM ev WHERE kind = 'start') y ON x.vertex = y.vertex AND x.time <= y.time),
        tv AS (SELECT x.id, y.id AS kid FROM tr JOIN ev x ON x.vertex = src AND x.time = depart AND x.kind = 'start' JOIN ev y ON y.vertex = dst AND y.time = depart + duration AND y.kind = 'arrive'),
        lk AS (SELECT id, kid FROM ch WHERE kid IS NOT NULL UNION SELECT id, kid FROM wa UNION SELECT id, kid FROM tv)
        SELECT ev.id AS node, ev.id || ' ' || count(kid) || ' ' || coalesce(string_agg(kid || ' ', '' ORDER BY kid), '') AS line FROM ev LEFT JOIN lk USING (id) GROUP BY ev.id""",
    "event_info_lines": f"WITH {_EVENTS} SELECT vertex, kind, vertex || ' ' || count(*) || ' ' || string_agg(time || ' ', '' ORDER BY time) AS line FROM ev GROUP BY vertex, kind",
    "report_file": graph.SQL["dag_stats"],
    "visits_json": f"""WITH {graph.VISITS} SELECT u, ts, '{{"u":' || u || ',"v":' || v || ',"ts":' || ts || ',"te":' || te || '}}' AS line FROM cv""",
    "stream_visits": PROBLEMS["p2_visits"],
    "text_tools": "SELECT feed_id, array_to_string(list_filter(regexp_split_to_array(feed_name, '[_0]+'), lambda x: x <> ''), '|') AS parts, feed_name || '.v1' AS stem FROM feed",
    "packed_keys": f"WITH {graph.VISITS} SELECT u, ts, (u << 32) | (v & 4294967295) AS key FROM cv",
    "place_sets": f"""WITH {graph.VISITS}, k AS (SELECT u, v, count(DISTINCT (ts // 86400) % 2) AS n FROM cv GROUP BY u, v)
        SELECT u, string_agg(v, ',' ORDER BY v) AS places, coalesce(string_agg(v, ',' ORDER BY v) FILTER (n = 1), '') AS single FROM k GROUP BY u""",
}
