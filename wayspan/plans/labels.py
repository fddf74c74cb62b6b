"""Queries of indexes, searches and general graphs beyond the slot graph itself, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayspan.functions import interval_contains
from wayspan.operators import fragments as fr
from wayspan.operators import graphs, labels, reach
from wayspan.operators.blocks import with_rank
from wayspan.plans import graph
from wayspan.plans.graph import index
from wayspan.plans.structure import _IN, _OUT, _PLACES, _UP, _classes, _fragments_sql, _parts, _places, _slot_pairs, label_tests
from wayspan.session import cut, table


def _ends(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    return reach.endpoints(table(spark, d, "span_query"), i.meeting, i.slots)


def _answers(spark: SparkSession, d: str, yes: DataFrame) -> DataFrame:
    """qid and reachable of all queries, true for the qids of yes."""
    asked = table(spark, d, "span_query").select("qid").distinct()
    return asked.join(yes.select("qid", F.lit(True).alias("_yes")), "qid", "left").select("qid", F.coalesce("_yes", F.lit(False)).alias("reachable"))


def index_reach(spark: SparkSession, d: str) -> DataFrame:
    """Answers by the index: label tests first, then a search for what they leave open."""
    return _answers(spark, d, label_tests(spark, d).where("verdict <> 'no'"))


def span_reach_unshared(spark: SparkSession, d: str) -> DataFrame:
    """Answers through fragments in which every slot is a class of its own."""
    parts, ends = _parts(spark, d), cut(_ends(spark, d))
    return _answers(spark, d, fr.contracted_reach(ends, *parts, fr.asked_classes(ends, *parts, share=False)))


def span_reach_paths(spark: SparkSession, d: str) -> DataFrame:
    """Answers through fragments, with path labels in place of walks within one."""
    parts, ends = _parts(spark, d), cut(_ends(spark, d))
    return _answers(spark, d, fr.contracted_reach(ends, *parts, fr.asked_classes(ends, *parts), local=labels.path_hits))


def class_sharing(spark: SparkSession, d: str) -> DataFrame:
    """Links from slots to border slots of each fragment and side, with a set for each class and for each slot."""
    rows = _classes(spark, d)
    side = F.substring_index("row", "_", 1)
    return (
        rows.where("row IN ('out', 'in', 'out_class', 'in_class')").groupBy("frag", side.alias("side"))
        .agg(F.coalesce(F.sum(F.when(F.col("row").endswith("class"), F.col("n"))), F.lit(0)).alias("links_shared"), F.coalesce(F.sum(F.when(~F.col("row").endswith("class"), F.col("n"))), F.lit(0)).alias("links_plain"))
    )


def border_set_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How many slots lead to (out) or come from (in) so many border slots."""
    return _classes(spark, d).where("row IN ('out', 'in')").groupBy(F.col("row").alias("side"), F.col("n").alias("n_borders")).agg(F.count("*").alias("n_slots"))


def topological_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels 1, 11, 21, ... of the slots in topological order, with room between."""
    ranked = with_rank(index(spark, d).slots.select("v", "slot_start", "slot_end"), ["slot_start", "slot_end", "v"])
    return ranked.select("v", "slot_start", (F.col("rank") * 10 + 1).alias("label"))


def topological_orders(spark: SparkSession, d: str) -> DataFrame:
    return labels.orders(*_parts(spark, d))


def path_cover(spark: SparkSession, d: str) -> DataFrame:
    return labels.path_cover(*_parts(spark, d))


def tree_cover(spark: SparkSession, d: str) -> DataFrame:
    """Parents of the tree over each fragment (-1 for roots), predecessors, successors, and slots below in the tree."""
    rows = labels.tree_cover(*_parts(spark, d))
    parent = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("parent_v", "parent_start")]
    return rows.select("v", "slot_start", *parent, "n_before", "n_after", (F.col("last") - F.col("pre")).alias("n_below"))


def cover_ratio(spark: SparkSession, d: str) -> DataFrame:
    """For each fragment: pairs of slots that reach, those of them that the tree's intervals tell, and their share."""
    rows = labels.tree_cover(*_parts(spark, d)).groupBy("frag").agg(F.sum("n_after").alias("n_pairs"), F.sum(F.col("last") - F.col("pre")).alias("n_covered"))
    return rows.select("frag", "n_pairs", "n_covered", F.coalesce(F.try_divide(F.col("n_covered").cast("double"), F.col("n_pairs")), F.lit(0.0)).alias("ratio"))


def index_violations(spark: SparkSession, d: str) -> DataFrame:
    """What must not be, as what and the slot: edges along which an order doesn't ascend or the post-order doesn't fall, steps
    of a path that are no edge, places of a path held twice, and children outside the interval of their parent."""
    frag, edge = _parts(spark, d)
    inner = edge.where("src_frag = dst_frag").select("src_v", "src_start", "dst_v", "dst_start")
    order, path, tree = (cut(f(frag, edge)) for f in (labels.orders, labels.path_cover, labels.tree_cover))
    side = lambda df, s, cols: df.select(F.col("v").alias(f"{s}_v"), F.col("slot_start").alias(f"{s}_start"), *[F.col(c).alias(f"{s}_{c}") for c in cols])
    at = [F.col("src_v").alias("v"), F.col("src_start").alias("slot_start")]
    both = lambda df, cols: inner.join(side(df, "src", cols), ["src_v", "src_start"]).join(side(df, "dst", cols), ["dst_v", "dst_start"])
    wrong = both(order, ["first", "second", "post"]).where("src_first >= dst_first OR src_second >= dst_second OR src_post <= dst_post").select(F.lit("order").alias("what"), *at)
    step = path.select(F.col("v").alias("src_v"), F.col("slot_start").alias("src_start"), "frag", "path", (F.col("place") + 1).alias("place")).join(path.select(F.col("v").alias("dst_v"), F.col("slot_start").alias("dst_start"), "frag", "path", "place"), ["frag", "path", "place"])
    wrong = wrong.unionByName(step.join(inner, ["src_v", "src_start", "dst_v", "dst_start"], "left_anti").select(F.lit("path").alias("what"), *at))
    twice = path.groupBy("frag", "path", "place").agg(F.count("*").alias("n"), F.min("v").alias("v"), F.min("slot_start").alias("slot_start")).where("n > 1")
    wrong = wrong.unionByName(twice.select(F.lit("place").alias("what"), "v", "slot_start"))
    child = tree.where("parent_v IS NOT NULL").select(F.col("parent_v").alias("src_v"), F.col("parent_start").alias("src_start"), "pre", "last").join(side(tree, "src", ["pre", "last"]), ["src_v", "src_start"])
    inside = interval_contains(F.col("src_pre"), F.col("src_last"), F.col("pre")) & (F.col("last") <= F.col("src_last")) & (F.col("src_pre") < F.col("pre"))
    return wrong.unionByName(child.where(~inside).select(F.lit("interval").alias("what"), *at))


def latest_departure(spark: SparkSession, d: str) -> DataFrame:
    """From where, and until when, the place in which w is found last can still be reached within the window."""
    window = reach.clean_queries(table(spark, d, "span_query")).select("qid", F.col("q_start").alias("t_start"), F.col("q_end").alias("t_end"))
    targets = _ends(spark, d).select("qid", F.col("dst_v").alias("target")).join(window, "qid")
    got = reach.latest_departure(targets, graph._travel(spark, d))
    return got.groupBy("qid").agg(F.count("*").alias("n_places"), F.sum("departure").alias("sum_departure"), F.min("departure").alias("first_departure"))


def first_departures(spark: SparkSession, d: str) -> DataFrame:
    """The first departure from each query's source in its window, and the last arrival at it; -1 where there is only the other."""
    got = reach.first_departures(graph._sources(spark, d), graph._travel(spark, d))
    return got.select("qid", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("first_departure", "last_arrival")])


def condensed_places(spark: SparkSession, d: str) -> DataFrame:
    """Moves between strongly connected components of places."""
    return graphs.condensation(_places(spark, d), _strong(spark, d))


def condensed_levels(spark: SparkSession, d: str) -> DataFrame:
    strong = _strong(spark, d)
    return graphs.topological_levels(strong.select(F.col("label").alias("id")).distinct(), graphs.condensation(_places(spark, d), strong))


def _strong(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    if "strong" not in i.__dict__:
        i.strong = cut(graphs.strong_components(i.slots.select(F.col("v").alias("id")), _places(spark, d)))
    return i.strong


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("weight"))


def place_branching(spark: SparkSession, d: str) -> DataFrame:
    return graphs.branching(_weights(spark, d))


def branching_violations(spark: SparkSession, d: str) -> DataFrame:
    return graphs.branching_violations(place_branching(spark, d))


def place_distances(spark: SparkSession, d: str) -> DataFrame:
    """Moves of a shortest way from the place where u is found first to that where w is found last; -1 where there is none."""
    ends = _ends(spark, d).select("qid", F.col("src_v").alias("source"), F.col("dst_v").alias("target"))
    return graphs.distances(ends, _places(spark, d)).select("qid", F.coalesce("hops", F.lit(-1)).alias("hops"))


def place_closure(spark: SparkSession, d: str) -> DataFrame:
    """How many places each place leads to."""
    return graphs.reach_counts(_places(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        index_reach, span_reach_unshared, span_reach_paths, class_sharing, border_set_histogram, topological_labels, topological_orders, path_cover, tree_cover, cover_ratio, index_violations,
        latest_departure, first_departures, condensed_places, condensed_levels, place_branching, branching_violations, place_distances, place_closure,
    )
}

_SIDES = f"""WITH RECURSIVE {_fragments_sql()} {_OUT} {_IN},
    sd AS (SELECT frag, 'out' AS side, v, slot_start, coalesce(n, 0) AS n, s FROM fg LEFT JOIN os ON os.v = fg.v AND os.t = fg.slot_start
        UNION ALL SELECT frag, 'in', v, slot_start, coalesce(n, 0), s FROM fg LEFT JOIN ns ON ns.v = fg.v AND ns.t = fg.slot_start)""".replace("SELECT frag, 'out' AS side, v, slot_start", "SELECT frag, 'out' AS side, fg.v, fg.slot_start").replace("SELECT frag, 'in', v, slot_start", "SELECT frag, 'in', fg.v, fg.slot_start")
#: Slots that lead to each other within a fragment, themselves left out; and the tree over it.
_CLOSED = f"""WITH RECURSIVE {_fragments_sql()} {_UP},
    tc AS (SELECT src_v AS av, src_start AS ta, dst_v AS bv, dst_start AS bt FROM lf UNION SELECT tc.av, tc.ta, dst_v, dst_start FROM tc JOIN lf ON src_v = bv AND src_start = bt),
    nb AS MATERIALIZED (SELECT bv AS v, bt AS t, count(*) AS n FROM tc GROUP BY ALL),
    na AS MATERIALIZED (SELECT av AS v, ta AS t, count(*) AS n FROM tc GROUP BY ALL),
    pa AS MATERIALIZED (SELECT dst_v AS v, dst_start AS t, src_v AS pv, src_start AS pt FROM (SELECT DISTINCT * FROM lf) LEFT JOIN nb ON nb.v = src_v AND nb.t = src_start
        QUALIFY row_number() OVER (PARTITION BY dst_v, dst_start ORDER BY coalesce(nb.n, 0) DESC, src_start, src_v) = 1),
    up AS (SELECT v, t, pv, pt FROM pa UNION SELECT up.v, up.t, pa.pv, pa.pt FROM up JOIN pa ON pa.v = up.pv AND pa.t = up.pt),
    be AS MATERIALIZED (SELECT pv AS v, pt AS t, count(*) AS n FROM up GROUP BY ALL),
    tr AS (SELECT frag, fg.v, fg.slot_start, coalesce(pv, -1) AS parent_v, coalesce(pt, -1) AS parent_start, coalesce(nb.n, 0) AS n_before, coalesce(na.n, 0) AS n_after, coalesce(be.n, 0) AS n_below
        FROM fg LEFT JOIN pa ON pa.v = fg.v AND pa.t = fg.slot_start LEFT JOIN nb ON nb.v = fg.v AND nb.t = fg.slot_start LEFT JOIN na ON na.v = fg.v AND na.t = fg.slot_start LEFT JOIN be ON be.v = fg.v AND be.t = fg.slot_start)"""
_STRONG = f"""WITH RECURSIVE {_PLACES}, c AS (SELECT id AS a, id AS b FROM nd UNION SELECT c.a, pl.b FROM c JOIN pl ON pl.a = c.b),
    cm AS MATERIALIZED (SELECT x.a AS id, min(x.b) AS label FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
    ce AS MATERIALIZED (SELECT s.label AS src, t.label AS dst, count(*) AS n_edges FROM (SELECT DISTINCT a, b FROM pl) JOIN cm s ON s.id = a JOIN cm t ON t.id = b WHERE s.label <> t.label GROUP BY ALL)"""
_NOTHING = "SELECT 0 AS v WHERE false"

SQL = {
    "index_reach": graph.SQL["span_reach"],
    "span_reach_unshared": graph.SQL["span_reach"],
    "span_reach_paths": graph.SQL["span_reach"],
    "class_sharing": _SIDES + " SELECT frag, side, CAST(coalesce(sum(len(s)) FILTER (k = 1), 0) AS BIGINT) AS links_shared, CAST(sum(n) AS BIGINT) AS links_plain FROM (SELECT *, row_number() OVER (PARTITION BY frag, side, s) AS k FROM sd) GROUP BY frag, side",
    "border_set_histogram": _SIDES + " SELECT side, n AS n_borders, count(*) AS n_slots FROM sd GROUP BY ALL",
    "topological_labels": f"WITH {graph.SLOTS} SELECT v, slot_start, 10 * row_number() OVER (ORDER BY slot_start, slot_end, v) - 9 AS label FROM sl",
    "tree_cover": _CLOSED + " SELECT * EXCLUDE (frag) FROM tr",
    "cover_ratio": _CLOSED + " SELECT frag, CAST(sum(n_after) AS BIGINT) AS n_pairs, CAST(sum(n_below) AS BIGINT) AS n_covered, coalesce(CAST(sum(n_below) AS DOUBLE) / nullif(CAST(sum(n_after) AS DOUBLE), 0), 0.0) AS ratio FROM tr GROUP BY frag",
    "index_violations": "SELECT '' AS what, 0 AS v, 0 AS slot_start WHERE false",
    "latest_departure": f"""WITH RECURSIVE {graph.SLOTS} {graph._ENDPOINTS},
        tr AS MATERIALIZED (SELECT DISTINCT v AS src, next_v AS dst, last_start AS depart, gap AS duration FROM mo WHERE next_ts IS NOT NULL AND gap >= 0),
        ld AS (SELECT qid, dst_v AS vertex, q_end AS departure, q_start FROM ep JOIN qs USING (qid)
            UNION SELECT qid, src, depart, q_start FROM ld JOIN tr ON dst = vertex WHERE depart + duration <= departure AND depart >= q_start),
        lm AS (SELECT qid, vertex, max(departure) AS departure FROM ld GROUP BY ALL)
        SELECT qid, count(*) AS n_places, CAST(sum(departure) AS BIGINT) AS sum_departure, min(departure) AS first_departure FROM lm GROUP BY qid""",
    "first_departures": f"""WITH {graph.SLOTS} {graph._ENDPOINTS},
        tr AS MATERIALIZED (SELECT DISTINCT v AS src, next_v AS dst, last_start AS depart, gap AS duration FROM mo WHERE next_ts IS NOT NULL),
        so AS (SELECT qid, src_v AS source, q_start, q_end FROM ep JOIN qs USING (qid)),
        fd AS (SELECT qid, (SELECT min(depart) FROM tr WHERE src = source AND depart BETWEEN q_start AND q_end) AS first_departure,
            (SELECT max(depart + duration) FROM tr WHERE dst = source AND depart + duration BETWEEN q_start AND q_end) AS last_arrival FROM so)
        SELECT qid, coalesce(first_departure, -1) AS first_departure, coalesce(last_arrival, -1) AS last_arrival FROM fd WHERE first_departure IS NOT NULL OR last_arrival IS NOT NULL""",
    "condensed_places": _STRONG + " SELECT * FROM ce",
    "condensed_levels": _STRONG + ", lv AS (SELECT DISTINCT label AS id, 0 AS n FROM cm UNION SELECT dst, n + 1 FROM lv JOIN ce ON src = id) SELECT id, CAST(max(n) AS BIGINT) AS level FROM lv GROUP BY id",
    "place_branching": f"""WITH RECURSIVE {_PLACES}, wt AS (SELECT a AS src, b AS dst, count(*) AS weight FROM pl GROUP BY ALL),
        hp AS MATERIALIZED (SELECT * FROM wt QUALIFY row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) = 1),
        up AS (SELECT dst AS id, src AS above FROM hp UNION SELECT up.id, hp.src FROM up JOIN hp ON hp.dst = up.above),
        cy AS (SELECT id, (SELECT min(above) FROM up y WHERE y.id = x.id) AS cycle FROM up x WHERE id = above),
        op AS (SELECT hp.dst FROM hp JOIN cy ON cy.id = hp.dst QUALIFY row_number() OVER (PARTITION BY cycle ORDER BY weight, hp.dst) = 1)
        SELECT src, dst, weight FROM hp WHERE dst NOT IN (SELECT dst FROM op)""",
    "branching_violations": "SELECT 0 AS id, '' AS what WHERE false",
    "place_distances": f"""WITH RECURSIVE {_PLACES} {graph._ENDPOINTS}, e AS MATERIALIZED (SELECT DISTINCT a, b FROM pl),
        go AS (SELECT qid, src_v AS v, 0 AS n, [src_v] AS front, [src_v] AS seen, dst_v FROM ep
            UNION ALL SELECT qid, v, n + 1, nf, list_concat(seen, nf), dst_v FROM (
                SELECT *, list_filter((SELECT list(DISTINCT b) FROM e WHERE list_contains(front, a)), lambda x: NOT list_contains(seen, x)) AS nf FROM go WHERE NOT list_contains(seen, dst_v)) WHERE len(nf) > 0)
        SELECT qid, CAST(coalesce(min(n) FILTER (list_contains(front, dst_v)), -1) AS BIGINT) AS hops FROM go GROUP BY qid""",
    "place_closure": f"WITH RECURSIVE {_PLACES}, c AS (SELECT DISTINCT a, b FROM pl UNION SELECT c.a, pl.b FROM c JOIN pl ON pl.a = c.b) SELECT a AS id, count(*) AS n_reached FROM c GROUP BY a",
}
