"""The slot graph and its queries: micro graphs for each rule, and random graphs against brute force."""

import random
from types import SimpleNamespace

import pytest
from graph_brute import INF, answer, graph, wedge
from pyspark.sql import functions as F

from wayspan.operators import dag, fragments as fr, graphs, reach
from wayspan.plans import graph as graph_plans, structure
from wayspan.session import cut

VISIT = "u bigint, v bigint, ts bigint, te bigint"
QUERY = "qid bigint, u bigint, w bigint, q_start bigint, q_end bigint"


def built(spark, visits, drop_touching=False):
    i = SimpleNamespace(visits=cut(dag.clip_visits(spark.createDataFrame(visits, VISIT))))
    meeting = cut(dag.meeting_visits(i.visits, drop_touching)[0])
    i.slots = cut(dag.slots(meeting))
    i.moves = cut(dag.moves(dag.with_last_slot(meeting, i.slots)))
    i.meeting = i.moves.select("u", "v", "ts", "te", "c_start", "c_end", "last_start")
    return i


def ask(spark, i, queries, delta=INF):
    q = spark.createDataFrame([(k, *x) for k, x in enumerate(queries)], QUERY)
    got = reach.reachable(q, dag.with_runs(i.moves, delta), reach.endpoints(q, i.meeting, i.slots))
    return [r["reachable"] for r in got.orderBy("qid").collect()]


def ask_wedge(spark, i, queries):
    q = spark.createDataFrame([(k, *x) for k, x in enumerate(queries)], QUERY)
    return [r["reachable"] for r in reach.wedge_reachable(q, i.visits, 7).orderBy("qid").collect()]


T = [(0, 0, 1, 5), (1, 0, 4, 10), (2, 0, 9, 12)]
MOVE = [(0, 0, 0, 10), (1, 0, 5, 10), (1, 1, 20, 30), (2, 1, 25, 35)]


def test_spread_within_one_long_visit(spark):
    i = built(spark, T)
    assert sorted((r["slot_start"], r["slot_end"]) for r in i.slots.collect()) == [(1, 4), (4, 5), (5, 9), (9, 10), (10, 12)]
    queries = [(0, 2, 0, 20), (0, 1, 4, 5), (0, 1, 5, 9), (2, 0, 0, 20), (0, 0, 0, 20), (0, 2, 0, 9), (0, 2, 0, 10), (0, 2, 20, 0), (0, None, 0, 20), (0, 77, 0, 20), (0, 2, 0, None)]
    assert ask(spark, i, queries) == [True, True, False, False, True, False, True, False, False, False, False]
    assert ask_wedge(spark, i, queries)[:7] == [False, False, False, False, True, False, False]


def test_touching_visits_part_and_the_old_defect_drops_them(spark):
    visits = [(0, 0, 1, 5), (1, 0, 3, 5), (2, 0, 5, 9), (3, 0, 6, 8)]
    assert ask(spark, built(spark, visits), [(2, 3, 0, 20), (0, 1, 0, 20), (0, 3, 0, 20)]) == [True, True, False]
    assert ask(spark, built(spark, visits, True), [(2, 3, 0, 20), (0, 1, 0, 20), (0, 3, 0, 20)]) == [False, True, False]


def test_moves_and_latency(spark):
    i = built(spark, MOVE)
    queries = [(0, 2, 0, 40), (0, 2, 0, 25), (0, 2, 0, 26), (2, 0, 0, 40)]
    assert ask(spark, i, queries) == [True, False, True, False]
    assert ask(spark, i, queries, 15) == [True, False, True, False]
    assert ask(spark, i, queries, 14) == [False] * 4
    assert ask_wedge(spark, i, queries) == [True, False, False, False]
    alone = built(spark, [*MOVE, (1, 2, 12, 14)])
    assert sorted(map(tuple, dag.edges(alone.slots, alone.moves).collect())) == sorted(map(tuple, dag.edges(i.slots, i.moves).collect()))


def test_two_visits_in_one_component(spark):
    i = built(spark, [(0, 0, 0, 20), (1, 0, 2, 4), (1, 0, 10, 12)])
    assert ask(spark, i, [(0, 1, 0, 20), (1, 0, 0, 20), (1, 0, 5, 9), (0, 1, 5, 9)], 0) == [True, True, False, False]


def test_clipping(spark, rows):
    data = [(1, 1, 0, 10), (1, 2, 5, 8), (1, 3, 5, 9), (1, 4, 8, 8), (None, 1, 0, 5), (1, 5, 200_000, 200_010), (2, 1, 3, None), (1, 1, 0, 10)]
    assert rows(dag.clip_visits(spark.createDataFrame(data, VISIT))) == [(1, 1, 0, 5), (1, 3, 5, 9), (1, 5, 200_000, 200_010)]
    assert built(spark, []).slots.count() == 0


def drawn(seed):
    r = random.Random(seed)
    out = []
    for u in range(6):
        t = 0
        for _ in range(4):
            t += r.randint(0, 5)
            d = r.randint(1, 7)
            out.append((u, r.randint(0, 2), t, t + d))
            t += d
    queries = [(r.randint(0, 6), r.randint(0, 5), *sorted((r.randint(0, 40), r.randint(0, 45)))) for _ in range(60)]
    return out, queries


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    visits, queries = drawn(seed)
    i = built(spark, visits)
    for delta in (INF, 6) if seed else (INF, 3, 12):
        g = graph(visits, delta)
        edges = dag.edges(i.slots, i.moves, delta)
        assert {((a, b), (c, d)) for a, b, c, d, _ in edges.collect()} == g[1]
        want = [answer(g, *q) for q in queries]
        assert ask(spark, i, queries, delta) == want
    assert ask_wedge(spark, i, queries) == [wedge(visits, *q) for q in queries]


@pytest.mark.parametrize("k", [1, 2, 8])
def test_fragments_answer_alike(spark, k):
    visits, queries = drawn(7)
    i = built(spark, visits)
    frag = cut(fr.fragments(i.slots, k))
    edge = cut(fr.with_fragments(dag.edges(i.slots, i.moves), frag))
    q = spark.createDataFrame([(n, *x) for n, x in enumerate(queries)], QUERY)
    yes = {r[0] for r in fr.contracted_reach(reach.endpoints(q, i.meeting, i.slots), frag, edge, cut(fr.classes(frag, edge))).collect()}
    g = graph(visits)
    assert [n in yes for n in range(len(queries))] == [answer(g, *x) for x in queries]
    assert edge.where("src_frag > dst_frag").count() == 0


def test_labels(spark):
    visits, _ = drawn(9)
    i = built(spark, visits)
    frag = cut(fr.fragments(i.slots, 1))
    edge = cut(fr.with_fragments(dag.edges(i.slots, i.moves), frag))
    slot, edges, _ = graph(visits)
    reached = {s: {s} for s in slot}
    for s in sorted(slot, key=lambda s: -s[1]):
        for a, b in edges:
            if a == s:
                reached[s] |= reached[b]
    assert {(r["v"], r["slot_start"]): r["n_reached"] for r in fr.local_closure(frag, edge).collect()} == {s: len(x) for s, x in reached.items()}
    level = {(r["v"], r["slot_start"]): (r["up"], r["down"]) for r in fr.levels(frag, edge).collect()}
    assert all(level[a][0] < level[b][0] and level[a][1] > level[b][1] for a, b in edges)
    labels = fr.chain_labels(frag, edge, 5)
    pairs = labels.alias("x").crossJoin(labels.alias("y")).select("x.v", "x.slot_start", F.col("y.v").alias("v2"), F.col("y.slot_start").alias("t2"), fr.labels_meet("x.lout", "y.lin").alias("yes"))
    for v, t, v2, t2, yes in pairs.collect():
        if yes and t <= t2:
            assert (v2, t2) in reached[(v, t)]


@pytest.mark.parametrize("width, run", [(65_536, 16_384), (8, 4), (5, 3), (4, 9)])
def test_whole_closure_crosses_every_border(spark, width, run):
    visits, _ = drawn(9)
    i = built(spark, visits)
    slot, edges, _ = graph(visits)
    reached = {s: {s} for s in slot}
    for s in sorted(slot, key=lambda s: -s[1]):
        for a, b in edges:
            if a == s:
                reached[s] |= reached[b]
    assert max(map(len, reached.values())) > 8
    got = fr.whole_closure(i.slots, dag.edges(i.slots, i.moves), width, run).collect()
    assert len(got) == len(slot) and {(r["v"], r["slot_start"]): r["n_reached"] for r in got} == {s: len(x) for s, x in reached.items()}
    assert fr.whole_closure(i.slots.limit(0), dag.edges(i.slots, i.moves).limit(0), width, run).count() == 0


def test_closure_query_is_whole(spark, tmp_path):
    visits, _ = drawn(9)
    visits = list({(u, ts): (u, v, ts, te) for u, v, ts, te in visits}.values())
    spark.createDataFrame(visits, VISIT).write.parquet(f"{tmp_path}/visit.parquet")
    slot, edges, _ = graph(visits)
    reached = {s: {s} for s in slot}
    for s in sorted(slot, key=lambda s: -s[1]):
        for a, b in edges:
            if a == s:
                reached[s] |= reached[b]
    got = structure.transitive_closure(spark, str(tmp_path)).collect()
    assert {(r["v"], r["slot_start"]): r["n_reached"] for r in got} == {s: len(x) for s, x in reached.items()}


def test_general_graphs(spark, rows):
    r = random.Random(3)
    edges = [(r.randint(0, 25), r.randint(0, 25)) for _ in range(24)] + [(None, 1)]
    edges += edges[:5] + [(100 + k, 101 + k) for k in range(6)]
    nodes = [(k,) for k in range(28)]
    e, n = spark.createDataFrame(edges, "a bigint, b bigint"), spark.createDataFrame(nodes, "id bigint")
    out = {}
    for a, b in edges:
        if a is not None:
            out.setdefault(a, set()).add(b)

    def reached(x, links):
        seen, stack = {x}, [x]
        while stack:
            for y in links.get(stack.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        return seen

    both = {}
    for a, bs in out.items():
        for b in bs:
            both.setdefault(a, set()).add(b)
            both.setdefault(b, set()).add(a)
    ids = sorted({k for k, in nodes} | set(both))
    assert rows(graphs.weak_components(n, e)) == [(k, min(reached(k, both))) for k in ids]
    far = {k: reached(k, out) for k in ids}
    assert rows(graphs.strong_components(n, e)) == [(k, min(x for x in far[k] if k in far[x])) for k in ids]
    closed = sorted({(k, x) for k in ids for y in out.get(k, ()) for x in far[y]})
    assert rows(graphs.transitive_closure(e)) == closed


def test_temporal_paths(spark, rows):
    edges = spark.createDataFrame([(1, 2, 10, 5), (1, 2, 12, 1), (2, 3, 15, 5), (2, 3, 13, 20), (3, 1, 21, 1), (2, None, 1, 1), (1, 3, 11, -4)], "src bigint, dst bigint, depart bigint, duration bigint")
    ask_ = spark.createDataFrame([(0, 1, 10, 40), (1, 1, 13, 40), (2, 1, 10, 19), (3, None, 0, 9)], "qid bigint, source bigint, t_start bigint, t_end bigint")
    assert rows(reach.earliest_arrival(ask_, edges)) == [(0, 1, 10), (0, 2, 13), (0, 3, 20), (1, 1, 13), (2, 1, 10), (2, 2, 13)]
    assert rows(reach.fastest(ask_, edges)) == [(0, 2, 1), (0, 3, 8), (2, 2, 1)]
    nodes, links = graphs.split_graph(edges)
    assert (2, 13, "arrive", 2, 13, "start", "wait") in rows(links) and nodes.count() == 10


def test_windows_that_reach_far(spark):
    i = built(spark, MOVE)
    far = 10**15
    queries = [(0, 2, -far, far), (0, 2, 0, far), (2, 0, -far, far), (0, 2, far, 2 * far), (0, 2, -2 * far, -far), (0, 2, -(2**62), 2**62)]
    assert ask(spark, i, queries) == [True, True, False, False, False, True]
    assert ask_wedge(spark, i, queries) == [True, True, False, False, False, True]
    edges = spark.createDataFrame([(1, 2, 10, 5), (2, 3, 15, 5)], "src bigint, dst bigint, depart bigint, duration bigint")
    q = spark.createDataFrame([(0, 1, -far, far)], "qid bigint, source bigint, t_start bigint, t_end bigint")
    assert [r["arrival"] for r in reach.earliest_arrival(q, edges).orderBy("vertex").collect()] == [-far, 15, 20]
    assert [r["seconds"] for r in reach.fastest(q, edges).orderBy("vertex").collect()] == [5, 10]


def test_latest_departures(spark, rows):
    r = random.Random(6)
    data = [(r.randint(0, 5), r.randint(0, 5), r.randint(0, 60), r.randint(0, 9)) for _ in range(60)]
    edges = spark.createDataFrame(data, "src bigint, dst bigint, depart bigint, duration bigint")
    asks = [(k, r.randint(0, 6), *sorted((r.randint(0, 70), r.randint(0, 70)))) for k in range(8)]
    q = spark.createDataFrame(asks, "qid bigint, target bigint, t_start bigint, t_end bigint")
    want = []
    for k, target, low, high in asks:
        best = {target: high}
        for _ in range(len(data)):
            for a, b, t, n in data:
                if b in best and t + n <= best[b] and t >= low and t > best.get(a, -1):
                    best[a] = t
        want += [(k, v, t) for v, t in best.items()]
    assert rows(reach.latest_departure(q, edges)) == sorted(want)
    within = lambda x, low, high: [t for t in x if low <= t <= high]
    first = [(k, min(within([t for a, _, t, _ in data if a == v], low, high), default=None), max(within([t + n for _, b, t, n in data if b == v], low, high), default=None)) for k, v, low, high in asks]
    assert rows(reach.first_departures(q.withColumnRenamed("target", "source"), edges)) == sorted(x for x in first if x[1:] != (None, None))


def test_label_tests_decide_every_query(spark, tmp_path):
    visits, queries = drawn(9)
    d = str(tmp_path)
    spark.createDataFrame(visits, VISIT).write.parquet(f"{d}/visit.parquet")
    spark.createDataFrame([(n, *x) for n, x in enumerate(queries)], QUERY).write.parquet(f"{d}/span_query.parquet")
    ends = {r["qid"] for r in graph_plans.query_endpoints(spark, d).collect()}
    got = structure.label_tests(spark, d).collect()
    g = graph(visits)
    assert len(got) == len(ends) and {r["qid"] for r in got} == ends
    assert all(r["verdict"] in ("same", "yes", "no") and (r["verdict"] != "no") == answer(g, *queries[r["qid"]]) for r in got)
    assert {"labels", "order", "classes", "reach"} >= {r["told_by"] for r in got} > {"labels"}


def test_fastest_query_takes_whole_windows(spark, rows, tmp_path):
    visits, queries = drawn(9)
    visits = [(u, v, ts * 3_600, te * 3_600) for u, v, ts, te in visits]
    queries = [(n, u, w, a * 3_600, b * 3_600) for n, (u, w, a, b) in enumerate(queries)]
    d = str(tmp_path)
    spark.createDataFrame(visits, VISIT).write.parquet(f"{d}/visit.parquet")
    spark.createDataFrame(queries, QUERY).write.parquet(f"{d}/span_query.parquet")
    travel = [tuple(r) for r in graph_plans._travel(spark, d).collect()]
    want = []
    for q, source, start, end in graph_plans._sources(spark, d).select("qid", "source", "t_start", "t_end").collect():
        best = {}
        for leave in {t for a, _, t, _ in travel if a == source and start <= t <= end}:
            seen, stack = set(), [(source, leave)]
            while stack:
                at, t = stack.pop()
                for a, b, depart, duration in travel:
                    # the first leg leaves at the time itself
                    ok = depart == leave if not seen and (at, t) == (source, leave) else depart >= t
                    if a == at and ok and depart + duration <= end and (b, depart + duration) not in seen:
                        stack.append((b, depart + duration))
                seen.add((at, t))
            for b, t in seen:
                if b != source:
                    best[b] = min(t - leave, best.get(b, t - leave))
        if best:
            want.append((q, len(best), sum(best.values()), min(best.values())))
    assert any(x[3] > 7_200 for x in want)
    assert rows(graph_plans.fastest(spark, d)) == sorted(want)


def test_least_fragments(spark):
    visits, _ = drawn(11)
    i = built(spark, visits)
    edges = dag.edges(i.slots, i.moves)
    slot, links, _ = graph(visits)
    order = {s: k for k, s in enumerate(sorted(slot, key=lambda s: (s[1], slot[s][0], s[0])))}

    def fits(k):
        size = -(-len(slot) // k)
        found = {b for a, b in links if order[a] // size != order[b] // size}
        return bool(found) and size <= 8 * len(found)

    k = fr.least_fragments(i.slots, edges, 8)
    assert fits(k) and not (k > 1 and fits(k - 1))


def test_least_fragments_beyond_the_first_upper_end(spark):
    slot = spark.range(1_000).selectExpr("0L AS v", "id AS slot_start", "id + 1 AS slot_end")
    edge = spark.range(999).selectExpr("0L AS src_v", "id AS src_start", "0L AS dst_v", "id + 1 AS dst_start")
    assert fr.least_fragments(slot, edge, 4) == 12
    assert fr.least_fragments(slot.limit(20), edge.limit(0), 4) is None
    assert fr.least_fragments(slot.limit(0), edge.limit(0), 4) is None
