"""Indexes of fragments and operators on general graphs against brute force on random graphs."""

import random
import tracemalloc
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayspan.operators import fragments as fr
from wayspan.operators import graphs, labels
from wayspan.session import cut

SLOT = "v bigint, slot_start bigint, slot_end bigint, c_start bigint"
EDGE = "src_v bigint, src_start bigint, dst_v bigint, dst_start bigint"


def drawn_slots(seed, n=60):
    """Slots of a few places, parts of components that are chains, and edges to later ones."""
    r = random.Random(seed)
    slots, edges = [], set()
    for v in range(5):
        t, c = r.randint(0, 5), None
        for _ in range(n // 5):
            if c is None or r.random() < 0.3:
                t += r.randint(1, 4)
                c = t
            else:
                edges.add(((v, slots[-1][1]), (v, t)))
            end = t + r.randint(1, 6)
            slots.append((v, t, end, c))
            t = end
    for _ in range(2 * n):
        a, b = r.choice(slots), r.choice(slots)
        if a[1] < b[1]:
            edges.add((a[:2], b[:2]))
    return slots, sorted(edges)


def reached(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def far(a):
        seen, stack = set(), [a]
        while stack:
            for b in out.get(stack.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        return seen

    return far


@pytest.mark.parametrize("seed,k", [(1, 1), (2, 3), (3, 7)])
def test_indexes(spark, seed, k, monkeypatch):
    monkeypatch.setattr(labels, "PATHS_AT_ONCE", 3)
    slots, edges = drawn_slots(seed)
    frag = cut(fr.fragments(spark.createDataFrame(slots, SLOT), k))
    edge = cut(fr.with_fragments(spark.createDataFrame([(*a, *b) for a, b in edges], EDGE), frag))
    at = {(r["v"], r["slot_start"]): r["frag"] for r in frag.collect()}
    inner = [(a, b) for a, b in edges if at[a] == at[b]]
    far = reached(inner)
    order = {(r["v"], r["slot_start"]): r for r in labels.orders(frag, edge).collect()}
    assert set(order) == set(at)
    for a in at:
        for b in far(a):
            assert order[a]["first"] < order[b]["first"] and order[a]["second"] < order[b]["second"] and order[a]["post"] > order[b]["post"]
    path = {(r["v"], r["slot_start"]): (r["frag"], r["path"], r["place"]) for r in labels.path_cover(frag, edge).collect()}
    where = {x: s for s, x in path.items()}
    assert len(where) == len(at) and all(x[2] == 0 or (where[(*x[:2], x[2] - 1)], s) in inner for s, x in path.items())
    tree = {(r["v"], r["slot_start"]): r for r in labels.tree_cover(frag, edge).collect()}
    before = {b: sum(b in far(a) for a in at) for b in at}
    for s, x in tree.items():
        assert (x["n_before"], x["n_after"]) == (before[s], len(far(s)))
        parents = [a for a, b in inner if b == s]
        want = min(parents, key=lambda a: (-before[a], a[1], a[0]), default=(None, None))
        assert (x["parent_v"], x["parent_start"]) == tuple(want)
        below = [b for b, y in tree.items() if y["frag"] == x["frag"] and x["pre"] < y["pre"] <= x["last"]]
        assert set(below) <= far(s)
    pairs = [(q, *a, *b) for q, (a, b) in enumerate(product(sorted(at), sorted(at))) if at[a] == at[b] and q % 3 == 0]
    ask = spark.createDataFrame([(q, at[(v, t)], v, t, w, u) for q, v, t, w, u in pairs], "qid bigint, f bigint, " + EDGE)
    yes = {q for q, v, t, w, u in pairs if (w, u) in far((v, t)) or (v, t) == (w, u)}
    assert {r["qid"] for r in labels.path_hits(ask, frag, edge).collect()} == yes
    found = cut(fr.classes(frag, edge))
    everything = reached(edges)
    all_pairs = [(q, *a, *b) for q, (a, b) in enumerate(product(sorted(at), sorted(at))) if q % 7 == 0]
    ends = spark.createDataFrame(all_pairs, "qid bigint, " + EDGE)
    want = {q for q, v, t, w, u in all_pairs if (w, u) in everything((v, t)) or (v, t) == (w, u)}
    table = cut(labels.label_table(frag, edge, found))
    assert {r["qid"] for r in labels.label_verdicts(ends, frag, edge, found, table).collect() if r["verdict"] != "no"} == want
    for classes, local in ((found, labels.path_hits), (cut(fr.classes(frag, edge, share=False)), None)):
        assert {r["qid"] for r in fr.contracted_reach(ends, frag, edge, classes, block=50, local=local).collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_branching_and_condensation(spark, rows, seed):
    r = random.Random(seed)
    data = [(r.randint(0, 14), r.randint(0, 14), r.randint(1, 5)) for _ in range(40)]
    weight = {}
    for a, b, w in data:
        weight[(a, b)] = w
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weight.items()], "src bigint, dst bigint, weight bigint")
    parent = {}
    for (a, b), w in weight.items():
        if a != b and (b not in parent or (-w, a) < (-parent[b][1], parent[b][0])):
            parent[b] = (a, w)
    cycles = {}
    for b in parent:
        walk, at = [], b
        while at in parent and at not in walk:
            walk.append(at)
            at = parent[at][0]
        if at == b:
            cycles[b] = min(walk)
    assert dict(map(tuple, graphs.cycles_of_parents(graphs.heaviest_parents(edges)).collect())) == cycles
    opened = {min((parent[b][1], b) for b in cycles if cycles[b] == c)[1] for c in set(cycles.values())}
    got = graphs.branching(edges)
    assert rows(got) == sorted((a, b, w) for b, (a, w) in parent.items() if b not in opened)
    assert graphs.branching_violations(got).count() == 0
    assert {x["what"] for x in graphs.branching_violations(spark.createDataFrame([(1, 2, 1), (2, 1, 1), (5, 2, 1)], "src bigint, dst bigint, weight bigint")).collect()} == {"parents", "cycle"}
    plain = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    strong = cut(graphs.strong_components(plain.select(F.col("a").alias("id")), plain))
    label = {x["id"]: x["label"] for x in strong.collect()}
    want = {}
    for a, b in weight:
        if label[a] != label[b]:
            want[(label[a], label[b])] = want.get((label[a], label[b]), 0) + 1
    links = graphs.condensation(plain, strong)
    assert rows(links) == sorted((*k, n) for k, n in want.items())
    level = dict.fromkeys(label.values(), 0)
    for _ in level:
        for a, b in want:
            level[b] = max(level[b], level[a] + 1)
    assert dict(map(tuple, graphs.topological_levels(strong.select(F.col("label").alias("id")), links).collect())) == level
    with pytest.raises(ValueError):
        graphs.topological_levels(strong.select("id").limit(0), spark.createDataFrame([(1, 2), (2, 1)], "src bigint, dst bigint"))


def test_distances(spark, rows):
    r = random.Random(8)
    edges = {(r.randint(0, 40), r.randint(0, 40)) for _ in range(60)}
    pairs = [(k, r.randint(0, 42), r.randint(0, 42)) for k in range(60)] + [(99, None, 1)]
    want = []
    for k, a, b in pairs:
        seen, front, n = {a}, {a}, 0
        while front and b not in seen:
            front, n = {y for x, y in edges if x in front} - seen, n + 1
            seen |= front
        want.append((k, n if b in seen and a is not None else None))
    got = graphs.distances(spark.createDataFrame(pairs, "qid bigint, source bigint, target bigint"), spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert graphs.distances(spark.createDataFrame([], "qid bigint, source bigint, target bigint"), spark.createDataFrame([(1, 2)], "a bigint, b bigint")).count() == 0


def test_reach_counts(spark, rows):
    r = random.Random(1)
    edges = {(r.randint(0, 9), r.randint(0, 9)) for _ in range(20)} | {(9, 100 + k) for k in range(70)} | {(300, 300), (301, 300)}
    far = reached(sorted(edges))
    want = sorted((a, len(far(a))) for a in {a for a, _ in edges})
    got = graphs.reach_counts(spark.createDataFrame([*edges, *list(edges)[:9], (None, 3), (3, None)], "a bigint, b bigint"), 1)
    assert rows(got) == want


@pytest.mark.parametrize("seed", range(4))
def test_reached_sizes(seed):
    r = random.Random(seed)
    name = r.sample(range(200), 200)
    edges = sorted({tuple(sorted((r.randint(0, 199), r.randint(0, 199)))) for _ in range(260)} | {(k, k + 1) for k in range(90)})
    edges = [(name[a], name[b]) for a, b in edges if a != b]
    size = np.array([r.choice((1, 1, 1, 5)) for _ in range(200)])
    cyclic = np.array([int(s > 1 or r.random() < 0.1) for s in size])
    far = reached(edges)
    want = [sum(int(size[b]) for b in far(a)) + int(size[a] * cyclic[a]) for a in range(200)]
    for width in (64, 128, 256):
        assert sum(graphs._reached_sizes(*np.array(edges).T, size, cyclic, low, width) for low in range(0, 200, width)).tolist() == want


def test_reach_counts_beyond_all_pairs(spark):
    n = 7_500  # more than 50 million pairs
    edges = spark.range(1, n + 1).selectExpr("explode(array(struct(id AS a, 0L AS b), struct(0L AS a, id AS b))) AS x").select("x.*").unionAll(spark.sql("SELECT 1L AS a, -1L AS b"))
    assert [tuple(x) for x in graphs.reach_counts(edges).groupBy("n_reached").count().collect()] == [(n + 2, n + 1)]


def test_contraction_keeps_only_the_sets_it_looks_up(spark):
    slots, edges = drawn_slots(5)
    frag = cut(fr.fragments(spark.createDataFrame(slots, SLOT), 6))
    edge = cut(fr.with_fragments(spark.createDataFrame([(*a, *b) for a, b in edges], EDGE), frag))
    at, everything = sorted({x[:2] for x in slots}, key=lambda x: (x[1], x[0])), reached(edges)
    pairs = [(q, *a, *b) for q, (a, b) in enumerate(product(at[:9], at[-9:]))]
    want = {q for q, v, t, w, u in pairs if (w, u) in everything((v, t)) or (v, t) == (w, u)}
    ends = spark.createDataFrame(pairs, "qid bigint, " + EDGE)
    for share in (True, False):
        found, all_ = fr.asked_classes(ends, frag, edge, share), cut(fr.classes(frag, edge, share))
        assert found.where("bits IS NOT NULL").count() < all_.where("bits IS NOT NULL").count()
        slim = lambda df: sorted(map(tuple, df.where("bits IS NULL").select("row", "frag", "v", "slot_start", "class", "n").collect()))
        assert slim(found) == slim(all_)
        for block in (7, 2_048):
            assert {r["qid"] for r in fr.contracted_reach(ends, frag, edge, found, block=block).collect()} == want


def test_hop_needs_no_matrix_of_entries_and_ghosts():
    """6,000 entries that lead to 60,000 ghosts: as a matrix of numbers 1.4 GB."""
    n, m = 6_000, 60_000
    far = np.zeros(m // 8, np.uint8).tobytes()[:-1] + b"\x80"
    rows = [("lead", None, k, k % 5 + 1, None) for k in range(n)] + [("set", None, c, None, b"\x01" if c < 5 else far) for c in range(1, 6)]
    rows += [("ghost", k, k, 9, None) for k in range(m)] + [("come", 3, None, None, b"\x01"), ("come", 4, None, None, b"\x10"), ("goal", 4, None, None, b"\x10")]
    tracemalloc.start()
    got = fr._hop(pd.DataFrame(rows, columns=["row", "qid", "k", "to_frag", "bits"]))
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert sorted((q, to, int.from_bytes(b, "little")) for q, to, b in got.itertuples(index=False)) == [(3, 9, 1), (4, -1, 0), (4, 9, 1 << (m - 1))]


def test_cut_leaves_no_shuffles(spark):
    held = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = held()
    rows = spark.range(10_000).selectExpr("id % 100 AS k").groupBy("k").count()
    got = cut(rows)
    assert held() <= before
    assert got.count() == rows.count() == 100  # what was cut can be computed again
