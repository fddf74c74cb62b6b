"""Operators on general graphs: components, closures, successor sets, event graphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wayspan.operators.blocks import with_next, with_rank, with_running_max
from wayspan.session import cut, drop, small

MOST_ROUNDS = 200
#: Bytes of bitsets that a task of reach_counts holds, and numbers that it packs into a row.
REACH_BYTES, REACH_RUN = 64 << 20, 65_536


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label: the least id of each node's weakly connected component.

    nodes: id; edges: a, b, of any orderable type. Edges with nulls are left out, ids only in edges
    are nodes as well. Alternates between linking larger neighbours and linking smaller ones to the
    least neighbour, which ends in stars after about log^2 rounds, whatever the diameter; rows never
    exceed twice the edges.
    """
    both = lambda e: e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    given = edges.select("a", "b").dropna()
    known = nodes.select("id").dropna().unionAll(given.select(F.col("a").alias("id"))).unionAll(given.select(F.col("b").alias("id"))).distinct()
    state = cut(given.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(MOST_ROUNDS):
        around = both(state)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = cut(around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m").unionAll(least.select(F.col("a").alias("x"), "m"))
        new = cut(small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())
        same = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        state = new
        if same:
            least = state.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label"))
            return known.join(least, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    raise RuntimeError("no fixpoint was reached")


def transitive_closure(edges: DataFrame, most_rows: int = 50_000_000) -> DataFrame:
    """a, b for all pairs with a path from a to b, by path doubling; edges: a, b, distinct, nulls left out.

    The result grows with the square of the nodes: it is an error if it would exceed most_rows.
    """
    state = cut(edges.select("a", "b").dropna().distinct())
    n = state.count()
    while True:
        two = state.join(state.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        state = cut(state.unionByName(two).distinct())
        m = state.count()
        if m > most_rows:
            raise ValueError("the closure is too large")
        if m == n:
            return state
        n = m


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label: the least id of each node's strongly connected component.

    Colours spread forward as least ids; nodes that reach their colour's owner backward within the
    colour form its component and leave; the rest goes on until none is left.
    """
    given = cut(edges.select("a", "b").dropna().where("a <> b").distinct())
    left = cut(nodes.select("id").dropna().unionAll(given.select(F.col("a").alias("id"))).unionAll(given.select(F.col("b").alias("id"))).distinct())
    done = None
    for _ in range(MOST_ROUNDS):
        if left.isEmpty():
            return done if done is not None else left.select("id", F.col("id").alias("label"))
        color = cut(left.select("id", F.col("id").alias("c")))
        while True:
            step = given.join(color.select(F.col("id").alias("a"), "c"), "a").groupBy(F.col("b").alias("id")).agg(F.min("c").alias("n"))
            new = cut(color.join(step, "id", "left").select("id", F.least("c", F.coalesce("n", "c")).alias("c"), (F.col("n") < F.col("c")).alias("ch")))
            moved = not new.where("ch").isEmpty()
            color = new.select("id", "c")
            if not moved:
                break
        inner = cut(given.join(color.select(F.col("id").alias("a"), "c"), "a").join(color.select(F.col("id").alias("b"), F.col("c").alias("d")), "b").where("c = d").select("a", "b", "c"))
        back = fresh = cut(color.where("id = c"))
        while not fresh.isEmpty():
            step = inner.join(fresh.select(F.col("id").alias("b")), "b").select(F.col("a").alias("id"), "c").distinct()
            fresh = cut(step.join(back, "id", "left_anti"))
            back = cut(back.unionByName(fresh))
        here = back.select("id", F.col("c").alias("label"))
        done = here if done is None else cut(done.unionByName(here))
        left = cut(left.join(back, "id", "left_anti"))
        given = cut(given.join(left.select(F.col("id").alias("a")), "a", "left_semi").join(left.select(F.col("id").alias("b")), "b", "left_semi"))
    raise RuntimeError("no fixpoint was reached")


def reach_counts(edges: DataFrame, most_bytes: int = REACH_BYTES) -> DataFrame:
    """id, n_reached: how many nodes each node with an out-edge leads to, itself where it lies on a cycle; edges: a, b, nulls left out.

    No pairs are made: nodes of one strongly connected component lead to the same nodes, so it is components
    that are counted, by their sizes. Targets are taken by blocks of components, a bit each, as many as
    most_bytes has room for; the task of a block sees all edges between components. The work grows with the
    square of the components, not of the nodes.
    """
    given = cut(edges.select("a", "b").dropna().distinct())
    ids = given.select(F.col("a").alias("id")).unionAll(given.select(F.col("b").alias("id"))).distinct()
    strong = cut(strong_components(ids, given))
    loops = given.where("a = b").select(F.col("a").alias("id"), F.lit(1).alias("_loop"))
    size = strong.join(loops, "id", "left").groupBy("label").agg(F.count("*").alias("size"), F.count("_loop").alias("_loops"))
    ranked = cut(with_rank(size.select("label", "size", ((F.col("size") > 1) | (F.col("_loops") > 0)).cast("int").alias("cyclic")), ["label"]))
    m = ranked.count()
    links = condensation(given, strong).join(ranked.select(F.col("label").alias("src"), F.col("rank").alias("x")), "src").join(ranked.select(F.col("label").alias("dst"), F.col("rank").alias("y")), "dst")
    rows = ranked.select(F.lit("node").alias("row"), F.col("rank").alias("x"), (F.col("size") * 2 + F.col("cyclic")).alias("y")).unionByName(links.select(F.lit("link").alias("row"), "x", "y"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "x": [pdf["x"].to_numpy("int64").tobytes()], "y": [pdf["y"].to_numpy("int64").tobytes()]})

    packed = cut(rows.groupBy("row", F.floor(F.col("x") / F.lit(REACH_RUN)).alias("_run")).applyInPandas(pack, "row string, x binary, y binary"))
    width = 64 * max(1, min(-(-m // 64), most_bytes // 8 // max(1, m)))
    blocks = edges.sparkSession.range(-(-m // width)).withColumnRenamed("id", "block")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        held = {row: [np.concatenate([np.frombuffer(b, np.int64) for b in g[c]]) for c in ("x", "y")] for row, g in pdf.groupby("row")}
        rank, what = held["node"]
        what = what[np.argsort(rank)]
        n = _reached_sizes(*held.get("link", [np.zeros(0, np.int64)] * 2), what >> 1, what & 1, int(pdf["block"].iloc[0]) * width, width)
        at = n.nonzero()[0]
        return pd.DataFrame({"rank": at, "n": n[at]}, dtype="int64")

    sums = blocks.crossJoin(small(packed)).groupBy("block").applyInPandas(count, "rank bigint, n bigint").groupBy("rank").agg(F.sum("n").alias("n_reached"))
    return strong.join(ranked.join(sums, "rank").select("label", "n_reached"), "label").select("id", "n_reached")


def _reached_sizes(src: np.ndarray, dst: np.ndarray, size: np.ndarray, cyclic: np.ndarray, low: int, width: int) -> np.ndarray:
    """For each component of an acyclic graph of components: the nodes of those in [low, low + width) that it leads to, its own only if it is cyclic."""
    m = len(size)
    order = np.argsort(src, kind="stable")
    kids, start = dst[order], np.searchsorted(src[order], np.arange(m + 1))
    order = np.argsort(dst, kind="stable")
    parents, first = src[order], np.searchsorted(dst[order], np.arange(m + 1)).tolist()
    left = np.diff(start)
    free = np.flatnonzero(left == 0).tolist()
    left = left.tolist()
    bits = np.zeros((m, width // 64), np.uint64)
    while free:
        i = free.pop()
        if start[i] < start[i + 1]:
            np.bitwise_or.reduce(bits[kids[start[i] : start[i + 1]]], axis=0, out=bits[i])
        if low <= i < low + width:
            bits[i, (i - low) >> 6] |= np.uint64(1 << ((i - low) & 63))
        for p in parents[first[i] : first[i + 1]].tolist():
            left[p] -= 1
            if not left[p]:
                free.append(p)
    out = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    here = np.arange(low, min(low + width, m))
    for c in here[size[here] > 1].tolist():
        out += ((bits[:, (c - low) >> 6] >> np.uint64((c - low) & 63)) & np.uint64(1)).astype(np.int64) * (size[c] - 1)
    alone = here[cyclic[here] == 0]
    out[alone] -= size[alone]
    return out


def successor_classes(edges: DataFrame, hops: int = 1) -> DataFrame:
    """n_members, n_classes: how many classes of nodes share one set of successors at most `hops` away, by class size.

    edges: a, b (structs or numbers). Nodes without successors don't count.
    """
    given = edges.select("a", "b").dropna().distinct()
    reach = given
    for _ in range(hops - 1):
        reach = reach.unionByName(reach.select("a", F.col("b").alias("m")).join(given.select(F.col("a").alias("m"), "b"), "m").select("a", "b")).distinct()
    sets = reach.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("s"))
    return sets.groupBy("s").agg(F.count("*").alias("n_members")).groupBy("n_members").agg(F.count("*").alias("n_classes"))


def split_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Event nodes and edges of a temporal graph src, dst, depart, duration.

    Nodes: vertex, time, kind (arrive or start). Edges: from_v, from_t, from_kind, to_v, to_t, to_kind,
    link: chain (to the next of its kind at the vertex), wait (an arrival to the first start at or after
    it) and travel. Nulls and negative durations are left out.
    """
    edge = edges.select("src", "dst", "depart", "duration").dropna().where("duration >= 0").distinct()
    starts = edge.select(F.col("src").alias("vertex"), F.col("depart").alias("time")).distinct()
    arrivals = edge.select(F.col("dst").alias("vertex"), (F.col("depart") + F.col("duration")).alias("time")).distinct()
    nodes = starts.withColumn("kind", F.lit("start")).unionByName(arrivals.withColumn("kind", F.lit("arrive")))

    def link(rows: DataFrame, to: str, from_kind: str, to_kind: str, name: str) -> DataFrame:
        return rows.select(F.col("vertex").alias("from_v"), F.col("time").alias("from_t"), F.lit(from_kind).alias("from_kind"), F.col("vertex").alias("to_v"), F.col(to).alias("to_t"), F.lit(to_kind).alias("to_kind"), F.lit(name).alias("link"))

    chains = [link(with_next(x, ["vertex"], "time", {"_then": "time"}).where("_then IS NOT NULL"), "_then", k, k, "chain") for x, k in ((starts, "start"), (arrivals, "arrive"))]
    events = nodes.groupBy("vertex", "time").agg(F.max((F.col("kind") == "start").cast("int")).alias("s"), F.max((F.col("kind") == "arrive").cast("int")).alias("a"))
    events = events.withColumn("_back", -F.col("time"))
    events = with_running_max(events, ["vertex"], "_back", F.when(F.col("s") == 1, F.col("_back")), "_next").withColumn("_then", -F.col("_next"))
    waits = link(events.where("a = 1 AND _then IS NOT NULL"), "_then", "arrive", "start", "wait")
    travel = edge.select(F.col("src").alias("from_v"), F.col("depart").alias("from_t"), F.lit("start").alias("from_kind"), F.col("dst").alias("to_v"), (F.col("depart") + F.col("duration")).alias("to_t"), F.lit("arrive").alias("to_kind"), F.lit("travel").alias("link"))
    return nodes, chains[0].unionByName(chains[1]).unionByName(waits).unionByName(travel)


def heaviest_parents(edges: DataFrame) -> DataFrame:
    """Each vertex's in-edge of greatest weight, ties by the least source: src, dst, weight."""
    rows = edges.select("src", "dst", "weight").dropna().where("src <> dst")
    return rows.groupBy("dst").agg(F.max(F.struct("weight", (-F.col("src")).alias("s"))).alias("x")).select((-F.col("x.s")).alias("src"), "dst", F.col("x.weight").alias("weight"))


def condensation(edges: DataFrame, components: DataFrame) -> DataFrame:
    """src, dst, n_edges between different components: edges a, b with their ends replaced by the labels of components (id, label)."""
    given = edges.select("a", "b").dropna().distinct()
    ends = given.join(components.select(F.col("id").alias("a"), F.col("label").alias("src")), "a").join(components.select(F.col("id").alias("b"), F.col("label").alias("dst")), "b")
    return ends.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n_edges"))


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, level: the edges of the longest path that leads to each node of an acyclic graph; by level, edges ascend.

    nodes: id; edges: src, dst. Takes a round for each level: the nodes all of whose predecessors
    have left leave with their out-edges. A graph with a cycle is an error.
    """
    given = cut(edges.select("src", "dst").dropna().distinct())
    left = cut(nodes.select("id").dropna().unionAll(given.select(F.col("src").alias("id"))).unionAll(given.select(F.col("dst").alias("id"))).distinct())
    done, level = None, 0
    while not left.isEmpty():
        free = cut(left.join(given.select(F.col("dst").alias("id")), "id", "left_anti"))
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        here = free.select("id", F.lit(level).cast("bigint").alias("level"))
        done = here if done is None else done.unionByName(here)
        old = left, given
        left = cut(left.join(free, "id", "left_anti"))
        given = cut(given.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
        drop(*old)
        level += 1
    return done if done is not None else left.select("id", F.lit(0).cast("bigint").alias("level"))


def cycles_of_parents(parents: DataFrame) -> DataFrame:
    """id, cycle: the nodes on cycles of a graph in which each dst has at most one src; cycle is the least id of each.

    Pointers are doubled, so it takes about log2 of the nodes in rounds: what is still met after as
    many steps as there are nodes lies on a cycle, and so does the least id met on the way from there.
    """
    up = cut(parents.select(F.col("dst").alias("id"), F.col("src").alias("to")))
    n = up.count()
    jump, steps = up, 1
    while steps < n:
        jump = cut(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("_to")), "to").select("id", F.col("_to").alias("to")))
        steps *= 2
    on = cut(jump.select(F.col("to").alias("id")).distinct())
    ring = cut(up.join(on, "id").select("id", "to", F.least("id", "to").alias("least")))
    size, steps = ring.count(), 1
    while steps < size:
        ring = cut(ring.join(ring.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least")), "to").select("id", F.col("_to").alias("to"), F.least("least", "_least").alias("least")))
        steps *= 2
    return ring.select("id", F.col("least").alias("cycle"))


def branching(edges: DataFrame) -> DataFrame:
    """src, dst, weight: the heaviest in-edge of each vertex, less the lightest edge of each cycle these form (ties: the least dst).

    edges: src, dst, weight. No vertex has two in-edges and there is no cycle, so it is a branching, by
    the greedy rule; opening a cycle elsewhere may weigh more.
    """
    parents = cut(heaviest_parents(edges))
    on = cycles_of_parents(parents)
    ring = parents.join(on.select(F.col("id").alias("dst"), "cycle"), "dst")
    lightest = ring.groupBy("cycle").agg(F.min(F.struct("weight", "dst")).alias("x")).select(F.col("x.dst").alias("dst"))
    return parents.join(lightest, "dst", "left_anti").select("src", "dst", "weight")


def branching_violations(edges: DataFrame) -> DataFrame:
    """id, what: vertices with more than one in-edge (parents), and vertices on a cycle (cycle); none for a branching."""
    many = edges.groupBy("dst").agg(F.count("*").alias("n")).where("n > 1").select(F.col("dst").alias("id"), F.lit("parents").alias("what"))
    single = edges.groupBy("dst").agg(F.min("src").alias("src"))
    return many.unionByName(cycles_of_parents(single).select("id", F.lit("cycle").alias("what")))


def distances(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """qid, hops: edges of a shortest path from source to target of each pair; null where there is none.

    pairs: qid (unique), source, target; edges: a, b. Both ends grow, in each round the side with the
    fewer rows on its front, until they meet; a pair that met, or whose front is empty on a side, stops.
    """
    ask = cut(pairs.select("qid", "source", "target").dropna().distinct())
    given = cut(edges.select("a", "b").dropna().distinct())
    back = given.select(F.col("b").alias("a"), F.col("a").alias("b"))
    seen = {s: [cut(ask.select("qid", F.col(c).alias("id"), F.lit(0).alias("n")))] for s, c in (("to", "source"), ("from", "target"))}
    met = [cut(ask.where("source = target").select("qid", F.lit(0).alias("hops")))]
    front = {s: cut(seen[s][0].join(met[0].select("qid"), "qid", "left_anti")) for s in seen}
    for _ in range(MOST_ROUNDS):
        sizes = {s: front[s].count() for s in front}
        if not all(sizes.values()):
            found = met[0]
            for m in met[1:]:
                found = found.unionByName(m)
            return pairs.select("qid").distinct().join(found.groupBy("qid").agg(F.min("hops").cast("bigint").alias("hops")), "qid", "left")
        side = min(sizes, key=sizes.get)
        other = "from" if side == "to" else "to"
        step = front[side].join(given if side == "to" else back, front[side]["id"] == F.col("a")).select("qid", F.col("b").alias("id"), (F.col("n") + 1).alias("n")).distinct()
        had, there = seen[side][0], seen[other][0]
        for more in seen[side][1:]:
            had = had.unionByName(more)
        for more in seen[other][1:]:
            there = there.unionByName(more)
        new = cut(step.join(had.select("qid", "id"), ["qid", "id"], "left_anti"))
        hit = cut(new.join(there.withColumnRenamed("n", "m"), ["qid", "id"]).groupBy("qid").agg(F.min(F.col("n") + F.col("m")).alias("hops")))
        met.append(hit)
        seen[side].append(new)
        done = hit.select("qid")
        alive = new.select("qid").distinct()
        front[side] = cut(new.join(done, "qid", "left_anti"))
        front[other] = cut(front[other].join(done, "qid", "left_anti").join(alive, "qid", "left_semi"))
    raise RuntimeError("the pairs didn't meet")
