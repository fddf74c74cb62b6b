"""Indexes of the slots of a fragment: topological orders, paths, tree covers and their intervals.

All of them hold within a fragment, whose slots a task sees together; fragments bound their number.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wayspan.functions import not_refuted
from wayspan.operators.fragments import chain_labels, contracted_reach, labels_meet, levels, pieces, unpacked
from wayspan.session import cut

_SLOT = "frag bigint, v bigint, slot_start bigint"
#: Columns of a path table that are worked on at a time, each of four bytes a slot.
PATHS_AT_ONCE = 256


def _per_fragment(frag: DataFrame, edge: DataFrame, make, columns: str) -> DataFrame:
    """make(nodes, children) gives a list for each further column, in the order of the nodes."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, children, *_ = unpacked(pdf)
        names = [c.split()[0] for c in columns.split(", ")]
        made = dict(zip(names, make(nodes, children)))
        out = pd.DataFrame({"frag": int(pdf["frag"].iloc[0]), "v": [v for _, v in nodes], "slot_start": [t for t, _ in nodes], **made})
        return out.astype({c: "Int64" for c in out.columns})

    return pieces(frag, edge).groupBy("frag").applyInPandas(kernel, f"{_SLOT}, {columns}")


def orders(frag: DataFrame, edge: DataFrame) -> DataFrame:
    """frag, v, slot_start, first, second, post: two topological orders and a depth-first post-order, from 0.

    first is the order of time. second takes, of the slots whose predecessors are all taken, the one
    with the greatest first, so two slots that don't reach each other tend to stand in other order there.
    post numbers slots as a depth-first walk from the earliest leaves them: what is reached has the lesser one.
    """

    def make(nodes, children):
        n = len(nodes)
        waits = [0] * n
        for kids in children:
            for j in kids:
                waits[j] += 1
        free = [-i for i in range(n) if not waits[i]]
        heapq.heapify(free)
        second, at = [0] * n, 0
        while free:
            i = -heapq.heappop(free)
            second[i], at = at, at + 1
            for j in children[i]:
                waits[j] -= 1
                if not waits[j]:
                    heapq.heappush(free, -j)
        post, at = [-1] * n, 0
        seen = [False] * n
        for root in range(n):
            if seen[root]:
                continue
            seen[root], stack = True, [(root, iter(sorted(children[root])))]
            while stack:
                i, kids = stack[-1]
                j = next((j for j in kids if not seen[j]), None)
                if j is None:
                    post[i], at = at, at + 1
                    stack.pop()
                else:
                    seen[j] = True
                    stack.append((j, iter(sorted(children[j]))))
        return [list(range(n)), second, post]

    return _per_fragment(frag, edge, make, "first bigint, second bigint, post bigint")


def _paths(children: list[list[int]]) -> tuple[list[int], list[int]]:
    """Path and place of each node: every node that is in none opens one, which goes on to its least child in none."""
    path, place, n = [-1] * len(children), [0] * len(children), 0
    for i in range(len(children)):
        if path[i] >= 0:
            continue
        at, k = i, 0
        while at is not None:
            path[at], place[at] = n, k
            at, k = min((j for j in children[at] if path[j] < 0), default=None), k + 1
        n += 1
    return path, place


def path_cover(frag: DataFrame, edge: DataFrame) -> DataFrame:
    """frag, v, slot_start, path, place: disjoint paths of edges that hold every slot of a fragment once, numbered from 0."""
    return _per_fragment(frag, edge, lambda nodes, children: _paths(children), "path bigint, place bigint")


def path_hits(pairs: DataFrame, frag: DataFrame, edge: DataFrame) -> DataFrame:
    """qid of the pairs (qid, f, src_v, src_start, dst_v, dst_start) that reach within their fragment f, by path labels.

    A label is, for each path, the least place a slot leads to, so a look-up answers for good: the target
    is reached if its place is at or after that. Labels are made for PATHS_AT_ONCE paths at a time.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, children, *_ = unpacked(pdf)
        at = {x: i for i, x in enumerate(nodes)}
        asks = pdf[pdf["row"] == "ask"]
        goals = [(int(q), at[(t, av)], at[(bt, bv)]) for q, av, t, bv, bt in zip(asks["qid"], asks["a_v"], asks["a_t"], asks["b_v"].astype("int64"), asks["b_t"].astype("int64"))]
        path, place = _paths(children)
        by: dict[int, list] = {}
        for q, i, j in goals:
            by.setdefault(path[j] // PATHS_AT_ONCE, []).append((q, i, j))
        yes = []
        none = np.iinfo(np.int32).max
        for part, asked in by.items():
            low = part * PATHS_AT_ONCE
            table = np.full((len(nodes), min(PATHS_AT_ONCE, max(path) + 1 - low)), none, np.int32)
            for i in range(len(nodes) - 1, -1, -1):
                for j in children[i]:
                    np.minimum(table[i], table[j], out=table[i])
                if 0 <= path[i] - low < table.shape[1]:
                    table[i, path[i] - low] = min(table[i, path[i] - low], place[i])
            yes += [q for q, i, j in asked if table[i, path[j] - low] <= place[j]]
        return pd.DataFrame({"qid": yes}, dtype="int64")

    asks = pairs.select("qid", F.col("f").alias("frag"), F.lit("ask").alias("row"), F.col("src_v").alias("a_v"), F.col("src_start").alias("a_t"), F.col("dst_v").alias("b_v"), F.col("dst_start").alias("b_t"))
    rows = pieces(frag, edge).join(asks.select("frag").distinct(), "frag", "left_semi").withColumn("qid", F.lit(None).cast("bigint"))
    return rows.unionByName(asks).groupBy("frag").applyInPandas(kernel, "qid bigint")


def tree_cover(frag: DataFrame, edge: DataFrame) -> DataFrame:
    """frag, v, slot_start, parent_v, parent_start, n_before, n_after, pre, last: a tree over each fragment, and its intervals.

    n_before and n_after count the slots that lead to a slot and those it leads to, itself left out. The
    parent is the predecessor with the most before it, ties by (slot_start, v); null for roots. pre numbers
    slots by a depth-first walk, children in order of time; last is the greatest pre below, so
    a slot leads to all whose pre is in [pre, last].
    """

    def make(nodes, children):
        n = len(nodes)
        back, out = [0] * n, [0] * n
        parents: list[list[int]] = [[] for _ in nodes]
        for i in range(n):
            back[i] |= 1 << i
            for j in children[i]:
                back[j] |= back[i]
                parents[j].append(i)
        before = [b.bit_count() - 1 for b in back]
        for i in range(n - 1, -1, -1):
            out[i] |= 1 << i
            for j in children[i]:
                out[i] |= out[j]
        after = [b.bit_count() - 1 for b in out]
        parent = [min(p, key=lambda i: (-before[i], i), default=None) for p in parents]
        kids: list[list[int]] = [[] for _ in nodes]
        roots = []
        for i, p in enumerate(parent):
            (roots if p is None else kids[p]).append(i)
        pre, last, at = [0] * n, [0] * n, 0
        for root in roots:
            stack = [(root, iter(kids[root]))]
            pre[root], at = at, at + 1
            while stack:
                i, rest = stack[-1]
                j = next(rest, None)
                if j is None:
                    last[i] = at - 1
                    stack.pop()
                else:
                    pre[j], at = at, at + 1
                    stack.append((j, iter(kids[j])))
        ends = [None if p is None else nodes[p] for p in parent]
        return [[None if e is None else e[1] for e in ends], [None if e is None else e[0] for e in ends], before, after, pre, last]

    return _per_fragment(frag, edge, make, "parent_v bigint, parent_start bigint, n_before bigint, n_after bigint, pre bigint, last bigint")


def label_table(frag: DataFrame, edge: DataFrame, found: DataFrame) -> DataFrame:
    """Everything that label tests look up, a row for each slot: v, slot_start, frag, lout, lin, up, down, first, second, and its classes out and in."""
    table = chain_labels(frag, edge).join(levels(frag, edge), ["v", "slot_start"]).join(orders(frag, edge), ["v", "slot_start"])
    for side in ("out", "in"):
        table = table.join(found.where(F.col("row") == side).select("v", "slot_start", F.col("class").alias(side)), ["v", "slot_start"])
    return table


def label_verdicts(ends: DataFrame, frag: DataFrame, edge: DataFrame, found: DataFrame, table: DataFrame) -> DataFrame:
    """qid, verdict (same, yes or no) and told_by of the pairs of ends (qid, src_v, src_start, dst_v, dst_start).

    found is the result of classes(), table of label_table(). told_by: labels (the same slot, a common
    chain, or levels and two topological orders that refute it), order (the target lies in an earlier
    fragment), classes (the target lies in a later fragment, and the source leads to no border slot or
    none leads to the target), or reach, a search where those leave it open.
    """
    ends = ends.select("qid", "src_v", "src_start", "dst_v", "dst_start")
    a = table.select(F.col("v").alias("src_v"), F.col("slot_start").alias("src_start"), "lout", *[F.col(c).alias(f"{c}_a") for c in ("up", "down", "first", "second")], F.col("frag").alias("f"), "out")
    b = table.select(F.col("v").alias("dst_v"), F.col("slot_start").alias("dst_start"), "lin", *[F.col(c).alias(f"{c}_b") for c in ("up", "down", "first", "second")], F.col("frag").alias("g"), "in")
    rows = ends.join(a, ["src_v", "src_start"]).join(b, ["dst_v", "dst_start"])
    same = (F.col("src_v") == F.col("dst_v")) & (F.col("src_start") == F.col("dst_start"))
    no = (F.col("up_a") >= F.col("up_b")) | ~not_refuted(*[F.col(c) for c in ("down_a", "down_b", "first_a", "first_b", "second_a", "second_b")])
    within = F.when(same, "same").when(no, "no").when(labels_meet("lout", "lin"), "yes")
    between = F.when((F.col("f") > F.col("g")) | (F.col("out") == 0) | (F.col("in") == 0), "no")
    rows = rows.withColumn("verdict", F.when(F.col("f") == F.col("g"), within).otherwise(between))
    how = F.when(F.col("f") == F.col("g"), "labels").when(F.col("f") > F.col("g"), "order").otherwise("classes")
    rows = cut(rows.select(*ends.columns, "verdict", how.alias("told_by")))
    left = rows.where("verdict IS NULL")
    yes = contracted_reach(left.select(*ends.columns), frag, edge, found).withColumn("_yes", F.lit("yes"))
    left = left.join(yes, "qid", "left").select("qid", F.coalesce("_yes", F.lit("no")).alias("verdict"), F.lit("reach").alias("told_by"))
    return rows.where("verdict IS NOT NULL").select("qid", "verdict", "told_by").unionByName(left)
