"""Many queries over a stream of timed rows, answered in one pass in order of time.

Queries that lie near each other in time make a block, in which each is a lane. A block is one
task: its lanes, then the rows of its span of time as they come from Spark's sort, which spills.
What a task holds is a row of lanes for each vertex that was reached and for what is under way.
"""

from __future__ import annotations

from collections import defaultdict
from heapq import heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wayspan.operators.blocks import by_cells, with_rank
from wayspan.session import cut, small

DAY = 86_400
NEVER, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Rows of a batch of results.
BATCH = 65_536
_COLUMNS = ("t", "a", "b", "c", "d", "e")


def swept(lanes: DataFrame, rows: DataFrame, kernel, schema: str, n_lanes: int, spans: bool = False, width: int = DAY) -> DataFrame:
    """What kernel makes of each block of at most n_lanes lanes.

    lanes: qid, who, goal, start, low, until. rows: t, a, b, till. All BIGINT without nulls. A block gets the
    rows that lie within its span from the least low to the greatest until, or with spans those that overlap it.
    kernel gets the lanes' columns qid, who, goal, start, until, and the rows' t, a, b, till chunk by
    chunk in order of t; it yields tuples of columns. Lanes of like length share a block, so a long window doesn't
    draw out the span of short ones.
    """
    first, last = (x or 0 for x in rows.agg(F.min("t"), F.max("t")).first())
    length = F.least("until", F.lit(last)) - F.greatest("low", F.lit(first))
    lanes = lanes.withColumn("_class", F.ceil(F.log2(F.greatest(length, F.lit(DAY)) / F.lit(DAY)) / 2))
    lane = with_rank(lanes, ["_class", "low", "until", "qid", "who", "goal", "start"])
    lane = cut(lane.withColumn("block", F.floor(F.col("rank") / F.lit(n_lanes)).cast("bigint")))
    n_blocks = (lane.agg(F.max("block")).first()[0] or 0) + 1
    span = lane.groupBy("block").agg(F.greatest(F.min("low"), F.lit(first)).alias("_low"), F.max("until").alias("_until"))
    cells = small(cut(by_cells(span, F.col("_low"), F.least(F.col("_until"), F.lit(last)) + 1, width)))
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("bigint")
    if spans:  # a pair comes out in the first cell that both touch
        parts = by_cells(rows, F.col("t"), F.least(F.col("till"), F.lit(last + 1)), width).join(cells, "_cell")
        parts = parts.where((F.col("_cell") == F.greatest(cell("t"), cell("_low"))) & F.expr("till > _low AND t < _until"))
    else:
        parts = rows.withColumn("_cell", cell("t")).join(cells, "_cell").where("t >= _low AND till <= _until")
    parts = parts.select((F.col("block") * 2 + 1).alias("key"), "t", "a", "b", F.col("till").alias("c"), F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("e"))
    heads = lane.select((F.col("block") * 2).alias("key"), F.col("low").alias("t"), F.col("qid").alias("a"), F.col("who").alias("b"), F.col("goal").alias("c"), F.col("start").alias("d"), F.col("until").alias("e"))
    laid = heads.unionByName(parts).repartitionById(n_blocks, F.floor(F.col("key") / 2).cast("int")).sortWithinPartitions("key", "t")
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches):
        stream = _Stream(batches)
        while (key := stream.head()) is not None:
            lane = [np.concatenate(c) for c in zip(*stream.take(key))]
            rest = stream.take(key + 1)
            for out in kernel(*lane[1:], (chunk[:4] for chunk in rest)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)
            for _ in rest:  # what a kernel that was done early has left
                pass

    return laid.mapInArrow(run, schema)


class _Stream:
    """Batches sorted by key, taken key by key."""

    def __init__(self, batches):
        self._batches, self._keys, self._held, self._at = iter(batches), (), (), 0

    def head(self) -> int | None:
        while self._at >= len(self._keys):
            batch = next(self._batches, None)
            if batch is None:
                return None
            self._keys, self._at = batch.column("key").to_numpy(), 0
            self._held = [batch.column(c).to_numpy() for c in _COLUMNS]
        return int(self._keys[self._at])

    def take(self, key: int):
        while self.head() == key:
            low, self._at = self._at, int(np.searchsorted(self._keys, key, "right"))
            yield [c[low : self._at] for c in self._held]


def passages(qid, source, _goal, start, until, chunks):
    """qid, vertex, seconds: for each lane the least arrival - departure from its source to each other vertex.

    chunks: depart, src, dst, arrive. Of each vertex the latest departure from the source is kept that has led there by
    now; an edge takes that of its source along. What is to arrive where a later departure has
    already led is no faster, then or later, and is dropped. Edges without duration are taken until nothing changes.
    """
    own = defaultdict(list)
    for k, v in enumerate(source.tolist()):
        own[v].append(k)
    own = {v: np.array(x) for v, x in own.items()}
    left, took = {}, {}  # of each vertex, by lane: the latest departure, the least seconds
    for v, x in own.items():
        left[v] = np.full(len(qid), NEVER)
        left[v][x] = MOST  # no lane comes back to its source
    under_way, turn = [], count()

    def go(depart: int, src: int, dst: int, arrive: int) -> bool:
        row = left.get(src)
        if row is None:
            return False
        x = own.get(src)
        if x is not None:
            row = row.copy()
            row[x] = np.where(start[x] <= depart, depart, NEVER)
        to = left.get(dst)
        lane = np.flatnonzero((row > (NEVER if to is None else to)) & (until >= arrive))
        if not len(lane):
            return False
        if to is None:
            to = left[dst] = np.full(len(qid), NEVER)
        if dst not in took:
            took[dst] = np.full(len(qid), MOST)
        leave = row[lane]
        took[dst][lane] = np.minimum(took[dst][lane], arrive - leave)
        if arrive > depart:
            heappush(under_way, (arrive, next(turn), to, lane.astype(np.int32), leave))
            return False
        to[lane] = leave
        return True

    now, at, again = [], None, False
    for chunk in chunks:
        for edge in zip(*[c.tolist() for c in chunk]):
            if edge[0] != at:
                while again:
                    again = any([go(*e) for e in now])
                now, at = [], edge[0]
                while under_way and under_way[0][0] <= at:
                    _, _, to, lane, leave = heappop(under_way)
                    to[lane] = np.maximum(to[lane], leave)
            now.append(edge)
            again |= go(*edge)
    while again:
        again = any([go(*e) for e in now])
    out, n = [], 0
    for v, row in took.items():
        lane = np.flatnonzero(row < MOST)
        out.append((qid[lane], np.full(len(lane), v), row[lane]))
        n += len(lane)
        if n >= BATCH:
            yield tuple(np.concatenate(c) for c in zip(*out))
            out, n = [], 0
    if out:
        yield tuple(np.concatenate(c) for c in zip(*out))


class _Place:
    """Sets that came to a place, in order, and those that are there now. Sets of lanes are the bits of a number."""

    __slots__ = ("open", "levels", "all", "tree", "free")

    def __init__(self):
        self.open = {}  # visits under way, in order of their starts
        self.levels = [[]]  # the sets that came, and those of 2, 4, 8 ... next to each other united
        self.all = 0  # nothing else came
        self.tree, self.free = [0, 0], [0]  # the sets that are there, as leaves under their unions

    def came(self, lanes: int) -> None:
        """Adds a set; those that no visit under way tells apart are united from time to time."""
        had = self.levels[0]
        if len(had) >= 64 and len(had) > 4 * len(self.open):
            visits = list(self.open.values())
            ends = [x.since for x in visits[1:]] + [len(had)]
            self.levels, self.all = [[]], 0
            for k, (x, end) in enumerate(zip(visits, ends)):
                both = 0
                for y in had[x.since : end]:
                    both |= y
                x.since = k
                self._append(both)
        self._append(lanes)

    def _append(self, lanes: int) -> None:
        levels, j = self.levels, 0
        self.all |= lanes
        levels[0].append(lanes)
        n = len(levels[0])
        while not (n >> j) & 1:
            if j + 1 == len(levels):
                levels.append([])
            levels[j + 1].append(levels[j][-2] | levels[j][-1])
            j += 1

    def came_since(self, k: int) -> int:
        """All that came from the k-th on."""
        levels, n, out = self.levels, len(self.levels[0]), 0
        while k < n:
            j = (n - k).bit_length() - 1
            if k:
                j = min(j, (k & -k).bit_length() - 1)
            out |= levels[j][k >> j]
            k += 1 << j
        return out

    def enter(self, lanes: int) -> int:
        if not self.free:
            old = self.tree
            n = len(old) // 2
            self.tree = [0] * (4 * n)
            self.tree[2 * n : 3 * n] = old[n:]
            for k in range(2 * n - 1, 0, -1):
                self.tree[k] = self.tree[2 * k] | self.tree[2 * k + 1]
            self.free = list(range(2 * n - 1, n - 1, -1))
        k = self.free.pop()
        self._put(k, lanes)
        return k

    def leave(self, k: int) -> None:
        self._put(k, 0)
        self.free.append(k)

    def _put(self, k: int, lanes: int) -> None:
        tree = self.tree
        k += len(tree) // 2
        tree[k] = lanes
        k >>= 1
        while k:
            both = tree[2 * k] | tree[2 * k + 1]
            if both == tree[k]:
                break
            tree[k] = both
            k >>= 1


class _Visit:
    __slots__ = ("u", "place", "since", "there", "leaf")


def wedges(qid, source, goal, start, until, chunks):
    """qid of each lane that passes from visit to visit, from one of its source that ends after start, to its goal by until.

    chunks: ts, u, v, te of visits, which don't overlap within a visitor. A visit carries what its visitor had when
    it began, or the lanes whose source its visitor is. Where it ends, its visitor has what was carried by the visits
    there as it began and by those that have begun since. No pairs of visits are looked at.
    """
    sources, goals = defaultdict(list), defaultdict(int)
    for k, (u, w, low, high) in enumerate(zip(source.tolist(), goal.tolist(), start.tolist(), until.tolist())):
        sources[u].append((1 << k, low, high))
        goals[w] |= 1 << k
    due = sorted(((high, 1 << k) for k, high in enumerate(until.tolist())), reverse=True)
    alive, hits = (1 << len(qid)) - 1, 0
    ready, places, under_way, turn = {}, {}, [], count()

    def end(t: int) -> None:
        """Ends the visits that end by t."""
        nonlocal alive, hits
        while under_way and under_way[0][0] <= t:
            te, n, x = heappop(under_way)
            while due and due[-1][0] < te:
                alive &= ~due.pop()[1]
            place = x.place
            del place.open[n]
            got, new = 0, alive & ~ready.get(x.u, 0)
            if new & (x.there | place.all):
                got = (x.there | place.came_since(x.since)) & new
            if x.leaf >= 0:
                place.leave(x.leaf)
            if not place.open:
                place.levels, place.all = [[]], 0
            if got:
                hit = got & goals.get(x.u, 0)
                hits |= hit
                alive &= ~hit
                ready[x.u] = ready.get(x.u, 0) | got

    for chunk in chunks:
        for ts, u, v, te in zip(*[c.tolist() for c in chunk]):
            if under_way and under_way[0][0] <= ts:
                end(ts)
            lanes = ready.get(u, 0)
            for bit, low, high in sources.get(u, ()):
                if te > low and ts < high:
                    lanes |= bit
            lanes &= alive
            place = places.get(v)
            if place is None:
                place = places[v] = _Place()
            x = _Visit()
            x.u, x.place, x.since, x.there, x.leaf = u, place, len(place.levels[0]), place.tree[1], -1
            if lanes:
                place.came(lanes)  # may count anew, so this visit, which isn't under way yet, takes all since the last
                x.since = len(place.levels[0]) - 1
                x.leaf = place.enter(lanes)
            n = next(turn)
            place.open[n] = x
            heappush(under_way, (te, n, x))
        if not alive:
            break
    end(MOST)
    if hits:
        yield (qid[[k for k in range(len(qid)) if hits >> k & 1]],)
