"""Time fragments of the slot graph, their borders, and reachability through contracted fragments.

A fragment is a range of slots in order of (slot_start, slot_end, v). The kernels see one
fragment at a time, so their number must grow with the graph: FRAGMENT_SLOTS bounds a fragment
where no number is given. Border sets are kept as sets, never as hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wayspan.operators.blocks import with_rank
from wayspan.session import cut, drop

#: Slots of a fragment at most, and least number of fragments, where the number is left open.
FRAGMENT_SLOTS, LEAST_FRAGMENTS = 50_000, 8


def fragments(slot: DataFrame, k: int | None = None) -> DataFrame:
    """v, slot_start, slot_end, frag (from 0), and c_start where slot has it: k fragments of ceil(n / k) slots in time order."""
    n = slot.count()
    k = k or max(LEAST_FRAGMENTS, -(-n // FRAGMENT_SLOTS))
    size = max(1, -(-n // k))
    more = [c for c in ("c_start",) if c in slot.columns]
    ranked = with_rank(slot.select("v", "slot_start", "slot_end", *more), ["slot_start", "slot_end", "v"])
    return ranked.select("v", "slot_start", "slot_end", *more, F.floor(F.col("rank") / F.lit(size)).cast("bigint").alias("frag"))


def with_fragments(edge: DataFrame, frag: DataFrame) -> DataFrame:
    """edge with src_frag and dst_frag."""
    a = frag.select(F.col("v").alias("src_v"), F.col("slot_start").alias("src_start"), F.col("frag").alias("src_frag"))
    b = frag.select(F.col("v").alias("dst_v"), F.col("slot_start").alias("dst_start"), F.col("frag").alias("dst_frag"))
    return edge.join(a, ["src_v", "src_start"]).join(b, ["dst_v", "dst_start"])


def edge_cut(edge: DataFrame) -> DataFrame:
    """One row: n_edges, n_cut, cut_ratio of edges that have src_frag and dst_frag."""
    return edge.agg(F.count("*").alias("n_edges"), F.count_if(F.col("src_frag") != F.col("dst_frag")).alias("n_cut"), F.avg((F.col("src_frag") != F.col("dst_frag")).cast("double")).alias("cut_ratio"))


def fragment_matrix(edge: DataFrame) -> DataFrame:
    return edge.groupBy("src_frag", "dst_frag").agg(F.count("*").alias("n_edges"))


def fragment_times(frag: DataFrame) -> DataFrame:
    return frag.groupBy("frag").agg(F.count("*").alias("n_slots"), F.min("slot_start").alias("first_start"), F.max("slot_end").alias("last_end"))


def borders(edge: DataFrame) -> DataFrame:
    """v, slot_start, frag of the targets of cut edges."""
    return edge.where("src_frag <> dst_frag").select(F.col("dst_v").alias("v"), F.col("dst_start").alias("slot_start"), F.col("dst_frag").alias("frag")).distinct()


def least_fragments(slot: DataFrame, edge: DataFrame, at_once: int = 16) -> int | None:
    """The least k, by search, with ceil(n / k) <= 8 * borders(k): a fragment's slots fit its border bitset.

    Slots are ranked once; a job counts the border slots of at_once numbers together, first of the
    powers of two up to n, then of numbers between, k being taken to fit from some number on. None
    where none does: with a slot for each fragment every edge leads over a border, so only without edges.
    """
    ranked = cut(with_rank(slot.select("v", "slot_start", "slot_end"), ["slot_start", "slot_end", "v"]).select("v", "slot_start", "rank"))
    n = ranked.count()
    a = ranked.select(F.col("v").alias("src_v"), F.col("slot_start").alias("src_start"), F.col("rank").alias("src"))
    b = ranked.select(F.col("v").alias("dst_v"), F.col("slot_start").alias("dst_start"), F.col("rank").alias("dst"))
    links = cut(edge.join(a, ["src_v", "src_start"]).join(b, ["dst_v", "dst_start"]).select("src", "dst"))

    def fitting(numbers: list[int]) -> int | None:
        """The place of the first of these ascending numbers that fits."""
        tried = F.explode(F.array(*[F.struct(F.lit(k).alias("at"), F.lit(-(-n // x)).alias("size")) for k, x in enumerate(numbers)]))
        cut_ = links.select("src", "dst", tried.alias("x")).select("dst", "x.*", F.floor(F.col("src") / F.col("x.size")).alias("f")).where(F.floor(F.col("dst") / F.col("size")) != F.col("f"))
        found = cut_.select("at", "size", "dst").distinct().groupBy("at", "size").agg(F.count("*").alias("c")).where("size <= 8 * c")
        return found.agg(F.min("at")).first()[0]

    powers = [1 << k for k in range(n.bit_length()) if 1 << k < n] + ([n] if n else [])
    at = fitting(powers) if n else None
    if at is None:
        return None
    low, high = powers[at - 1] + 1 if at else 1, powers[at]
    while low < high:
        step = max(1, (high - low) // at_once)
        numbers = [*range(low, high, step)]
        at = fitting(numbers)
        if at is None:
            low = numbers[-1] + 1
        else:
            low, high = numbers[at - 1] + 1 if at else low, numbers[at]
    return low


_KERNEL = "frag bigint, row string, v bigint, slot_start bigint, class bigint, n bigint, bits binary"


def pieces(frag: DataFrame, edge: DataFrame) -> DataFrame:
    """Slots and edges of each fragment as rows of one shape; cut edges belong to the fragment they leave."""
    none = F.lit(None).cast("bigint")
    component = F.col("c_start") if "c_start" in frag.columns else none
    nodes = frag.select("frag", F.lit("slot").alias("row"), F.col("v").alias("a_v"), F.col("slot_start").alias("a_t"), none.alias("b_v"), component.alias("b_t"))
    inner = F.when(F.col("src_frag") == F.col("dst_frag"), "edge").otherwise("cut")
    links = edge.select(F.col("src_frag").alias("frag"), inner.alias("row"), F.col("src_v").alias("a_v"), F.col("src_start").alias("a_t"), F.col("dst_v").alias("b_v"), F.col("dst_start").alias("b_t"))
    entry = borders(edge).select("frag", F.lit("entry").alias("row"), F.col("v").alias("a_v"), F.col("slot_start").alias("a_t"), none.alias("b_v"), none.alias("b_t"))
    return nodes.unionByName(links).unionByName(entry)


def unpacked(pdf: pd.DataFrame):
    """Nodes in time order, their children, and the ghosts (border slots of later fragments) each leads to."""
    by = {k: g for k, g in pdf.groupby("row")}
    nodes = sorted(zip(by["slot"]["a_t"].tolist(), by["slot"]["a_v"].tolist())) if "slot" in by else []
    at = {x: i for i, x in enumerate(nodes)}
    children: list[list[int]] = [[] for _ in nodes]
    ghosts: dict[tuple[int, int], int] = {}
    out: list[int] = [0] * len(nodes)
    for kind in ("edge", "cut"):
        if kind not in by:
            continue
        g = by[kind]
        for av, t, bv, bt in zip(g["a_v"].tolist(), g["a_t"].tolist(), g["b_v"].astype("int64").tolist(), g["b_t"].astype("int64").tolist()):
            if kind == "edge":
                children[at[(t, av)]].append(at[(bt, bv)])
            else:
                out[at[(t, av)]] |= 1 << ghosts.setdefault((bt, bv), len(ghosts))
    entries = sorted(at[x] for x in zip(by["entry"]["a_t"].tolist(), by["entry"]["a_v"].tolist())) if "entry" in by else []
    return nodes, children, list(ghosts), out, entries


def classes(frag: DataFrame, edge: DataFrame, share: bool = True, wanted: DataFrame | None = None) -> DataFrame:
    """Classes of slots of one fragment that lead to, or come from, the same border slots.

    Rows: row = out and in for each slot (class is its class within the fragment and side, n the
    size of its border set, bits null); row = out_class and in_class for each class that isn't empty,
    with its set as bits, v and slot_start null; row = ghost and entry for the border slots of later
    fragments and of this one, class being the bit they have. Class 0 is the empty set. Without
    share every slot has a class of its own, which tells what sharing saves. With wanted (frag, side,
    v, slot_start) only the classes of those slots, and the out-classes of entries, have a row with
    their set, cut behind its last bit: what contracted_reach looks up.
    """
    whole = wanted is None

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        here = int(pdf["frag"].iloc[0])
        nodes, children, ghosts, out, entries = unpacked(pdf)
        rows = [(here, "ghost", v, t, k, None, None) for k, (t, v) in enumerate(ghosts)]
        rows += [(here, "entry", nodes[i][1], nodes[i][0], k, None, None) for k, i in enumerate(entries)]
        asked = {side: set(zip(g["a_t"].tolist(), g["a_v"].tolist())) for side in ("out", "in") if len(g := pdf[pdf["row"] == f"want_{side}"])}
        asked.setdefault("out", set()).update(nodes[i] for i in entries)

        def add(side: str, bits: list[int], width: int) -> None:
            number, sets, mine = {0: 0}, {}, asked.get(side, set())
            for k, ((t, v), b) in enumerate(zip(nodes, bits)):
                c = number.setdefault(b, len(number)) if share or not b else k + 1
                if whole or (t, v) in mine:
                    sets[c] = b
                rows.append((here, side, v, t, c, b.bit_count(), None))
            rows.extend((here, f"{side}_class", None, None, c, b.bit_count(), b.to_bytes(-(-(width if whole else b.bit_length()) // 8), "little")) for c, b in sets.items() if b)

        for i in range(len(nodes) - 1, -1, -1):  # edges lead to later starts, so this order is topological
            for j in children[i]:
                out[i] |= out[j]
        add("out", out, len(ghosts))
        del out
        back = [0] * len(nodes)
        for k, i in enumerate(entries):
            back[i] |= 1 << k
        for i in range(len(nodes)):
            for j in children[i]:
                back[j] |= back[i]
        add("in", back, len(entries))
        frame = pd.DataFrame(rows, columns=["frag", "row", "v", "slot_start", "class", "n", "bits"])
        return frame.astype({"v": "Int64", "slot_start": "Int64", "class": "Int64", "n": "Int64"})

    rows = pieces(frag, edge)
    if not whole:
        rows = rows.unionByName(wanted.select("frag", F.concat(F.lit("want_"), "side").alias("row"), F.col("v").alias("a_v"), F.col("slot_start").alias("a_t")), allowMissingColumns=True)
    return rows.groupBy("frag").applyInPandas(kernel, _KERNEL)


def asked_classes(ends: DataFrame, frag: DataFrame, edge: DataFrame, share: bool = True) -> DataFrame:
    """classes() with the sets that contracted_reach looks up for the pairs of ends only, cut."""
    sides = [ends.select(F.lit(side).alias("side"), F.col(f"{end}_v").alias("v"), F.col(f"{end}_start").alias("slot_start")) for side, end in (("out", "src"), ("in", "dst"))]
    return cut(classes(frag, edge, share, sides[0].unionByName(sides[1]).distinct().join(frag.select("v", "slot_start", "frag"), ["v", "slot_start"])))


def local_closure(frag: DataFrame, edge: DataFrame) -> DataFrame:
    """v, slot_start, n_reached: slots of the same fragment that each slot leads to, itself too."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, children, _, _, _ = unpacked(pdf)
        bits = [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            b = 1 << i
            for j in children[i]:
                b |= bits[j]
            bits[i] = b
        return pd.DataFrame({"v": [v for _, v in nodes], "slot_start": [t for t, _ in nodes], "n_reached": [b.bit_count() for b in bits]}, dtype="int64")

    return pieces(frag, edge).groupBy("frag").applyInPandas(kernel, "v bigint, slot_start bigint, n_reached bigint")


#: Slots whose targets a task of whole_closure counts at a time (a bit each), and slots of a packed run of edges.
CLOSURE_WIDTH, CLOSURE_RUN = 65_536, 16_384


def whole_closure(slot: DataFrame, edge: DataFrame, width: int = CLOSURE_WIDTH, run: int = CLOSURE_RUN) -> DataFrame:
    """v, slot_start, n_reached: slots of the whole graph that each slot leads to, itself too.

    Slots are numbered in time order, which is topological, and targets are counted by blocks of
    width numbers. The task of a block reads the edges from the block's end back to the first slot,
    a run at a time, and keeps a bitset of width bits only for slots that an earlier one still leads
    to: as many as there are places and visitors under way. The work grows with the square of the slots.
    """
    ranked = cut(with_rank(slot.select("v", "slot_start", "slot_end"), ["slot_start", "slot_end", "v"]).select("v", "slot_start", "rank"))
    n = ranked.count()
    a = ranked.select(F.col("v").alias("src_v"), F.col("slot_start").alias("src_start"), F.col("rank").alias("src"))
    b = ranked.select(F.col("v").alias("dst_v"), F.col("slot_start").alias("dst_start"), F.col("rank").alias("dst"))
    links = cut(edge.select("src_v", "src_start", "dst_v", "dst_start").distinct().join(a, ["src_v", "src_start"]).join(b, ["dst_v", "dst_start"]).select("src", "dst"))
    entered = cut(links.groupBy("dst").agg(F.min("src").alias("first")))
    links = links.join(entered, "dst").join(entered.select(F.col("dst").alias("src"), F.lit(2).alias("_in")), "src", "left")
    links = links.withColumn("flag", (F.col("src") == F.col("first")).cast("int") + F.coalesce("_in", F.lit(0)))
    links = links.withColumn("run", F.floor(F.col("src") / F.lit(run)).cast("bigint"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"], ascending=False)
        return pd.DataFrame({"run": pdf["run"].iloc[:1], "src": [pdf["src"].to_numpy("int64").tobytes()], "step": [(pdf["dst"] - pdf["src"]).to_numpy("int64").tobytes()], "flag": [pdf["flag"].to_numpy("int8").tobytes()]})

    runs = cut(links.select("run", "src", "dst", "flag").groupBy("run").applyInPandas(pack, "run bigint, src binary, step binary, flag binary"))
    last = max(n - 1, 0) // width
    asks = runs.withColumn("block", F.explode(F.sequence(F.floor(F.col("run") * F.lit(run) / F.lit(width)).cast("bigint"), F.lit(last).cast("bigint"))))
    asks = asks.repartition(last + 1, "block").sortWithinPartitions("block", F.desc("run"))

    def count(frames):
        block = None
        for pdf in frames:
            for b, r, *packed in zip(pdf["block"].tolist(), pdf["run"].tolist(), pdf["src"], pdf["step"], pdf["flag"]):
                if b != block:
                    block, live = b, {}
                src, step, flag = (np.frombuffer(x, kind) for x, kind in zip(packed, (np.int64, np.int64, np.int8)))
                found = _reached(src, step, flag, live, b * width, (b + 1) * width, r * run, run)
                yield pd.DataFrame({"run": [r], "counts": [found.tobytes()]})

    parts = cut(asks.mapInPandas(count, "run bigint, counts binary"))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(run, np.int64)
        for c in pdf["counts"]:
            total += np.frombuffer(c, np.int32)
        at = total.nonzero()[0]
        return pd.DataFrame({"rank": at + int(pdf["run"].iloc[0]) * run, "n": total[at]})

    sums = parts.groupBy("run").applyInPandas(add, "rank bigint, n bigint")
    return ranked.join(sums, "rank", "left").select("v", "slot_start", (F.coalesce("n", F.lit(0)) + 1).cast("bigint").alias("n_reached"))


def _reached(src: np.ndarray, step: np.ndarray, flag: np.ndarray, live: dict, low: int, high: int, first: int, run: int) -> np.ndarray:
    """For each slot of a run from number first: how many slots of the block [low, high) come after it; its edges go backwards.

    live holds, for slots that were passed, the bits of themselves and of what they lead to in the
    block, and their number; slots may share one bitset. flag: 1 where no later edge enters the
    target, so it leaves live; 2 where some edge enters the source, so it has to be kept.
    """
    out = np.zeros(run, np.int32)
    keep = src + step < high
    sources, targets, flags = src[keep].tolist(), (src + step)[keep].tolist(), flag[keep].tolist()
    k, m = 0, len(sources)
    while k < m:
        s, bits, n, fresh = sources[k], None, 0, False
        while k < m and sources[k] == s:
            c, f = targets[k], flags[k]
            k += 1
            has = live.pop(c, None) if f & 1 else live.get(c)
            if has is None:
                if c < low:
                    continue
                own = np.zeros(-(-(high - low) // 64), np.uint64)
                own[(c - low) >> 6] = np.uint64(1 << ((c - low) & 63))
                has = own, 1
                if not f & 1:
                    live[c] = has
            if bits is None:
                bits, n = has
            elif bits is not has[0]:
                if fresh:
                    np.bitwise_or(bits, has[0], out=bits)
                else:
                    bits, fresh = bits | has[0], True
                n = -1
        if bits is None:
            continue
        if n < 0:
            n = int(np.bitwise_count(bits).sum())
        out[s - first] = n
        if not f & 2:
            continue
        if s >= low:
            bits = bits if fresh else bits.copy()
            bits[(s - low) >> 6] |= np.uint64(1 << ((s - low) & 63))
            n += 1
        live[s] = bits, n
    return out


def levels(frag: DataFrame, edge: DataFrame) -> DataFrame:
    """v, slot_start, up, down: longest paths to and from each slot within its fragment; what reaches has the lesser up and greater down."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, children, _, _, _ = unpacked(pdf)
        up, down = [0] * len(nodes), [0] * len(nodes)
        for i in range(len(nodes)):
            for j in children[i]:
                up[j] = max(up[j], up[i] + 1)
        for i in range(len(nodes) - 1, -1, -1):
            for j in children[i]:
                down[i] = max(down[i], down[j] + 1)
        return pd.DataFrame({"v": [v for _, v in nodes], "slot_start": [t for t, _ in nodes], "up": up, "down": down}, dtype="int64")

    return pieces(frag, edge).groupBy("frag").applyInPandas(kernel, "v bigint, slot_start bigint, up bigint, down bigint")


def chain_labels(frag: DataFrame, edge: DataFrame, k: int = 5) -> DataFrame:
    """Chain labels of each slot within its fragment: v, slot_start, lout, lin (arrays of rank and at).

    A chain is the part of a component that lies in a fragment, which is a path; chains rank by the
    number of their slots, ties by their first slot. frag must have c_start. lout has, for the k lowest
    ranks among chains a slot leads to, the first slot start reached there; lin the last slot
    start that leads to it.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, children, _, _, _ = unpacked(pdf)
        own_slots = pdf[pdf["row"] == "slot"]
        component = {(t, v): c for t, v, c in zip(own_slots["a_t"], own_slots["a_v"], own_slots["b_t"].astype("int64"))}
        chain, size, first = [-1] * len(nodes), {}, {}
        for i, (t, v) in enumerate(nodes):
            chain[i] = first.setdefault((v, component[(t, v)]), i)
            size[chain[i]] = size.get(chain[i], 0) + 1
        rank = {c: i for i, c in enumerate(sorted(size, key=lambda c: (-size[c], nodes[c])))}
        lout: list[dict] = [{} for _ in nodes]
        lin: list[dict] = [{} for _ in nodes]
        for i in range(len(nodes) - 1, -1, -1):
            own = {rank[chain[i]]: nodes[i][0]}
            for j in children[i]:
                for r, t in lout[j].items():
                    own[r] = min(t, own.get(r, t))
            lout[i] = {r: own[r] for r in sorted(own)[:k]}
        for i in range(len(nodes)):
            lin[i][rank[chain[i]]] = nodes[i][0]
            lin[i] = {r: lin[i][r] for r in sorted(lin[i])[:k]}
            for j in children[i]:
                for r, t in lin[i].items():
                    lin[j][r] = max(t, lin[j].get(r, t))
        pack = lambda x: [{"rank": r, "at": t} for r, t in sorted(x.items())]
        return pd.DataFrame({"v": [v for _, v in nodes], "slot_start": [t for t, _ in nodes], "lout": [pack(x) for x in lout], "lin": [pack(x) for x in lin]})

    label = "array<struct<rank:bigint,at:bigint>>"
    return pieces(frag, edge).groupBy("frag").applyInPandas(kernel, f"v bigint, slot_start bigint, lout {label}, lin {label}")


def labels_meet(lout: str, lin: str):
    """Positive test of two labels: a common chain that is left for no later than it leads on."""
    return F.exists(lout, lambda x: F.exists(lin, lambda y: (x["rank"] == y["rank"]) & (x["at"] <= y["at"])))


def _local_hits(pairs: DataFrame, frag: DataFrame, edge: DataFrame) -> DataFrame:
    """qid of the pairs (qid, f, src_v, src_start, dst_v, dst_start) that reach within their fragment f; one walk for each source."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, children, _, _, _ = unpacked(pdf)
        at = {x: i for i, x in enumerate(nodes)}
        asks = pdf[pdf["row"] == "ask"]
        by: dict[int, list] = {}
        for q, av, t, bv, bt in zip(asks["qid"], asks["a_v"], asks["a_t"], asks["b_v"].astype("int64"), asks["b_t"].astype("int64")):
            by.setdefault(at[(t, av)], []).append((at[(bt, bv)], q))
        yes = []
        for start, goals in by.items():
            last, seen, stack = max(g for g, _ in goals), {start}, [start]
            while stack:
                for j in children[stack.pop()]:
                    if j <= last and j not in seen:
                        seen.add(j)
                        stack.append(j)
            yes += [int(q) for g, q in goals if g in seen]
        return pd.DataFrame({"qid": yes}, dtype="int64")

    asks = pairs.select("qid", F.col("f").alias("frag"), F.lit("ask").alias("row"), F.col("src_v").alias("a_v"), F.col("src_start").alias("a_t"), F.col("dst_v").alias("b_v"), F.col("dst_start").alias("b_t"))
    rows = pieces(frag, edge).join(asks.select("frag").distinct(), "frag", "left_semi").withColumn("qid", F.lit(None).cast("bigint"))
    return rows.unionByName(asks).groupBy("frag").applyInPandas(kernel, "qid bigint")


#: Queries at a fragment that a task of contracted_reach takes together, and bytes of sets that it unites at a time.
QUERY_BLOCK, UNITE_BYTES = 2_048, 16 << 20


def contracted_reach(ends: DataFrame, frag: DataFrame, edge: DataFrame, found: DataFrame, block: int = QUERY_BLOCK, local=None) -> DataFrame:
    """qid of the pairs of ends (qid, src_v, src_start, dst_v, dst_start) that reach, through fragments and classes.

    found is the result of classes(). Within a fragment: local(pairs, frag, edge), else a walk by its kernel. Between fragments:
    from the out-class of the source, border to border, to the in-class of the target. In each round
    all queries take one step from wherever they have come: a task has at most about a block of the queries
    at one fragment, and goes on only with border slots that are new to a query. Answered queries stop.
    """
    where = frag.select("v", "slot_start", "frag")
    rows = cut(
        ends.join(where.select(F.col("v").alias("src_v"), F.col("slot_start").alias("src_start"), F.col("frag").alias("f")), ["src_v", "src_start"])
        .join(where.select(F.col("v").alias("dst_v"), F.col("slot_start").alias("dst_start"), F.col("frag").alias("g")), ["dst_v", "dst_start"])
        .select("qid", "src_v", "src_start", "dst_v", "dst_start", "f", "g")
    )
    hits = [(local or _local_hits)(rows.where("f = g"), frag, edge)]
    far = rows.where("f < g")
    of = found.where("row IN ('out', 'in') AND class > 0").select("row", "frag", "v", "slot_start", "class")
    sets = found.where("row IN ('out_class', 'in_class')").select(F.regexp_replace("row", "_class", "").alias("row"), "frag", "class", "bits")
    empty = F.lit(None).cast("bigint")

    def held(side: str, name: str, at: str, end: str) -> DataFrame:
        """The sets of the queries' slots on a side."""
        slot = far.select("qid", F.col(at).alias("frag"), F.col(f"{end}_v").alias("v"), F.col(f"{end}_start").alias("slot_start"))
        rows = slot.join(of.where(F.col("row") == side), ["frag", "v", "slot_start"]).join(sets.where(F.col("row") == side).drop("row"), ["frag", "class"])
        return cut(rows.select("frag", F.lit(name).alias("row"), "qid", empty.alias("k"), empty.alias("to_frag"), "bits"))

    goal = held("in", "goal", "g", "dst")
    entry = found.where("row = 'entry'").select("frag", "v", "slot_start", F.col("class").alias("k"))
    lead = cut(entry.join(of.where("row = 'out'"), ["frag", "v", "slot_start"]).select("frag", F.lit("lead").alias("row"), empty.alias("qid"), "k", F.col("class").alias("to_frag"), F.lit(None).cast("binary").alias("bits")))
    used = lead.select("frag", F.col("to_frag").alias("class")).distinct()
    sets_ = sets.where("row = 'out'").join(used, ["frag", "class"], "left_semi").select("frag", F.lit("set").alias("row"), empty.alias("qid"), F.col("class").alias("k"), empty.alias("to_frag"), "bits")
    ghost = found.where("row = 'ghost'").select("frag", "v", "slot_start", F.col("class").alias("k"))
    ghost = ghost.join(entry.select(F.col("frag").alias("to_frag"), "v", "slot_start", F.col("k").alias("to_k")), ["v", "slot_start"])
    ghost = ghost.select("frag", F.lit("ghost").alias("row"), F.col("to_k").alias("qid"), "k", "to_frag", F.lit(None).cast("binary").alias("bits"))
    fixed = cut(lead.unionByName(sets_).unionByName(ghost))
    come, seen = held("out", "begin", "f", "src"), None
    while not come.isEmpty():
        here = cut(come.groupBy("frag").agg(F.ceil(F.countDistinct("qid") / F.lit(block)).cast("bigint").alias("parts")))
        now = cut(come.select("frag", "qid").distinct())
        feed = come.unionByName(goal.join(now, ["frag", "qid"], "left_semi"))
        if seen is not None:
            feed = feed.unionByName(seen.join(now, ["frag", "qid"], "left_semi").withColumn("row", F.lit("seen")))
        feed = feed.join(here, "frag").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")))
        feed = feed.unionByName(fixed.join(here, "frag").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))))
        out = cut(feed.drop("parts").groupBy("frag", "part").applyInPandas(_hop, "qid bigint, to_frag bigint, bits binary"))
        hits.append(cut(out.where("to_frag = -1").select("qid").distinct()))
        came = come.where("row = 'come'")
        seen = came if seen is None else seen.unionByName(came)
        come = out.where("to_frag >= 0").join(hits[-1], "qid", "left_anti")
        come = cut(come.select(F.col("to_frag").alias("frag"), F.lit("come").alias("row"), "qid", empty.alias("k"), empty.alias("to_frag"), "bits"))
        drop(out, here, now)
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out.distinct()


def _bits(rows: list, width: int) -> np.ndarray:
    """Bit strings as a matrix; shorter ones are filled up."""
    out = np.zeros((len(rows), width), bool)
    for k, r in enumerate(rows):
        b = np.unpackbits(np.frombuffer(r, np.uint8), bitorder="little")[:width]
        out[k, : len(b)] = b
    return out


def _hop(pdf: pd.DataFrame) -> pd.DataFrame:
    """What the queries that have come to a fragment, or begin there, reach: entries of later fragments, or their goal (to_frag -1)."""
    by = {k: g for k, g in pdf.groupby("row")}
    ghost = by.get("ghost", pdf.iloc[:0])
    n_ghosts = int(ghost["k"].max()) + 1 if len(ghost) else 0
    n_entries = 1 + max([int(by["lead"]["k"].max()) if "lead" in by else -1, *(8 * len(b) - 1 for r in ("goal", "come", "seen") if r in by for b in by[r]["bits"])])
    place: dict[int, int] = {}
    rows = []
    at = np.zeros((0, n_entries), bool)
    if "come" in by:
        come = by["come"]
        for q in come["qid"]:
            place.setdefault(int(q), len(place))
        at = np.zeros((len(place), n_entries), bool)
        np.logical_or.at(at, [place[int(q)] for q in come["qid"]], _bits(come["bits"].tolist(), n_entries))
        if "seen" in by:
            seen = by["seen"][by["seen"]["qid"].isin(place.keys())]
            had = np.zeros_like(at)
            np.logical_or.at(had, [place[int(q)] for q in seen["qid"]], _bits(seen["bits"].tolist(), n_entries))
            at &= ~had
        if "goal" in by:
            goal = by["goal"]
            for q, b in zip(goal["qid"], _bits(goal["bits"].tolist(), n_entries)):
                if int(q) in place and (at[place[int(q)]] & b).any():
                    rows.append((int(q), -1, b""))
    if n_ghosts:
        out = np.zeros((len(place), n_ghosts), bool)
        if "lead" in by and len(place):
            lead, sets = by["lead"], by["set"]
            width = -(-n_ghosts // 8)
            table = np.zeros((len(sets), width), np.uint8)
            for i, b in enumerate(sets["bits"]):
                table[i, : len(b)] = np.frombuffer(b, np.uint8)
            number = {c: i for i, c in enumerate(sets["k"].astype("int64").tolist())}
            of = np.full(n_entries, -1)
            of[lead["k"].astype("int64").to_numpy()] = [number[c] for c in lead["to_frag"].astype("int64").tolist()]
            step = max(1, UNITE_BYTES // width)
            for q in range(len(place)):
                which = np.unique(of[at[q]])
                which = which[which >= 0]
                whole = np.zeros(width, np.uint8)
                for low in range(0, len(which), step):
                    whole |= np.bitwise_or.reduce(table[which[low : low + step]], axis=0)
                out[q] = np.unpackbits(whole, bitorder="little")[:n_ghosts]
        ids = list(place)
        if "begin" in by:
            ids += [int(q) for q in by["begin"]["qid"]]
            out = np.concatenate([out, _bits(by["begin"]["bits"].tolist(), n_ghosts)])
        for to, g in ghost.groupby("to_frag"):
            there = np.zeros((len(ids), int(g["qid"].max()) + 1), bool)
            there[:, g["qid"].astype("int64").to_numpy()] = out[:, g["k"].astype("int64").to_numpy()]
            packed = np.packbits(there, axis=1, bitorder="little")
            rows += [(q, int(to), packed[k].tobytes()) for k, q in enumerate(ids) if there[k].any()]
    return pd.DataFrame(rows, columns=["qid", "to_frag", "bits"])
