"""Slot graph and reachability of a list of visits, step by step."""

from __future__ import annotations

from collections import defaultdict

INF = 630_720_000


def graph(visits, delta=INF):
    """slots {(v, start): (end, component)} and edges, of visits (u, v, ts, te) that don't overlap within u."""
    by = defaultdict(list)
    for u, v, ts, te in visits:
        by[v].append((ts, te, u))
    slot, part, comp = {}, {}, 0
    for v, all_ in by.items():
        groups = []
        for ts, te, u in sorted(all_):
            if groups and ts < groups[-1][0]:
                groups[-1][0] = max(groups[-1][0], te)
                groups[-1][1].append((ts, te, u))
            else:
                groups.append([te, [(ts, te, u)]])
        for _, group in groups:
            if len(group) < 2:
                continue
            comp += 1
            at = sorted({t for ts, te, _ in group for t in (ts, te)})
            for a, b in zip(at, at[1:]):
                slot[(v, a)] = (b, comp)
            for ts, te, u in group:
                part[(u, ts)] = (v, ts, te, comp)
    edges = {((v, a), (v, b)) for (v, a), (b, c) in slot.items() if (v, b) in slot and slot[(v, b)][1] == c}
    per = defaultdict(list)
    for (u, ts), x in part.items():
        per[u].append(x)
    for seq in per.values():
        seq.sort(key=lambda x: x[1])
        for (v, ts, te, c), (w, ts2, _, c2) in zip(seq, seq[1:]):
            last = max(a for (x, a), (b, cc) in slot.items() if x == v and cc == c and a >= ts and b <= te)
            if c != c2 and ts2 - last <= delta:
                edges.add(((v, last), (w, ts2)))
    return slot, edges, per


def answer(g, u, w, start, end):
    slot, edges, per = g
    if start > end:
        return False
    own = lambda x: [(a, b) for (v, a), (b, c) in slot.items() if v == x[0] and c == x[3] and a >= x[1] and b <= x[2]]
    src = dst = None
    for x in per.get(u, []):
        if x[1] < end and x[2] >= start:
            fit = [a for a, b in own(x) if b > start]
            if fit:
                src = (x[0], min(fit))
                break
    for x in reversed(per.get(w, [])):
        if x[2] > start and x[1] <= end:
            fit = [a for a, b in own(x) if a < end]
            if fit:
                dst = (x[0], max(fit))
                break
    if src is None or dst is None:
        return False
    seen, stack = {src}, [src]
    while stack:
        here = stack.pop()
        for a, b in edges:
            if a == here and b not in seen:
                seen.add(b)
                stack.append(b)
    return dst in seen


def wedge(visits, u, w, start, end):
    if start > end:
        return False
    if u == w:
        return True
    ready = {}
    over = [(x, y) for x in visits for y in visits if x[0] != y[0] and x[1] == y[1] and max(x[2], y[2]) < min(x[3], y[3])]
    for x, y in over:
        if x[0] == u and x[3] > start and x[2] < end and y[3] <= end:
            ready[y[0]] = min(y[3], ready.get(y[0], y[3]))
    moved = True
    while moved:
        moved = False
        for x, y in over:
            if x[0] in ready and x[2] >= ready[x[0]] and y[3] <= end and y[3] < ready.get(y[0], end + 1):
                ready[y[0]] = y[3]
                moved = True
    return w in ready
