"""Plain single-machine versions that the operators are held against."""

from __future__ import annotations

import re
from collections import defaultdict


def line_reason(raw, sep, n_cols, n_upper, n_lower):
    """Reason why a line is rejected, or None, by reading it character by character."""
    if raw is None:
        return "columns"
    if raw.endswith("\r"):
        raw = raw[:-1]
    fields, k, n = [], 0, len(raw)
    while True:
        start = k
        if sep != " ":
            while k < n and raw[k] == " " and raw[k] != sep:
                k += 1
        if k < n and raw[k] == '"':
            k += 1
            out = []
            while True:
                if k >= n:
                    return "quoting"
                if raw[k] == '"':
                    if k + 1 < n and raw[k + 1] == '"':
                        out.append('"')
                        k += 2
                        continue
                    k += 1
                    break
                out.append(raw[k])
                k += 1
            if sep != " ":
                while k < n and raw[k] == " ":
                    k += 1
            if k < n and raw[k] != sep:
                return "quoting"
            fields.append("".join(out))
        else:
            k = raw.find(sep, start)
            k = n if k < 0 else k
            if '"' in raw[start:k]:
                return "quoting"
            fields.append(raw[start:k].strip(" "))
        if k >= n:
            break
        k += 1
    if len(fields) != n_cols:
        return "columns"
    num = [int(f) if re.fullmatch("[0-9]{1,18}", f) else None for f in fields[:4]]
    time = lambda x: x is not None and 946684800 <= x < 4102444800
    if num[0] is None or num[0] >= n_upper:
        return "upper"
    if num[1] is None or num[1] >= n_lower:
        return "node"
    if not time(num[2]):
        return "start"
    if not time(num[3]) or num[3] <= num[2]:
        return "end"
    return None


def components(rows):
    by, out = defaultdict(set), []
    for u, v, ts, te in rows:
        if None not in (u, v, ts, te) and te > ts:
            by[v].add((ts, te, u))
    for v, visits in by.items():
        here = []
        for ts, te, _ in sorted(visits):
            if here and ts < here[-1][1]:
                here[-1] = (here[-1][0], max(here[-1][1], te), here[-1][2] + 1)
            else:
                here.append((ts, te, 1))
        out += [(v, *c) for c in here]
    return sorted(out)


def sessions(rows, gap):
    by, out = defaultdict(lambda: defaultdict(set)), []
    for u, ts, v in rows:
        if u is not None and ts is not None:
            by[u][ts].add(v)
    for u, at in by.items():
        here = []
        for ts in sorted(at):
            if here and ts - here[-1][1] <= gap:
                here[-1] = (here[-1][0], ts, here[-1][2] + 1, here[-1][3] + len(at[ts]))
            else:
                here.append((ts, ts, 1, len(at[ts])))
        out += [(u, a, b, b - a, n, m) for a, b, n, m in here]
    return sorted(out)
