"""Blocks of text on a scanned page, from the boxes of its lines."""

from __future__ import annotations

from collections import Counter

import regex as re

BODY, HEAD, ADVERT, TITLE = "body", "head", "advert", "title"


def lines_of(text: str) -> list[tuple[int, int]]:
    """Start and end of each line without its line end; a line end is a line feed, with or without a carriage return before."""
    out, start = [], 0
    while True:
        at = text.find("\n", start)
        if at < 0:
            out.append((start, len(text)))
            return out
        out.append((start, at - 1 if at > start and text[at - 1] == "\r" else at))
        start = at + 1


def blocks(text: str, lines: list[tuple[int, int]], xs: list, ys: list, ws: list, hs: list, width: int | None) -> list[tuple[str, list[int]]]:
    """Blocks in reading order, each a kind and the numbers of its lines.

    Columns are told by gaps between left edges. Within a column a line's indent, height and the
    space around it give its kind: larger type is a headline, a deep indent an advert, a lone line
    at the top or foot a running title or page number. A paragraph opens with a slight indent; one
    that doesn't goes on from before, over adverts and from one column to the next.
    """
    n = len(lines)
    body_h = Counter(hs).most_common(1)[0][0]
    if min(hs) < body_h:  # pages with more headline than body
        low = min(hs)
        if sum(h < body_h * 0.85 for h in hs) >= 2:
            body_h = low
    step = max(100, 3.2 * body_h)
    edges, last = [], None
    for x in sorted(set(xs)):
        if last is None or x - last > step:
            edges.append([x, x])
        edges[-1][1] = last = x
    left0 = edges[0][0]
    lefts = [e[0] for e in edges]
    if width and len(edges) > 1:
        pitch = (width - 2 * left0) / len(edges)
        even = [left0 + k * pitch for k in range(len(edges))]
        if all(-0.6 * body_h <= x - e <= 2.6 * body_h for x, e in zip(lefts, even)):
            lefts = even
    columns: list[list[int]] = [[] for _ in edges]
    starts = [e[0] for e in edges]
    for k in range(n):
        x = xs[k]
        c = len(starts) - 1
        while c and x < starts[c]:
            c -= 1
        columns[c].append(k)
    for c in columns:
        c.sort(key=ys.__getitem__)
    top, foot = min(range(n), key=ys.__getitem__), max(range(n), key=ys.__getitem__)
    out: list[tuple[str, list[int]]] = []
    ending = None
    paragraph: list[int] | None = None
    for number, column in enumerate(columns):
        left, previous, kind_before, block = lefts[number], None, None, None
        for place, k in enumerate(column):
            h, y = hs[k], ys[k]
            indent = (xs[k] - left) / body_h
            after = ys[column[place + 1]] - y if place + 1 < len(column) else None
            gap = y - previous if previous is not None else None
            if h > 1.22 * body_h:
                kind = HEAD
            elif k == top and number == 0 and place == 0 and indent < 0.4 and n > 1 and (after is None or after > 2.2 * h) and ys[k] + 1.5 * h < min((ys[j] for j in range(n) if j != k), default=0):
                kind = TITLE
            elif k == foot and indent < 0.4 and n > 1 and gap is not None and gap > 3.2 * h and place == len(column) - 1:
                kind = TITLE
            elif k == foot and indent < 0.4 and n > 1 and gap is None and number == 0 and y - max(ys[j] for j in range(n) if j != k) > 3.2 * h:
                kind = TITLE
            elif indent >= 1.35:
                kind = ADVERT
            else:
                kind = BODY
            if kind == BODY:
                if paragraph is None or indent >= 0.4:
                    paragraph = [k]
                    out.append((BODY, paragraph))
                else:
                    paragraph.append(k)
            elif kind == TITLE:
                if k == foot and k != top:
                    ending = (TITLE, [k])
                else:
                    out.append((TITLE, [k]))
            elif kind == kind_before and block is not None and gap is not None and gap < 1.75 * h:
                block.append(k)
            else:
                block = [k]
                out.append((kind, block))
            if kind == HEAD:
                paragraph = None
            previous, kind_before = y, kind
    if ending:
        out.append(ending)
    return out


#: A line that closes with a mark, and one that opens as a sentence or a block would.
_CLOSED = re.compile(r"[.!?…。！？．؟।॥።|;,][\"'”’»«“)\]」』]*$")
_SMALL = re.compile(r"^\p{Ll}")
#: Share of a full line up to which a line counts as short.
SHORT = 0.74


def plain_blocks(text: str, lines: list[tuple[int, int]]) -> list[tuple[str, list[int]]]:
    """Blocks of a page without boxes, told by the lengths of its lines.

    Short lines without a closing mark, after a finished line or in capitals, are a headline, a
    running title or an advert; what is unfinished before them goes on after them if it opens small.
    """
    words = [text[a:b].strip() for a, b in lines]
    there = [k for k, w in enumerate(words) if w]
    if not there:
        return []
    full = sorted(len(words[k]) for k in there)[int(0.9 * (len(there) - 1))]
    out: list[tuple[str, list[int]]] = []
    body: list[int] | None = None
    place = 0
    while place < len(there):
        k = there[place]
        line = words[k]
        small = _SMALL.match(line) is not None
        number = len(line) < 14 and (line[0] in "—–" or line.startswith("Page "))
        capitals = line.isupper() and sum(c.isalpha() for c in line) > 3
        done = body is None or _CLOSED.search(words[body[-1]]) is not None
        brief = not small and len(line) <= SHORT * full and not _CLOSED.search(line)
        if number or "   " in line and line[-1:] == ".":
            out.append((TITLE, [k]))
            place += 1
            continue
        if capitals or brief and (done or len(line) <= 0.6 * full):
            run = [k]
            while place + len(run) < len(there):
                other = words[there[place + len(run)]]
                if other.isupper() == capitals and (capitals or len(other) <= SHORT * full and not _CLOSED.search(other)):
                    run.append(there[place + len(run)])
                else:
                    break
            after = words[there[place + len(run)]] if place + len(run) < len(there) else ""
            if capitals or not _SMALL.match(after) or not done:
                out.append((HEAD if done else ADVERT, run))
                place += len(run)
                if done:
                    body = None
                continue
        if body is None:
            body = []
            out.append((BODY, body))
        body.append(k)
        place += 1
    return out
