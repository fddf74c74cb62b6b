"""Queries answered in one pass in order of time, by blocks of lanes, against brute force."""

import random

import numpy as np
import pytest
from graph_brute import wedge

from wayspan.operators import reach

EDGE = "src bigint, dst bigint, depart bigint, duration bigint"
WINDOW = "qid bigint, source bigint, t_start bigint, t_end bigint"


def passages(asks, edges):
    want = {}
    for q, source, low, high in asks:
        for leave in {t for a, _, t, _ in edges if a == source and low <= t <= high}:
            arrival = {source: leave}
            for _ in edges:
                for a, b, t, n in edges:
                    if n >= 0 and a in arrival and t >= arrival[a] and t + n <= min(high, arrival.get(b, high + 1) - 1):
                        arrival[b] = t + n
            for v, t in arrival.items():
                if v != source:
                    want[q, v] = min(t - leave, want.get((q, v), t - leave))
    return sorted((q, v, n) for (q, v), n in want.items())


def test_fastest_over_more_places_than_rounds(spark, rows, monkeypatch):
    monkeypatch.setattr(reach, "MOST_ROUNDS", 3)
    edges = spark.createDataFrame([(k, k + 1, 10 * k, 7) for k in range(40)], EDGE)
    ask = spark.createDataFrame([(0, 0, 0, 1_000), (1, 30, 0, 377)], WINDOW)
    assert rows(reach.fastest(ask, edges)) == [(0, k, 10 * k - 3) for k in range(1, 41)] + [(1, k, 10 * (k - 30) - 3) for k in range(31, 39)]


@pytest.mark.parametrize("seed, lanes, day", [(0, 512, 1), (1, 2, 1), (2, 3, 20_000)])
def test_fastest_in_blocks(spark, rows, monkeypatch, seed, lanes, day):
    monkeypatch.setattr(reach, "PASSAGE_LANES", lanes, raising=False)
    r = random.Random(seed)
    edges = [(r.randint(0, 5), r.randint(0, 5), day * r.randint(0, 30), day * r.choice([0, 0, 1, 2, 9, -1])) for _ in range(70)]
    asks = [(k, r.randint(0, 6), *(day * t for t in sorted((r.randint(-3, 35), r.randint(0, 45))))) for k in range(12)]
    asks += asks[:1]
    want = passages(asks, edges)
    assert len(want) > 20
    assert rows(reach.fastest(spark.createDataFrame(asks, WINDOW), spark.createDataFrame(edges, EDGE))) == want


VISIT = "u bigint, v bigint, ts bigint, te bigint"
QUERY = "qid bigint, u bigint, w bigint, q_start bigint, q_end bigint"


def wedge_rows(spark, visits, asks, width=7):
    got = reach.wedge_reachable(spark.createDataFrame(asks, QUERY), spark.createDataFrame(visits, VISIT), width)
    return [r["reachable"] for r in got.orderBy("qid").collect()]


def crowd(seed, n_u, n_v, n, width):
    r, out = random.Random(seed), []
    for u in range(n_u):
        t = r.randint(0, width)
        for _ in range(n):
            t += r.choice([0, 0, 1, 5])
            d = r.randint(1, width)
            out.append((u, min(r.randint(0, n_v - 1), r.randint(0, n_v - 1)), t, t + d))
            t += d
    top = max(x[3] for x in out)
    asks = [(k, r.randint(0, n_u), r.randint(0, n_u - 1), *sorted((r.randint(0, top), r.randint(0, top + 5)))) for k in range(60)]
    return out, asks


def test_wedge_over_more_visitors_than_rounds(spark, monkeypatch):
    monkeypatch.setattr(reach, "MOST_ROUNDS", 3)
    visits = []
    for k in range(40):  # k meets k + 1 at place k
        visits += [(k, k, 10 * k, 10 * k + 5), (k + 1, k, 10 * k + 2, 10 * k + 6)]
    asks = [(0, 0, 40, 0, 396), (1, 0, 40, 0, 395), (2, 40, 0, 0, 500), (3, 0, 40, 5, 500)]
    assert wedge_rows(spark, visits, asks) == [True, False, False, False]


@pytest.mark.parametrize("seed, lanes, width", [(0, 1_024, 7), (1, 7, 3)])
def test_wedge_in_blocks(spark, monkeypatch, seed, lanes, width):
    monkeypatch.setattr(reach, "WEDGE_LANES", lanes, raising=False)
    visits, asks = crowd(seed, 8, 3, 6, 9)
    want = [wedge(visits, *q[1:]) for q in asks]
    assert 10 < sum(want) < 50
    assert wedge_rows(spark, visits, asks, width) == want


@pytest.mark.parametrize("seed, n_u, n_v, n, width", [(0, 60, 2, 10, 40), (1, 120, 1, 4, 300), (2, 40, 5, 12, 6)])
def test_sets_of_crowded_places_are_united(seed, n_u, n_v, n, width):
    from wayspan.operators.sweep import wedges

    visits, asks = crowd(seed, n_u, n_v, n, width)
    asks = [q for q in asks if q[1] != q[2]] * 2
    rows = sorted((ts, u, v, te) for u, v, ts, te in visits)
    parts = [[np.array(c) for c in zip(*rows[k : k + 50])] for k in range(0, len(rows), 50)]
    lanes = [np.array(c) for c in zip(*[(k, u, w, low, high) for k, (_, u, w, low, high) in enumerate(asks)])]
    yes = {int(k) for out in wedges(*lanes, parts) for k in out[0]}
    want = [wedge(visits, *q[1:]) for q in asks[: len(asks) // 2]] * 2
    assert 0 < sum(want) < len(want)
    assert [k in yes for k in range(len(asks))] == want
