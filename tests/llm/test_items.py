"""Pairs and frequent values against brute force."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from wayspan.llm import pairs
from wayspan.llm.frequent import heavy_values, shared_values, top_values
from wayspan.llm.pairs import cooccurrence


def brute_pairs(data, least, lift):
    baskets = {}
    for u, d, v in data:
        if None not in (u, d, v):
            baskets.setdefault((u, d), set()).add(v)
    n, one, two = len(baskets), Counter(), Counter()
    for b in baskets.values():
        one.update(b)
        two.update(combinations(sorted(b), 2))
    return sorted((a, b, c, one[a], one[b], n) for (a, b), c in two.items() if c >= least and c * n >= lift * one[a] * one[b])


@pytest.mark.parametrize("least,lift,block", [(1, 0, 256), (1, 0, 4), (3, 2, 4), (6, 3, 3), (2, 0, 5)])
def test_pairs(spark, rows, monkeypatch, least, lift, block):
    monkeypatch.setattr(pairs, "BLOCK_ITEMS", block)
    r = random.Random(least)
    data = [(r.choice([None, 1, 2, 3, 4]), r.randint(0, 6), r.choice([None, 7, 7, r.randint(0, 30)])) for _ in range(500)]
    data += [(99, d, v) for d in range(4) for v in range(0, 60, 2)] + data[:20]
    df = spark.createDataFrame(data, "u bigint, day bigint, v bigint").withColumn("n", F.lit(1)).withColumn("a", F.lit(2))
    got = cooccurrence(df, ["u", "day"], "v", least, lift)
    assert rows(got.select("a", "b", "n_ab", "n_a", "n_b", "n")) == brute_pairs(data, least, lift)
    row = got.first()
    if row:
        assert row["lift"] == pytest.approx(row["n_ab"] * row["n"] / row["n_a"] / row["n_b"])


def test_pairs_of_nothing(spark):
    empty = spark.createDataFrame([], "u bigint, day bigint, v bigint")
    assert cooccurrence(empty, ["u", "day"], "v", 2, 2).count() == 0
    single = spark.createDataFrame([(1, 1, 1), (1, 1, None)], "u bigint, day bigint, v bigint")
    assert cooccurrence(single, ["u", "day"], "v").count() == 0


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_frequent(spark, rows, kind):
    r = random.Random(1)
    data = [None if r.random() < 0.05 else (r.randint(0, 9) if r.random() < 0.5 else r.randint(0, 3000)) for _ in range(6000)]
    df = spark.createDataFrame([(x,) for x in data], "n bigint").select(F.col("n").cast(kind).alias("x"))
    convert = str if kind == "string" else int
    count = Counter(convert(x) for x in data if x is not None)
    assert rows(heavy_values(df, "x", 20)) == sorted((x, n) for x, n in count.items() if n >= 20)
    total = sum(count.values())
    assert rows(shared_values(df, "x", 20)) == sorted((x, n) for x, n in count.items() if n * 1000 >= total * 20)
    for k in (1, 5, 40):
        assert sorted(rows(top_values(df, "x", k))) == sorted(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:k])


def test_frequent_of_little(spark, rows):
    df = spark.createDataFrame([(3,), (3,), (None,), (4,)], "v bigint")
    assert rows(top_values(df, "v", 10)) == [(3, 2), (4, 1)]
    assert top_values(df.limit(0), "v", 3).count() == 0 and shared_values(df.limit(0), "v", 2).count() == 0
    assert rows(heavy_values(df, "v", 2)) == [(3, 2)]


def test_frequent_with_more_prefixes_than_are_worth_a_lookup(spark, rows, monkeypatch):
    from wayspan.llm import frequent

    monkeypatch.setattr(frequent, "MOST_PREFIXES", 3)
    data = [x for x in range(5000) for _ in range(1 + (x % 500 == 0))]
    df = spark.createDataFrame([(x,) for x in data], "x bigint")
    want = sorted(Counter(data).items(), key=lambda x: (-x[1], x[0]))
    assert rows(top_values(df, "x", 7)) == sorted(want[:7]) and rows(top_values(df, "x", 30)) == sorted(want[:30])
