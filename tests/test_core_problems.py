"""Components, sessions, selection and rejects against brute force, with nulls, ties, repeats and clashing names."""

import random
import time

import pytest
from brute import components, line_reason, sessions as brute_sessions
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from wayspan.operators.components import interval_components, sessions
from wayspan.operators.selection import bucket_of, key_quantiles, key_splits, select_ranks
from wayspan.sources.rejects import parse_lines

VISIT = "u bigint, v bigint, ts bigint, te bigint"


def drawn_visits(n, seed, span=400):
    r = random.Random(seed)
    maybe = lambda x: None if r.random() < 0.03 else x
    out = []
    for _ in range(n):
        v = 1 if r.random() < 0.5 else r.randint(2, 8)
        ts = r.randrange(0, span, r.choice([1, 1, 10]))
        out.append((maybe(r.randint(0, 9)), maybe(v), maybe(ts), maybe(ts + r.randint(-2, 9))))
    return out + out[:20]


@pytest.mark.parametrize("bucket", [3, 17, 10_000])
def test_components(spark, rows, bucket):
    data = drawn_visits(900, bucket, 3000)
    df = spark.createDataFrame(data, VISIT).select("*", F.lit("x").alias("n"), F.lit(1).alias("bucket"), F.lit(2).alias("c_start"))
    assert rows(interval_components(df, bucket)) == components(data)


def test_component_that_runs_over_many_buckets(spark, rows):
    data = [(0, 1, 0, 500)] + [(k, 1, k, k + 1) for k in range(1, 60)] + [(9, 1, 500, 501), (9, 1, 600, 610), (8, 1, 605, 700)] + [(k, 1, 610 + k, 612 + k) for k in range(40)]
    assert rows(interval_components(spark.createDataFrame(data, VISIT), 4)) == components(data)


def test_components_of_nothing(spark):
    assert interval_components(spark.createDataFrame([], VISIT)).count() == 0
    assert interval_components(spark.createDataFrame([(None, 1, 2, 3), (1, 1, 3, 3), (1, 1, 4, 3)], VISIT)).count() == 0


@pytest.mark.parametrize("width", [7, 50, 86_400])
def test_sessions(spark, rows, width):
    r = random.Random(width)
    data = [(None if r.random() < 0.02 else (5 if r.random() < 0.6 else r.randint(0, 4)), None if r.random() < 0.02 else r.randint(-200, 4000), r.choice([1, 2, None])) for _ in range(500)]
    df = spark.createDataFrame(data + data[:30], "u bigint, ts bigint, v bigint").withColumn("cid", F.lit(1))
    assert rows(sessions(df, 20, width)) == brute_sessions(data, 20)


def test_buckets_by_default_cut_hot_nodes(spark, rows, monkeypatch):
    from wayspan.operators import components as c

    cut_at = []
    monkeypatch.setattr(c, "key_splits", lambda *a: cut_at.append(key_splits(*a)) or cut_at[-1])
    data = drawn_visits(3000, 9, span=3000) + [(k, 1, 2 * k, 2 * k + 3 - k % 2) for k in range(4000)]
    got = c.interval_components(spark.createDataFrame(data, "u bigint, v bigint, ts bigint, te bigint"))
    assert rows(got) == components(data)
    assert sum(len(r["splits"]) for r in cut_at[0].collect()) > 3


@pytest.mark.parametrize("most", [1, 2, 5, 8])
def test_bucket_of(spark, most):
    splits = list(range(0, 10 * most, 10))
    df = spark.createDataFrame([(splits, x) for x in range(-3, 10 * most + 3)] + [(None, 1)], "s array<bigint>, x bigint")
    for r in df.select("s", "x", bucket_of("s", "x", most).alias("b")).collect():
        assert r["b"] == (None if r["s"] is None else sum(k <= r["x"] for k in splits))


def test_sessions_gap_is_inclusive_and_empty(spark, rows):
    df = spark.createDataFrame([(1, 0, 1), (1, 3600, 1), (1, 7201, 1)], "u bigint, ts bigint, v bigint")
    assert rows(sessions(df)) == [(1, 0, 3600, 3600, 2, 2), (1, 7201, 7201, 0, 1, 1)]
    assert sessions(df.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 11])
def test_select_ranks(spark, rows, bits):
    r = random.Random(bits)
    data = [(r.choice("aab"), r.choice([r.randint(-(2**40), 2**40), r.randint(-3, 3)])) for _ in range(300)] + [("a", None), (None, 1)]
    by = {k: sorted(x for y, x in data if y == k and x is not None) for k in "ab"}
    want = [("a", 0), ("a", 7), ("a", len(by["a"]) - 1), ("a", len(by["a"])), ("b", 5), ("c", 0)]
    got = select_ranks(spark.createDataFrame(data, "k string, x bigint"), spark.createDataFrame(want, "k string, rank bigint"), "k", "x", bits)
    assert rows(got) == sorted((k, i, by[k][i]) for k, i in want if k in by and i < len(by[k]))


def test_quantiles_of_hot_and_cold_keys(spark, rows):
    r = random.Random(4)
    data = [(r.choice([1, 1, 1, 1, r.randint(2, 40)]), r.choice([None, 5, r.randint(0, 10**6)])) for _ in range(2000)]
    by = {}
    for k, x in data:
        if x is not None:
            by.setdefault(k, []).append(x)
    want = sorted((k, len(x), sorted(x)[(len(x) - 1) // 2], sorted(x)[9 * (len(x) - 1) // 10]) for k, x in by.items())
    got = key_quantiles(spark.createDataFrame(data, "k bigint, x bigint"), "k", "x", {"p50": 0.5, "p90": 0.9})
    assert rows(got.select("k", "n", "p50", "p90")) == want
    assert key_quantiles(spark.createDataFrame([], "k bigint, x bigint"), "k", "x", {"p50": 0.5}).count() == 0


FEED = [(1, ",", 4, 100, 50), (2, " ", 5, 100, 50), (3, "\t", 5, 1000, 50), (4, "|", 4, 10**18, 10**18), (5, ";", 5, 100, 50)]


def reasons(spark, lines, feed=FEED):
    raw = spark.createDataFrame([(k, f, k + 2, x) for k, (f, x) in enumerate(lines)], "line_id bigint, feed_id bigint, line_no int, raw string").withColumn("sep", F.lit("clash"))
    got = parse_lines(raw, spark.createDataFrame(feed, "feed_id bigint, sep string, n_cols int, n_upper bigint, n_lower bigint").withColumn("raw", F.lit(0)))
    return {r["line_id"]: r for r in got.collect()}


def expected(lines):
    by = {f[0]: f[1:] for f in FEED}
    return [line_reason(x, *by[f]) if f in by else "columns" for f, x in lines]


def test_reject_cases(spark):
    a, b = 1_700_000_000, 1_700_000_600
    lines = [
        (1, f"1,2,{a},{b}"), (1, f"1,2,{a},{b}\r"), (1, f"1,2,{a},{b}\r\r"), (1, f' "1" , 2,"{a}",{b} '), (1, f'1,2,{a},"{b}'), (1, f'"1"x,2,{a},{b}'),
        (1, f'1"1",2,{a},{b}'), (1, f'" 1",2,{a},{b}'), (1, f"1,2,{a},{b},"), (1, f"1,2,{a}"), (1, None), (1, ""), (1, " "), (1, f"100,2,{a},{b}"), (1, f"99,50,{a},{b}"),
        (1, f"99,49,946684799,{b}"), (1, f"99,49,946684800,{b}"), (1, f"99,49,{b},{b}"), (1, f"99,49,{a},4102444800"), (1, f"+1,2,{a},{b}"), (1, f"٣,2,{a},{b}"), (1, f"1\xa0,2,{a},{b}"),
        (2, f'1 2 {a} {b} "a b"'), (2, f"1 2 {a} {b} x y"), (2, f"1  2 {a} {b}"), (2, f"1 2 {a} {b} "), (2, f'1 2 {a} {b} "a ""b"""'), (2, f'1 2 {a} {b} "a"b"'),
        (3, f'1\t2\t{a}\t{b}\t"line\nfeed"'), (3, f'1\t2\t{a}\t{b}\t"open\nfeed'), (3, f"1\t2\t{a}\t{b}\tplain\nfeed"), (3, f'1\t2\t{a}\t{b}\t"x" y'),
        (4, f"123456789012345678|2|{a}|{b}"), (4, f"1234567890123456789|2|{a}|{b}"), (4, f"0000000000000000001|2|{a}|{b}"), (5, f'1;2;{a};{b};""'), (5, f"1;2;{a};{b};"), (5, f"1;2;{a};{b};{'x' * 300_000}"),
        (9, f"1,2,{a},{b}"), (None, "x"), (1, f"1,2,{a},{b}"), (1, "\x00,2,3,4"), (1, f"#1,2,{a},{b}"), (5, f"1;2;{a};{b};"),
    ]
    got = reasons(spark, lines)
    assert [got[k]["reason"] for k in range(len(lines))] == expected(lines)
    assert tuple(got[0])[1:] == (1, 2, a, b, None, None)
    assert got[28]["note"] == "line\nfeed" and got[26]["note"] == 'a "b"'
    assert got[4]["u"] is None


def test_a_batch_full_of_open_quotes(spark):
    a, b = 1_700_000_000, 1_700_000_600
    lines = [(1, f'1,2,{a},"{b}') if k % 100 else (1, f"1,2,{a},{b}") for k in range(100_000)] + [(3, f'1\t2\t{a}\t{b}\t"x')] * 500 + [(3, f'1\t2\t{a}\t{b}\t"x"')]
    began = time.time()
    got = reasons(spark, lines)
    assert time.time() - began < 60
    assert [k for k, r in got.items() if r["reason"] is None] == [*range(0, 100_000, 100), len(lines) - 1]
    assert {r["reason"] for r in got.values()} == {None, "quoting"}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([1, 2, 3, 5]), st.lists(st.sampled_from(['"', '""', ",", " ", "\t", ";", "1", "7", "1700000000", "1700000009", "\n", "x", "\r"]), max_size=12).map("".join)), min_size=60, max_size=200))
def test_reject_reasons_of_any_lines(spark, lines):
    got = reasons(spark, lines)
    assert [got[k]["reason"] for k in range(len(lines))] == expected(lines)
