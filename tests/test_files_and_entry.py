"""File formats, generators, the entry module and its SQL."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wayspan import functions as fn
from wayspan.operators import blocks, generate
from wayspan.sources import graph_files as gf

DATA = "/root/testdata/sf0.001"


def test_visits_and_queries_round_trip(spark, rows, tmp_path):
    visits = [(0, 0, 5, 9), (0, 2, 1, 3), (1, 5, 7, 8)]
    df = spark.createDataFrame(visits, "u bigint, v bigint, ts bigint, te bigint")
    gf.write_visits(df, f"{tmp_path}/g")
    assert rows(gf.read_visits(spark, f"{tmp_path}/g/*")) == sorted(visits)
    assert spark.read.text(f"{tmp_path}/g/header").first()[0] == "# 2 6"
    (tmp_path / "q_1").write_text("1 2 3 4\n5 6 7 8\n")
    (tmp_path / "q_0").write_text("9 9 9 9\n")
    assert rows(gf.read_labelled_queries(spark, f"{tmp_path}/q")) == [(0, 1, 2, 3, 4, True), (0, 9, 9, 9, 9, False), (1, 5, 6, 7, 8, True)]
    (tmp_path / "l").write_text("0\n1\n")
    assert rows(gf.read_queries_by_label(spark, f"{tmp_path}/q_1", f"{tmp_path}/l", True)) == [(1, 5, 6, 7, 8)]
    (tmp_path / "empty").write_text("# 1 1\n")
    with pytest.raises(ValueError):
        gf.read_visits(spark, f"{tmp_path}/empty")
    gf.write_queries(gf.read_queries(spark, f"{tmp_path}/q_1"), f"{tmp_path}/out")
    assert rows(gf.read_queries(spark, f"{tmp_path}/out").drop("qid")) == [(1, 2, 3, 4), (5, 6, 7, 8)]
    (tmp_path / "g").joinpath("x").write_text("7 5 3\n")
    assert rows(gf.read_arrivals(spark, f"{tmp_path}/g/x")) == [(7, 5, 3)]


def test_unread_lines(spark, tmp_path):
    (tmp_path / "v").write_text("# 2 2\n0 1 2 3\n0 x 2 3\n\n1 2 3\n1  2\t3 4 5\n")
    assert sorted(r[0] for r in gf.unread_lines(spark, f"{tmp_path}/v", 4).collect()) == ["0 x 2 3", "1 2 3"]


def test_graph_formats(spark, rows, tmp_path):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (0, 1)], "a bigint, b bigint")
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "id bigint")
    assert rows(gf.adjacency_lines(nodes, edges)) == [(0, "0: 1 2 #"), (1, "1: 2 #"), (2, "2: #")]
    assert rows(gf.metis_lines(nodes, edges)) == [(1, "2 3"), (2, "1 3"), (3, "1 2")]
    weighted = [(0, 1, 7, 3), (0, 2, 8, -4), (5, 1, 9, 0)]
    df = spark.createDataFrame(weighted, "src bigint, dst bigint, edge_id bigint, weight bigint")
    gf.write_lines(gf.weighted_lines(df), f"{tmp_path}/w", ["graph_for_greach", "6"])
    assert rows(gf.read_weighted(spark, f"{tmp_path}/w/*")) == weighted
    assert "0 -> 1;" in [r[0] for r in gf.graphviz_lines(edges).collect()]
    (tmp_path / "c").write_text("2\n[4][5]\n[6]\n")
    assert rows(gf.read_chains(spark, str(tmp_path / "c"))) == [(0, 0, 4), (0, 1, 5), (1, 0, 6)]
    (tmp_path / "p").write_text("3\n0\n3\n")
    assert rows(gf.read_parts(spark, str(tmp_path / "p"))) == [(0, 3), (1, 0), (2, 3)]
    (tmp_path / "e").write_text("3\n0 1\n1 2\n")
    assert rows(gf.read_edge_list(spark, str(tmp_path / "e"))) == [(0, 1), (1, 2)]


def test_blocks(spark, rows):
    df = spark.createDataFrame([("a", t, x) for t, x in [(0, 5), (3, None), (11, 2), (50, 9), (51, 1)]], "k string, t bigint, x bigint")
    assert rows(blocks.with_next(df, ["k"], "t", {"n": "t"}, 10).select("t", "n")) == [(0, 3), (3, 11), (11, 50), (50, 51), (51, None)]
    assert rows(blocks.with_running_max(df, ["k"], "t", F.col("x"), "m", 10).select("t", "m")) == [(0, 5), (3, 5), (11, 5), (50, 9), (51, 9)]
    assert rows(blocks.with_rank(df, ["t"]).select("t", "rank")) == [(0, 0), (3, 1), (11, 2), (50, 3), (51, 4)]


def test_generators(spark):
    seconds = [r["seconds"] for r in generate.drawn_lengths(spark.range(5000).withColumnRenamed("id", "k"), "k").collect()]
    assert min(seconds) >= 599 and max(seconds) <= 28_800 and 800 < sorted(seconds)[2500] < 1100
    q = generate.drawn_queries(spark, 500, 10, 100, 200).collect()
    assert all(0 <= r["u"] < 10 and 100 <= r["q_start"] <= r["q_end"] <= 200 for r in q)
    assert generate.drawn_pairs(spark, 300, 5).where("s = t OR s < 0 OR t < 0 OR s > 4 OR t > 4").count() == 0
    assert generate.drawn_digraph(spark, 50, 100).where("a >= b").count() == 0


def test_functions(spark):
    row = spark.range(1).select(
        fn.date_text(F.lit(86_400)).alias("d"), fn.packed(F.lit(1), F.lit(2)).alias("p"), fn.file_stem(F.lit("/a/b.c.txt")).alias("s"), fn.tokens(F.lit(" a-b  c"), " -").alias("t"),
        fn.merged_unique(F.array(F.lit(3), F.lit(1)), F.array(F.lit(1))).alias("m"), fn.symmetric_difference(F.array(F.lit(3), F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("x"), fn.overlaps(F.lit(1), F.lit(3), F.lit(3), F.lit(4)).alias("o"),
    ).first()
    assert tuple(row) == ("1970.01.02", (1 << 32) + 2, "b.c", ["a", "b", "c"], [1, 3], [2, 3], False)


def _same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9))
    return a == b


def _plain(x):
    if x is None or x != x:
        return None
    return x.item() if hasattr(x, "item") else x


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, DATA)
    got, want = df.toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda f: sorted((tuple(_plain(x) for x in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False)), key=str)
    a, b = key(got), key(want)
    assert len(a) == len(b) and all(_same(x, y) for r, s in zip(a, b) for x, y in zip(r, s))


def test_labels_agree_with_answers(spark):
    sure = {r["qid"]: r["verdict"] for r in entry.queries()["label_tests"](spark, DATA).collect() if r["verdict"] != "open"}
    reached = {r["qid"]: r["reachable"] for r in entry.queries()["span_reach"](spark, DATA).collect()}
    assert all(reached[q] == (v != "no") for q, v in sure.items())
    assert entry.queries()["index_size"](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
