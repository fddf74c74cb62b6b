"""The whole run over files: load visits and labelled queries, build, answer, report; and the data tools.

    python -m wayspan.plans.pipeline answer --inputPath G --queryFilePath Q --outputPath R [--minBlock 4] [--delta N] [--algorithm fixpoint|contracted|TopChain|PathTree]
    python -m wayspan.plans.pipeline tool --mode GenerateRfile|FixDataSet|GenerateQuery|PrintMetisInfo --inputPath G --outputPath R [--parts P] [--queryNum N]
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayspan.operators import dag, fragments as fr, generate, labels, reach
from wayspan.session import cut, local_session
from wayspan.sources import graph_files as gf

#: fixpoint: no index. The others go through fragments and classes, and within a fragment by a walk, by chain labels and orders first, or by path labels.
ALGORITHMS = ("fixpoint", "contracted", "TopChain", "PathTree")


def answer(spark: SparkSession, visits: DataFrame, queries: DataFrame, k: int = 4, delta: int = 2**31 - 1, algorithm: str = "fixpoint") -> tuple[DataFrame, DataFrame]:
    """Answers (qid, reachable) and a one-row report of a graph of visits and a batch of queries.

    queries: qid, u, w, q_start, q_end and, if it is there, expected, of which the answers that
    disagree are counted. Visits are clipped to one at a time for each visitor.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm must be one of {ALGORITHMS}")
    took: dict[str, float] = {}
    clock = time.time()

    def lap(name: str) -> None:
        nonlocal clock
        took[name], clock = round((time.time() - clock) * 1000, 1), time.time()

    clipped = cut(dag.clip_visits(visits))
    meeting = cut(dag.meeting_visits(clipped)[0])
    slot = cut(dag.slots(meeting))
    moved = cut(dag.moves(dag.with_last_slot(meeting, slot)))
    edge = cut(dag.edges(slot, moved, delta))
    lap("Trans_time_ms")
    frag = cut(fr.fragments(slot, k))
    cutting = cut(fr.with_fragments(edge, frag))
    n_cut = fr.edge_cut(cutting).first()
    lap("Partition_time_ms")
    report = {"Frag_num": k, "indexing_method": algorithm, "Connection_latency_threshold_s": delta, "DAG_node_num": slot.count(), "DAG_edge_num": edge.count(), "edge_cut": n_cut["cut_ratio"] or 0.0}
    ends = cut(reach.endpoints(queries, meeting, slot))
    lap("Endpoint_time_ms")
    if algorithm != "fixpoint":
        classes = cut(fr.classes(frag, cutting))
        is_ = lambda *r: F.col("row").isin(*r)
        sizes = classes.agg(F.count_if(is_("out_class", "in_class")).alias("c"), F.count_if(is_("entry")).alias("b"), F.coalesce(F.sum(F.when(is_("out_class", "in_class"), F.col("n"))), F.lit(0)).alias("e")).first()
        report |= {"ConGraph_node_num": sizes["c"] + sizes["b"], "ConGraph_edge_num": sizes["e"] + sizes["b"]}  # a class and its border slots; a border slot and its class
        lap("EqSet_time_ms")
        table = cut(labels.label_table(frag, cutting, classes)) if algorithm == "TopChain" else None
        if algorithm == "PathTree":
            report["n_paths"] = cut(labels.path_cover(frag, cutting)).select("frag", "path").distinct().count()
        lap("local_indexing_time_ms")
    report["Index_construction_time_ms"] = round(sum(took.values()) - took["Endpoint_time_ms"], 1)

    def batch(asked: DataFrame, name: str) -> DataFrame:
        mine = ends.join(asked.select("qid").distinct(), "qid", "left_semi")
        if algorithm == "fixpoint":
            got = reach.reachable(asked, dag.with_runs(moved, delta), mine)
        else:
            if algorithm == "TopChain":
                yes = labels.label_verdicts(mine, frag, cutting, classes, table).where("verdict <> 'no'").select("qid")
            else:
                yes = fr.contracted_reach(mine, frag, cutting, classes, local=labels.path_hits if algorithm == "PathTree" else None)
            got = asked.select("qid").distinct().join(yes.withColumn("_yes", F.lit(True)), "qid", "left").select("qid", F.coalesce("_yes", F.lit(False)).alias("reachable"))
        got = cut(got)
        lap(f"Total{name}_ms")
        report[f"Avg{name}_us"] = round(took[f"Total{name}_ms"] * 1000 / max(1, got.count()), 1)
        return got

    if "expected" in queries.columns:
        got = batch(queries.where("expected"), "PosQuery").unionByName(batch(queries.where("NOT coalesce(expected, false)"), "NegQuery"))
        report["n_disagree"] = got.join(queries.select("qid", "expected"), "qid").where("reachable <> expected").count()
    else:
        got = batch(queries, "Query")
    counts = got.agg(F.count("*").alias("n"), F.count_if("reachable").alias("yes")).first()
    report |= {"n_queries": counts["n"], "n_reachable": counts["yes"], "Memory_GB": memory_gb(spark)} | took
    return got, spark.createDataFrame([tuple(report.values())], list(report))


def memory_gb(spark: SparkSession) -> float:
    """Heap the driver's JVM has taken at most so far, in GB."""
    pools = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans()
    return round(sum(p.getPeakUsage().getUsed() for p in pools) / 2**30, 3)


def tool(spark: SparkSession, mode: str, source: str, target: str, parts: str | None = None, n: int = 4) -> DataFrame | None:
    """One of the data tools; returns what it wrote, or shows for PrintMetisInfo."""
    if mode == "GenerateRfile":
        rows = gf.with_line_numbers(gf.read_arrivals(spark, source), "rec_id")
        out = generate.visits_of_arrivals(rows)
    elif mode == "FixDataSet":
        rows = gf.with_line_numbers(gf.read_visits(spark, source), "rec_id")
        out = generate.redrawn_ends(rows).drop("rec_id")
    elif mode == "GenerateQuery":
        low, high, top = gf.read_visits(spark, source).agg(F.min("ts"), F.max("te"), F.max("u")).first()
        out = generate.drawn_queries(spark, n, top + 1, low, high)
        gf.write_queries(out, target)
        return out
    elif mode == "PrintMetisInfo":
        return part_report(spark, gf.read_visits(spark, source), gf.read_parts(spark, parts))
    else:
        raise ValueError(f"unknown mode {mode}")
    gf.write_visits(out, target)
    return out


def part_report(spark: SparkSession, visits: DataFrame, parts: DataFrame) -> DataFrame:
    """For an outside partition of the slots (node = place in time order): src_part, dst_part, n_edges, and the time range of src_part."""
    meeting = cut(dag.meeting_visits(dag.clip_visits(visits))[0])
    slot = cut(dag.slots(meeting))
    edge = dag.edges(slot, dag.moves(dag.with_last_slot(meeting, slot)))
    from wayspan.operators.blocks import with_rank

    frag = with_rank(slot.select("v", "slot_start", "slot_end"), ["slot_start", "slot_end", "v"], "node").join(parts, "node")
    frag = cut(frag.select("v", "slot_start", "slot_end", F.col("part").alias("frag")))
    matrix = fr.fragment_matrix(fr.with_fragments(edge, frag))
    times = fr.fragment_times(frag).withColumnRenamed("frag", "src_frag")
    return matrix.join(times, "src_frag").select(F.col("src_frag").alias("src_part"), F.col("dst_frag").alias("dst_part"), "n_edges", "first_start", "last_end")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("what", choices=("answer", "tool"))
    for name in ("inputPath", "outputPath", "queryFilePath", "mode", "parts"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--algorithm", default="fixpoint", choices=ALGORITHMS)
    parser.add_argument("--minBlock", type=int, default=4)
    parser.add_argument("--queryNum", type=int, default=4)
    parser.add_argument("--delta", type=int, default=2**31 - 1)
    for name in ("inputTestPath", "maxBlock", "reach", "numStep", "splitData"):
        parser.add_argument(f"--{name}", help="accepted, has no effect")
    a = parser.parse_args(args)
    spark = SparkSession.getActiveSession() or local_session()
    if a.what == "tool":
        found = tool(spark, a.mode, a.inputPath, a.outputPath, a.parts, a.queryNum)
        if a.mode == "PrintMetisInfo":
            found.show(1000)
        return
    queries = gf.read_labelled_queries(spark, a.queryFilePath)
    queries = queries.withColumn("qid", F.col("qid") * 2 + (~F.col("expected")).cast("int"))
    got, report = answer(spark, gf.read_visits(spark, a.inputPath), queries, a.minBlock, a.delta, a.algorithm)
    got.join(queries, "qid").write.mode("overwrite").parquet(f"{a.outputPath}/answers")
    gf.write_report(report, f"{a.outputPath}/report")


if __name__ == "__main__":
    main()
