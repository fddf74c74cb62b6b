"""The run over files, both ways, and the tools."""

import json
import glob

import pytest
from graph_brute import answer, graph

from wayspan.plans import pipeline
from wayspan.sources import graph_files as gf

VISITS = [(0, 0, 0, 10), (1, 0, 5, 10), (1, 1, 20, 30), (2, 1, 25, 35), (3, 1, 29, 40)]


@pytest.mark.parametrize("algorithm", pipeline.ALGORITHMS)
def test_answer(spark, tmp_path, algorithm):
    (tmp_path / "g").write_text("# 4 2\n" + "".join("%d %d %d %d\n" % v for v in VISITS))
    asked = [(a, b, 0, e) for a in range(4) for b in range(4) for e in (26, 40)]
    g = graph(VISITS)
    for want in (True, False):
        (tmp_path / f"q_{int(want)}").write_text("".join("%d %d %d %d\n" % q for q in asked if answer(g, *q) == want))
    pipeline.main(["answer", "--inputPath", f"{tmp_path}/g", "--queryFilePath", f"{tmp_path}/q", "--outputPath", f"{tmp_path}/out", "--algorithm", algorithm])
    report = json.loads(open(glob.glob(f"{tmp_path}/out/report/*.json")[0]).read())
    assert report["n_disagree"] == 0 and report["n_queries"] == len(asked) and report["DAG_node_num"] == len(g[0])
    assert report["AvgPosQuery_us"] > 0 and report["TotalNegQuery_ms"] > 0 and report["Memory_GB"] > 0 and ("ConGraph_edge_num" in report) == (algorithm != "fixpoint")
    with pytest.raises(ValueError):
        pipeline.answer(spark, None, None, algorithm="none")


def test_tools(spark, tmp_path):
    (tmp_path / "a").write_text("# 2 2\n0 100 1\n0 700 0\n1 100 1\n")
    pipeline.main(["tool", "--mode", "GenerateRfile", "--inputPath", f"{tmp_path}/a", "--outputPath", f"{tmp_path}/v"])
    visits = gf.read_visits(spark, f"{tmp_path}/v/*").collect()
    assert sorted((r["u"], r["v"], r["ts"]) for r in visits) == [(0, 0, 700), (0, 1, 100), (1, 1, 100)]
    assert all(600 <= r["te"] - r["ts"] for r in visits if r["ts"] != 100 or r["u"]) and all(r["te"] <= 700 for r in visits if (r["u"], r["ts"]) == (0, 100))
    pipeline.main(["tool", "--mode", "FixDataSet", "--inputPath", f"{tmp_path}/v/*", "--outputPath", f"{tmp_path}/w"])
    pipeline.main(["tool", "--mode", "GenerateQuery", "--inputPath", f"{tmp_path}/v/*", "--outputPath", f"{tmp_path}/q", "--queryNum", "9"])
    assert gf.read_queries(spark, f"{tmp_path}/q").count() == 9
    (tmp_path / "g").write_text("# 4 2\n" + "".join("%d %d %d %d\n" % v for v in VISITS))
    (tmp_path / "p").write_text("".join(f"{k // 3}\n" for k in range(len(graph(VISITS)[0]))))
    found = pipeline.tool(spark, "PrintMetisInfo", f"{tmp_path}/g", "", f"{tmp_path}/p")
    assert found.groupBy().sum("n_edges").first()[0] == len(graph(VISITS)[1])
    with pytest.raises(ValueError):
        pipeline.tool(spark, "nothing", "", "")
