"""Analyst tools and run records."""

import os

import pytest

from riskgraph.catalog import fixture_graph
from riskgraph.operators import incremental, provenance
from riskgraph.plans import tools

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_tools_answer(spark):
    g = fixture_graph(spark, DATA)
    assert tools.graph_summary(g)["rows"][0]["files"] == 200
    assert tools.cve_reachability(g, "CVE-2024-0001", 99)["ok"] is False
    assert tools.dependency_cves(g, "no coordinate")["ok"] is False
    every, out = tools.risk_register(g, 0.0, limit=100), tools.unreachable_cves(g)
    assert {r["cve_id"] for r in out["rows"]} == {r["cve_id"] for r in every["rows"] if r["status"] != "REACHABLE"}
    reached = next(r["cve_id"] for r in every["rows"] if r["status"] == "REACHABLE")
    assert tools.cve_reachability(g, reached)["rows"][0]["min_hops"] == 0
    dep = g.dependency.first()
    assert tools.dependency_cves(g, f"{dep['group_id']}:{dep['artifact_id']}:{dep['version']}")["ok"]
    assert tools.ownership(g, "src.m3")["rows"] and tools.hotspots(g, None, 3)["rows"][2]["score"] > 0 and tools.blast_radius(g, "src/m3/F13.java", 1)["ok"]


def test_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    a = provenance.record(spark, path, "u", "main", "s1", "full")
    provenance.record(spark, path, "u", "main", "s1", "full", "success", a)
    provenance.record(spark, path, "u", "main", "s2", "incremental")
    last = incremental.last_success(provenance.runs(spark, path), "u", "main").collect()
    assert [r["head_sha"] for r in last] == ["s1"]
