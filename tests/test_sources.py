"""Saved advisories, search, schema and the commands."""

import json

from riskgraph import __main__ as commands
from riskgraph.operators import advisories, incremental, matching
from riskgraph.operators.contain import containing
from riskgraph.plans import flow

CVE = {
    "id": "CVE-2021-44228", "published": "2021", "descriptions": [{"lang": "en", "value": "JNDI in log4j"}],
    "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 10.0, "baseSeverity": "CRITICAL"}}]},
    "configurations": [{"nodes": [{"cpeMatch": [{"criteria": "cpe:2.3:a:apache:log4j:*", "versionStartIncluding": "2.0", "versionEndExcluding": "2.15.0"}]}]}],
}


def test_saved_answers(spark, tmp_path):
    (tmp_path / "nvd").mkdir(), (tmp_path / "ghsa").mkdir()
    low = {**CVE, "id": "CVE-LOW", "metrics": {"cvssMetricV30": [{"cvssData": {"baseScore": 3.9, "baseSeverity": "LOW"}}]}}
    again = {**CVE, "descriptions": [{"lang": "en", "value": "second"}]}
    (tmp_path / "nvd" / "a.json").write_text(json.dumps({"vulnerabilities": [{"cve": CVE}, {"cve": low}, {"cve": again}]}, indent=1))
    one = {"ghsa_id": "GHSA-1", "summary": "s", "severity": "high", "vulnerabilities": [{"package": {"name": "org.acmecorp:widget", "ecosystem": "maven"}, "vulnerable_version_range": "< 2.0"}]}
    known = {**one, "cve_id": "CVE-2021-44228"}
    (tmp_path / "ghsa" / "b.json").write_text(json.dumps([one, known]))
    cves = matching.normalised_cves(advisories.saved_entries(spark, str(tmp_path / "nvd")))
    assert [(r["id"], r["description"], r["cvss_score"]) for r in cves.collect()] == [("CVE-2021-44228", "JNDI in log4j", 10.0)]
    both = advisories.with_advisories(cves, advisories.advisories_as_cves(advisories.saved_advisories(spark, str(tmp_path / "ghsa"))))
    assert sorted(r["id"] for r in both.collect()) == ["CVE-2021-44228", "GHSA-1"]
    deps = [("d1", "org.apache.logging.log4j", "log4j-core", "2.14.1", "org.apache"), ("d2", "org.apache.logging.log4j", "log4j-core", "2.17.0", "org.apache"), ("d3", "org.acmecorp", "widget", "1.0", "x"), ("d4", "org.acmecorp", "widget", "unknown", "y")]
    nodes, edges = advisories.linked(both, spark.createDataFrame(deps, "dep_id string, group_id string, artifact_id string, version string, package string"))
    got = {(r["cve_id"], r["dep_id"]) for r in edges.collect()}
    # as in the original an edge goes to every dependency of the group and artifact, whatever its version
    assert got == {("CVE-2021-44228", "d1"), ("CVE-2021-44228", "d2"), ("GHSA-1", "d3")} and nodes.count() == 2


def test_a_range_of_versions_matches_once(spark):
    """Ten adjacent ranges 2.i.0 to 2.(i+1).0: a version lies in exactly one."""
    bound = "struct<criteria:string,versionStartIncluding:string,versionStartExcluding:string,versionEndIncluding:string,versionEndExcluding:string>"
    rows = [(f"CVE-{i}", [([([("cpe:2.3:a:apache:log4j:*", f"2.{i}.0", None, None, f"2.{i + 1}.0")],)],)]) for i in range(10)]
    cves = spark.createDataFrame(rows, f"id string, configurations array<struct<nodes:array<struct<cpeMatch:array<{bound}>>>>>")
    deps = spark.createDataFrame([("d", "org.apache.logging.log4j", "log4j-core", "2.5.5")], "dep_id string, group_id string, artifact_id string, version string")
    assert [r["cve_id"] for r in matching.vulnerable_dependencies(deps, cves).collect()] == ["CVE-5"]


def test_containing_is_containment(spark):
    texts, needles = ["abcabcab", "xyz", "", "bca", "cab abc", None, "the abcabd"], ["abcab", "bca", "z", "", None, "q", "abcabcabc", "abcabd"]
    got = containing(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in needles], "needle string"))
    assert sorted(map(tuple, got.collect())) == sorted((n, t) for n in needles for t in texts if n and t is not None and n in t)


def test_schema_and_cleaning(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "k long, v string")
    got = {(r["table"], r["fault"]): r["count"] for r in incremental.schema_faults({"t": df}, {"t": ("k",)}).collect()}
    assert got == {("t", "repeated key"): 1, ("t", "null key"): 1}
    flow.saved({"t": df, "u": df}, str(tmp_path / "g"))
    assert flow.cleaned(spark, str(tmp_path / "g"), ["t"]) == ["t"] and flow.cleaned(spark, str(tmp_path / "g")) == ["u"]
    assert "Scan" in flow.explained({"q": df})["q"]


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "A.java").write_text("package p;\npublic class A { @GetMapping public void a() { b(); } void b() { } }\n")
    commands.main(["ingest", str(tmp_path / "r"), str(tmp_path / "g"), "--no-history"])
    commands.main(["analyse", str(tmp_path / "g")])
    got = {r["name"]: r["in_degree"] for r in spark.read.parquet(str(tmp_path / "g" / "scored_method")).collect()}
    assert got == {"a": 0, "b": 1}
    commands.main(["query", "U13_severity", "/root/testdata/sf0.001"])
    assert "CVE-2024-0000" in capsys.readouterr().out
