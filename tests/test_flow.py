"""From a small clone to graph tables, full and incremental, and the queries on them."""

import subprocess

import pytest
from pyspark.sql import functions as F

from riskgraph.catalog import fixture_graph
from riskgraph.operators import advisories, incremental, reach, writers
from riskgraph.plans import flow
from riskgraph.plans.security import risk_register

JAVA = {
    "A.java": """package com.example;
import org.acmecorp.widget.Client;
import org.acmecorp.wild.*;

/** Entry of the web. */
@RestController
public class A extends Base implements Api {
    @Autowired private B helper;
    /** Starts all. */
    @GetMapping("/a")
    public void a(int n) throws java.io.IOException {
        B b = new B();
        b.b();
        helper.over("x", 1);
        Util.stat();
        this.own();
        Client.send(n);
    }
    void own() { Unknown.call(); }
    public static void main(String[] args) { new A().a(1); }
    static class Inner { }
}
""",
    "B.java": """package com.example;
public class B {
    public void b() { }
    public void over(String s) { }
    public void over(String s, int n) { lonely(); }
    private void lonely() { }
}
""",
    "Base.java": "package com.example;\npublic abstract class Base { }\n",
    "Api.java": "package com.example;\npublic interface Api extends Wide { }\n",
    "Wide.java": "package com.other;\npublic interface Wide { void w(); }\n",
    "Util.java": "package com.example;\nclass Util { static void stat() { } void inst() { } }\n",
}
POM = """<project><dependencies><dependency><groupId>org.acmecorp</groupId><artifactId>widget</artifactId><version>1.5</version></dependency></dependencies></project>"""
ADVISORY = ("CVE-1", "G-1", "in widget", None, "high", (7.5,), "2024-01-01", None, [(("org.acmecorp:widget", "maven"), ">= 1.0, < 2.0"), (("left-pad", "npm"), "< 1")])


@pytest.fixture(scope="module")
def clone(tmp_path_factory):
    root = tmp_path_factory.mktemp("clone")
    for name, text in JAVA.items():
        (root / "src" / name).parent.mkdir(exist_ok=True)
        (root / "src" / name).write_text(text)
    (root / "pom.xml").write_text(POM)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=N", "-c", "user.email=n@x", *a], check=True, capture_output=True)
    git("init", "-q"), git("add", "-A"), git("commit", "-qm", "one")
    return root


@pytest.fixture(scope="module")
def tables(spark, clone):
    cves = advisories.advisories_as_cves(spark.createDataFrame([ADVISORY], advisories.ADVISORY))
    return flow.ingest(spark, str(clone), cves)


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_code(tables):
    assert got(tables["directory"], "path") == [("src",)] and tables["file"].filter("path = 'src/A.java' and method_count = 3").count() == 1
    assert got(tables["extends"], "child", "parent") == [("A", "Base")] and got(tables["implements"], "class_name", "interface") == [("A", "Api")]
    assert got(tables["interface_extends"], "child", "parent") == [("Api", "Wide")] and got(tables["nested"], "child", "parent") == [("Inner", "A")]
    sig = {r["name"]: r["method_signature"] for r in tables["method"].filter("class_name = 'A'").collect()}
    assert sig["a"] == "com.example.A#a(int):void"
    calls = {(s.split("#")[1].split("(")[0], d.split(".")[-1].split("#")[0] + "#" + d.split("#")[1]) for s, d in got(tables["calls"], "src", "dst")}
    assert calls == {("a", "B#b():void"), ("a", "B#over(String,int):void"), ("a", "Util#stat():void"), ("a", "A#own():void"), ("over", "B#lonely():void"), ("main", "A#a(int):void")}
    assert ("com.example.A#a(int):void", "B") in got(tables["creates"], "src", "type")
    assert got(tables["annotated"].filter("name = 'GetMapping'"), "method_signature") == [(sig["a"],)] and got(tables["throws"], "exception") == [("java.io.IOException",)]
    outside = got(tables["calls_external"], "import_path", "method_name", "confidence_rank")
    # the only wildcard stands for every type that no import names
    assert ("org.acmecorp.widget.Client", "send", 3) in outside and ("org.acmecorp.wild", "call", 1) in outside and {r for *_, r in outside} == {1, 3}
    docs = {r["text"]: (r["method_signature"], r["class_name"]) for r in tables["doc"].collect()}
    assert docs["/** Starts all. */"] == (sig["a"], None) and docs["/** Entry of the web. */"] == (None, "A")
    assert tables["field"].filter("name = 'helper' and autowired").count() == 1 and got(tables["parameter"].filter("type = 'B'"), "name") == []
    assert got(tables["changed"], "path")[0] == ("pom.xml",)


def test_queries_on_a_clone(spark, tables):
    assert got(tables["affects"], "cve_id", "match_type") and got(tables["cve"], "id", "severity") == [("CVE-1", "HIGH")]
    g = writers.TableGraph(spark, tables, fixture_graph(spark, "/nowhere"))
    row = reach.triage(g).first()
    assert (row["status"], row["min_hops"]) == ("REACHABLE", 0)
    assert risk_register(g).first()["cve_id"] == "CVE-1"
    scored = flow.scored_methods(tables["method"], tables["calls"])
    assert {"pagerank", "in_degree", "total_degree"} <= set(scored.columns)
    assert got(flow.central_summary(scored), "measure") == [("pagerank",), ("total_degree",)]
    with pytest.raises(ValueError):
        flow.require_calls(tables["calls"].limit(0))
    counts = {r["kind"]: r["count"] for r in flow.census({n: tables[n] for n in ("file", "method", "calls")}).collect()}
    assert counts["file"] == 6


def test_saved_and_exported(spark, tables, tmp_path):
    some = {n: tables[n] for n in ("file", "method", "calls")}
    flow.saved(some, str(tmp_path / "g"))
    g = flow.opened(spark, str(tmp_path / "g"), list(some))
    assert incremental.same_rows(g.calls, tables["calls"])
    flow.exported({n: tables[n] for n in ("commit", "developer", "changed")}, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv" / "commits")).columns == ["sha", "date", "message", "author_email"]


def test_incremental_equals_full(spark, tmp_path):
    """A file modified, one added, a method deleted, an import dropped, a file deleted."""
    for name, text in JAVA.items():
        (tmp_path / name).write_text(text)
    base = flow.parsed(spark, str(tmp_path))
    base.write.parquet(str(tmp_path / "rows"))
    base = spark.read.parquet(str(tmp_path / "rows"))
    (tmp_path / "A.java").write_text(JAVA["A.java"].replace("import org.acmecorp.wild.*;\n", "").replace("b.b();", "b.fresh();"))
    (tmp_path / "B.java").write_text(JAVA["B.java"].replace("private void lonely() { }", "").replace("public void b() { }", "public void fresh() { new C().c(); }"))
    (tmp_path / "C.java").write_text("package com.example;\nclass C { void c() { } }\n")
    (tmp_path / "Util.java").unlink()
    touched = incremental.changes(spark.createDataFrame([("M", "A.java", None), ("M", "B.java", None), ("A", "C.java", None), ("D", "Util.java", None)], "code string, old string, new string"))
    full = flow.parsed(spark, str(tmp_path))
    step = writers.code_tables(flow.reread(base, flow.parsed(spark, str(tmp_path), touched), touched))
    want = writers.code_tables(full)
    assert set(step) == set(want)
    for name in want:
        a, b = ([str(r) for r in t[name].collect()] for t in (step, want))
        assert sorted(a) == sorted(b), name
    assert ("com.example.B#fresh():void", "com.example.C#c():void") in got(step["calls"], "src", "dst")


def test_versions_filled(spark):
    deps = spark.createDataFrame([("g", "a", None), ("g", "b", "unknown"), ("h", "c", "1"), ("x", "y", None)], "group_id string, artifact_id string, version string")
    known = spark.createDataFrame([("g", "a", "2"), ("h", "c", "9")], "group_id string, artifact_id string, version string")
    assert sorted(got(flow.with_versions(deps, known), "artifact_id", "version"), key=str) == [("a", "2"), ("b", "2"), ("c", "1"), ("y", None)]


def test_unreadable_java_is_scanned():
    from riskgraph.sources import java_source

    before = java_source._Parser.run
    java_source._Parser.run = lambda self: (_ for _ in ()).throw(KeyError("x"))
    try:
        row = java_source.parse(JAVA["A.java"], "A.java")
    finally:
        java_source._Parser.run = before
    assert row["error"] == "KeyError" and row["package"] == "com.example" and [t["name"] for t in row["types"]] == ["A", "Inner"]
    assert [(m["name"], m["owner"]) for m in row["methods"]] == [("a", "A"), ("own", "A"), ("main", "A")] and len(row["imports"]) == 2 and row["docs"]


def test_runs_full_then_incremental(spark, tmp_path):
    root = tmp_path / "c"
    root.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=N", "-c", "user.email=n@x", *a], check=True, capture_output=True)
    for name in ("B.java", "Util.java"):
        (root / name).write_text(JAVA[name])
    git("init", "-q"), git("add", "-A"), git("commit", "-qm", "one")
    assert flow.run(spark, str(root), str(tmp_path / "g"), "u")[0] == "full"
    (root / "B.java").write_text(JAVA["B.java"].replace("lonely();", "Util.stat();"))
    git("mv", "Util.java", "Tool.java")
    git("add", "-A"), git("commit", "-qm", "two")
    mode, folder, step = flow.run(spark, str(root), str(tmp_path / "g"), "u")
    assert mode == "incremental" and folder.endswith(str(step["commit"].filter("message = 'two'").first()["sha"]))
    want = writers.code_tables(flow.parsed(spark, str(root)))
    for name in ("file", "method", "calls", "type"):
        assert sorted(str(r) for r in step[name].collect()) == sorted(str(r) for r in want[name].collect()), name
    assert [d.split("#")[1] for _, d in got(step["calls"], "src", "dst")] == ["stat():void"]
