"""Operators on small hand-made tables."""

import subprocess

import pytest
from pyspark.sql import functions as F

from riskgraph import durable
from riskgraph.functions import names, versions
from riskgraph.operators import community, hierarchy, incremental, ladders, matching, rank, writers
from riskgraph.operators.history import bus_factor, co_changes
from riskgraph.operators.reach import hops_from, routes_to
from riskgraph.plans import report
from riskgraph.sources import build_files, git_log, java_source


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


def test_pagerank_orders_triangle(spark):
    nodes = spark.createDataFrame([("A",), ("B",), ("C",)], "id string")
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C")], "src string, dst string")
    got = {r["id"]: r["pagerank"] for r in rank.pagerank(nodes, edges, "id").collect()}
    assert got["C"] > got["B"] > got["A"] == pytest.approx(0.15)


def test_hops_and_routes(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "a")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "method_signature string")
    assert values(hops_from(start, edges), "node", "hops") == [("a", 0), ("b", 1), ("c", 2), ("x", 1)]
    goal = spark.createDataFrame([("c",)], "method_signature string")
    got = {r["node"]: (r["hops"], r["route"]) for r in routes_to(goal, edges).collect()}
    assert got["a"] == (2, ["a", "b", "c"]) and got["c"] == (0, ["c"])
    assert routes_to(goal, edges.limit(0)).count() == 1


def test_co_change_and_bus_factor(spark):
    changed = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("2", "b"), ("2", "b"), ("3", "a")], "sha string, path string")
    commit = spark.createDataFrame([(s,) for s in "123"], "sha string").withColumn("date", F.lit("2001-01-01").cast("timestamp"))
    assert values(co_changes(changed, commit, 2)) == [("a", "b", 2, pytest.approx((2 / 3 + 1) / 2))]
    assert co_changes(changed, commit, 1, most_files=1).count() == 0
    people = spark.createDataFrame([("f", "x", 5), ("f", "y", 3), ("f", "z", 2), ("g", "x", 1), ("g", "y", 1), ("g", "z", 1)], "path string, email string, commits long")
    assert values(bus_factor(people, "path")) == [("f", 1), ("g", 2)]


def test_louvain_and_betweenness(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(4) for j in range(i)]
    edges = spark.createDataFrame(clique("a") + clique("b") + [("a0", "b0")], "src string, dst string")
    got = community.louvain(edges)
    single = got.select("node", F.col("node").alias("community"))
    assert community.modularity(edges, got) > community.modularity(edges, single)
    of = {r["node"]: r["community"] for r in got.collect()}
    assert len({of[f"a{i}"] for i in range(4)}) == 1 and of["a1"] != of["b1"]
    line = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    assert values(community.betweenness(line)) == [("a", 0.0), ("b", 2.0), ("c", 2.0), ("d", 0.0)]
    with pytest.raises(ValueError):
        community.betweenness(line, most_edges=1)


def test_type_ladder(spark):
    types = spark.createDataFrame([("T", "p", "1"), ("T", "q", "2"), ("U", "p", "3")], "name string, package string, file string")
    refs = spark.createDataFrame([(1, "T", "p", "9"), (2, "T", "z", "2"), (3, "U", "z", "9"), (4, "T", "z", "9")], "ref int, name string, package string, file string")
    got = {r["ref"]: r["target"]["file"] for r in ladders.type_references(refs, types).collect()}
    assert got == {1: "1", 2: "2", 3: "3"}


def test_call_ladder(spark):
    methods = spark.createDataFrame([("A#a", "a", "A", "A.java", 0, False), ("A#b", "b", "A", "A.java", 1, False), ("B#s", "s", "B", "B.java", 2, True), ("B#a", "a", "B", "B.java", 0, False)], "sig string, name string, owner string, file string, arity int, is_static boolean")
    calls = spark.createDataFrame([(1, "A#a", "same_class", "b", "A", 1, "A", "A.java"), (2, "A#a", "same_class", "b", "A", 3, "A", "A.java"), (3, "A#a", "static", "s", "B", 9, "A", "A.java"), (4, "A#b", "instance", "a", "B", 0, "A", "A.java")], "id int, src string, kind string, name string, target string, argc int, owner string, file string")
    assert values(ladders.call_edges(calls, methods), "src", "dst") == [("A#a", "A#b"), ("A#a", "B#s"), ("A#b", "B#a")]


def test_frontier_ranks(spark):
    calls = spark.createDataFrame([("m", "f", "static", "go", "Lib", "org.x", "explicit_import"), ("m", "f", "instance", "go", "Lib", "org.x", "explicit_import"), ("m", "f", "static", "w", "Any", "org.w", "wildcard_import"), ("m", "f", "static", "j", "List", "java.util", "explicit_import"), ("m", "f", "static", "u", None, None, "unresolved")], "src string, file string, kind string, name string, target string, package string, resolution string")
    imports = spark.createDataFrame([("f", "org.x.Lib", False, "external"), ("f", "org.w", True, "external")], "file string, import_path string, is_wildcard boolean, kind string")
    got = ladders.external_frontier(calls, imports)
    assert values(got, "import_path", "method_name", "confidence_rank", "call_count") == [("org.w", "w", 1, 1), ("org.x.Lib", "go", 3, 2)]
    assert ladders.merged_frontier(got, got).count() == 2


def test_versions(spark):
    rows = [("2.14.1", "2.0", None, None, "2.15.0", True), ("2.17.0", "2.0", None, None, "2.15.0", False), ("2.0", None, "2.0", None, None, False), ("nope!", None, None, "9", None, False), ("1.0", None, None, "bad!", None, True)]
    df = spark.createDataFrame(rows, "v string, a string, b string, c string, d string, want boolean")
    assert df.filter(versions.within("v", "a", "b", "c", "d") != F.col("want")).count() == 0
    one = spark.createDataFrame([(" 'v2_12.0.' ", ">= 1.2, < 2.0", "[1.0,2.0)")], "v string, r string, m string")
    got = one.select(versions.cleaned(F.col("v")), versions.advisory_range(F.col("r")), versions.representatives(F.col("m"))).first()
    assert got[0] == "2.12.0" and got[1]["start_including"] == "1.2" and got[1]["end_excluding"] == "2.0" and got[2] == ["1.0", "2.0"]


def test_vulnerable_dependencies(spark):
    deps = spark.createDataFrame([("d1", "org.apache.logging.log4j", "log4j-core", "2.14.1"), ("d2", "org.apache.logging.log4j", "log4j-core", "2.17.0"), ("d3", "org.acmecorp", "widget", "1.5")], "dep_id string, group_id string, artifact_id string, version string")
    bound = "struct<criteria:string,versionStartIncluding:string,versionStartExcluding:string,versionEndIncluding:string,versionEndExcluding:string>"
    cves = spark.createDataFrame(
        [("CVE-1", [([([("cpe:2.3:a:apache:log4j:*", "2.0", None, None, "2.15.0")],)],)]), ("CVE-2", [([([("cpe:2.3:a:acmecorp:widget:*", None, None, "2.0", None)],)],)])],
        f"id string, configurations array<struct<nodes:array<struct<cpeMatch:array<{bound}>>>>>",
    )
    assert values(matching.vulnerable_dependencies(deps, cves)) == [("CVE-1", "d1", 1.0, "precise_gav"), ("CVE-2", "d3", 0.7, "fuzzy")]


def test_import_prefixes(spark):
    imports = spark.createDataFrame([("org.acme.lib.Core",), ("com.other.X",)], "import_path string")
    deps = spark.createDataFrame([("1", "org.acme", None), ("2", "org.acme.lib.deep.er", None), ("3", "net.z", "com.other")], "dep_id string, group_id string, package string")
    assert values(matching.import_dependencies(imports, deps)) == [("com.other.X", "3"), ("org.acme.lib.Core", "1"), ("org.acme.lib.Core", "2")]


def test_names(spark):
    df = spark.createDataFrame([("[INFO] +- org.a:b:jar:1.0:compile",), ("org.a:b:jar:tests:2.0:test",), ("x:y",), ("a:jar:1",), ("a:b:${v}",)], "l string")
    got = [r[0] and tuple(r[0]) for r in df.select(names.coordinate(F.col("l"))).collect()]
    assert got == [("org.a", "b", "1.0"), ("org.a", "b", "2.0"), None, None, None]
    p = spark.createDataFrame([("src/test/java/A.java", True), ("src\\Test\\A.java", True), ("src/main/Attest/A.java", False), ("tests/x", True), (None, False)], "p string, want boolean")
    assert p.filter(names.in_test_path(F.col("p")) != F.col("want")).count() == 0


def test_incremental_equals_full(spark):
    schema = "file string, sig string"
    base = {"method": spark.createDataFrame([("A", "a1"), ("A", "a2"), ("B", "b1"), ("C", "c1")], schema)}
    fresh = {"method": spark.createDataFrame([("A", "a1"), ("A", "a3"), ("D", "d1")], schema)}
    diff = spark.createDataFrame([("M", "A.java", None), ("D", "C.java", None), ("R100", "B.java", "D.java"), ("A", "x.txt", None)], "code string, old string, new string")
    touched = incremental.changes(diff).withColumn("path", F.regexp_replace("path", r"\.java$", ""))
    full = spark.createDataFrame([("A", "a1"), ("A", "a3"), ("D", "d1")], schema)
    assert incremental.same_rows(incremental.patched(base, fresh, touched)["method"], full)
    assert incremental.ingest_mode(known=False)[0] == "full" and incremental.ingest_mode()[0] == "incremental"


def test_build_files(spark, tmp_path):
    (tmp_path / "pom.xml").write_text("<project><properties><v>3.14.0</v></properties><dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>m</artifactId><version>9</version></dependency></dependencies></dependencyManagement><dependencies><dependency><groupId>org.apache.commons</groupId><artifactId>commons-lang3</artifactId><version>${v}</version></dependency><dependency><groupId>g</groupId><artifactId>m</artifactId></dependency></dependencies></project>")
    (tmp_path / "build.gradle").write_text("def slf4jVersion = '2.0.13'\ndependencies {\n implementation \"org.slf4j:slf4j-api:${slf4jVersion}\"\n testImplementation group: 'j', name: 'u', version: '4'\n}\n")
    got = values(build_files.declared_dependencies(spark, str(tmp_path)), "group_id", "artifact_id", "version", "scope")
    assert got == [("g", "m", "9", "compile"), ("j", "u", "4", "test"), ("org.apache.commons", "commons-lang3", "3.14.0", "compile"), ("org.slf4j", "slf4j-api", "2.0.13", "compile")]
    assert build_files.version_catalog('[versions]\na="1"\n[libraries]\nx-y = { module = "g:n", version.ref = "a" }\n') == {"x.y": ("g", "n", "1")}


JAVA = '''package com.example;
import org.lib.Tool;
import static org.lib.Stat.go;
/** A class. */
@Deprecated
public class A extends Base<String> implements One, Two {
  private Tool tool; // field
  public static int b(int x, final String... y) throws java.io.IOException {
    if (x > 0 && y != null) { this.c(); Helper.help(1, f(2, 3)); }
    switch (x) { case 1: break; default: }
    Tool t = new Tool("a{b");
    t.run(); tool.stop();
    return x;
  }
  void c() {}
  enum E { X, Y; int q() { return 1; } }
  record R(int n) {}
}
'''


def test_java_structure(spark, tmp_path):
    (tmp_path / "A.java").write_text(JAVA)
    files = java_source.java_files(spark, str(tmp_path))
    assert values(java_source.exploded(files, "types"), "name", "kind") == [("A", "class"), ("E", "enum"), ("R", "record")]
    methods = {r["name"]: r for r in java_source.exploded(files, "methods").collect()}
    assert set(methods) == {"b", "c", "q"} and methods["b"]["complexity"] == 4 and methods["b"]["throws"] == ["java.io.IOException"]
    calls = {(r["qualifier"], r["name"], r["argc"], r["receiver_source"]) for r in java_source.exploded(files, "calls").collect()}
    assert calls == {("this", "c", 0, None), ("Helper", "help", 2, None), ("", "f", 2, None), ("new", "Tool", 1, None), ("t", "run", 0, "local"), ("tool", "stop", 0, "field")}
    assert files.select("error", F.size("imports"), F.size("docs")).first()[0:3] == (None, 2, 2)


def test_git_log(spark, tmp_path):
    def git(*a):
        subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", "-C", str(tmp_path), *a], check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "a.java").write_text("1\n2\n")
    git("add", "."), git("commit", "-qm", "one")
    git("mv", "a.java", "b.java"), git("commit", "-qm", "two")
    tables = git_log.history_tables(spark, str(tmp_path))
    assert tables["commit"].count() == 2 and tables["parent"].count() == 1
    assert values(tables["changed"], "path", "change_type", "renamed_from", "additions") == [("a.java", "A", None, 2), ("b.java", "R", "a.java", 0)]
    one = spark.read.format("gitlog").option("commitsPerPartition", 1).load(str(tmp_path))
    assert one.rdd.getNumPartitions() == 2 and sorted(r["message"] for r in one.collect()) == ["one", "two"]
    first = spark.read.format("gitlog").load(str(tmp_path)).filter("message = 'one'").first()["sha"]
    assert git_log.history_tables(spark, str(tmp_path), since=first)["commit"].count() == 1


def test_report(spark):
    df = spark.createDataFrame([(1, "CVE|1", 9.8), (2, "CVE-2", None)], "position int, cve_id string, score double")
    assert "CVE\\|1 | 9.8000" in report.rendered(df) and '"position": 1' in report.rendered(df, "json", 1)
    assert report.envelope("t", df, limit=1)["truncated"] and not report.envelope("t", error="x")["ok"]
    with pytest.raises(ValueError):
        report.checked_hops(0)
    assert report.checked_coordinate("g:a:1") == ("g", "a", "1")


def test_chains_of_any_length(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 41), (41, 40)], "child long, parent long")
    got = hierarchy.chains(edges, spark.createDataFrame([(0,), (40,), (99,)], "child long")).collect()
    assert max(r["size"] for r in got) == 31 and sorted(r["size"] for r in got if r["chain"][0] == 40) == [2]
    assert hierarchy.chains(edges.limit(0), edges.select("child")).count() == 0


def test_tables_need_a_shared_folder():
    class Far:
        master = "spark://far:7077"

    class Session:
        sparkContext, conf = Far(), {}

    with pytest.raises(ValueError):
        durable.shared_dir(Session())


def test_methods_of_lists_in_any_order(spark):
    import random

    method = "struct<name:string,owner:string,line:int,last_line:int,modifiers:array<string>,returns:string,params:array<struct<type:string,name:string>>,throws:array<string>,annotations:array<string>,complexity:int,deprecated:boolean>"
    one = lambda i: (f"m{i}", "A", i % 3, 9, ["public"], "void", [("A", "p")], [], ["Override"], 1, False)
    files = spark.createDataFrame([("A.java", "p", {}, [], [one(i) for i in range(40)] + [one(0)])], f"path string, package string, explicit map<string,string>, wildcards array<string>, methods array<{method}>")

    def again(rows):
        for row in rows:
            row["methods"] = [random.SystemRandom().sample(list(x), len(x)) for x in row["methods"]]
            yield row

    types = spark.createDataFrame([("A", "p", "A.java")], "name string, package string, file string")
    got = writers.method_tables(files.mapInPandas(again, files.schema), types, types.limit(0))
    assert all(got[t].count() == 40 for t in ("method", "parameter", "annotated"))
    assert got["parameter"].filter("type = 'A' and type_file = 'A.java'").count() == 40


def test_committers_of_all_vulnerable_files(spark):
    from itertools import product

    from riskgraph.plans import team

    # 60 vulnerabilities, files 0 to 13 of two dependencies; the later a file, the more commits
    paths = [f"F{i:02}" for i in range(14)]
    cves, deps = [(f"C{i:02}", 7.0 + i % 3) for i in range(60)], ["d1", "d2"]
    changes = [(f"{p}-{d}-{k}", p, f"dev{d}") for i, p in enumerate(paths) for d in range(4) for k in range(1 + (i + d) % 15)]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    g = writers.TableGraph(
        spark,
        {
            "cve": table([*cves, ("low", 6.9)], "id string, cvss_score double"), "affects": table([(c, d) for c, _ in [*cves, ("low", 0)] for d in deps], "cve_id string, dep_id string"),
            "depends_on": table([(f"i{d}", d) for d in deps], "import_path string, dep_id string"), "imports": table([(p, f"i{d}") for p in paths for d in deps], "path string, import_path string"),
            "changed": table([(s, p, 1, 1) for s, p, _ in changes], "sha string, path string, additions long, deletions long"), "commit": table([(s, e) for s, _, e in changes], "sha string, author_email string").withColumn("date", F.lit("2001-01-01").cast("timestamp")),
            "developer": table([("dev0", "a"), ("dev0", "b"), ("dev1", "c"), ("dev2", "d"), ("dev3", "e")], "email string, name string"),
        },
    )
    commits = {(p, e): len({s for s, q, f in changes if (q, f) == (p, e)}) for _, p, e in changes}
    want = sorted(((c, d, p, e, n) for (c, _), d, ((p, e), n) in product(cves, deps, commits.items())), key=lambda r: (-r[4], *r[:4]))[:100]
    assert [tuple(r) for r in team.vulnerable_file_committers(g).collect()] == want
    assert [tuple(r) for r in team.vulnerable_file_committers(g, 3).collect()] == want[:3]


def brandes(edges):
    """Betweenness of every node, one source after another."""
    after = {}
    for s, t in set(edges):
        after.setdefault(s, set()).add(t)
    nodes = {x for e in edges for x in e}
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        order, paths, dist = [s], {s: 1.0}, {s: 0}
        for v in order:
            for t in after.get(v, ()):
                if t not in dist:
                    dist[t], paths[t] = dist[v] + 1, 0.0
                    order.append(t)
                if dist[t] == dist[v] + 1:
                    paths[t] += paths[v]
        share = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            share[v] = sum(paths[v] / paths[t] * (1 + share[t]) for t in after.get(v, ()) if dist[t] == dist[v] + 1)
            total[v] += share[v] if v != s else 0.0
    return total


def test_betweenness_of_any_size(spark, monkeypatch):
    import random

    deal = random.Random(5)
    edges = [(f"a{deal.randrange(60)}", f"a{deal.randrange(60)}") for _ in range(150)] + [(f"{c}{deal.randrange(6)}", f"{c}{deal.randrange(6)}") for c in "bcdefg" for _ in range(9)]
    df = spark.createDataFrame([*edges, ("x", None)], "src string, dst string")
    want = {k: pytest.approx(v) for k, v in brandes(edges).items()}
    as_dict = lambda df: {r["node"]: r["betweenness"] for r in df.collect()}
    assert as_dict(community.betweenness(df)) == want
    # components cut into shares of sources, few sources side by side
    monkeypatch.setattr(community, "PART_WORK", 3000)
    monkeypatch.setattr(community, "PACK_EDGES", 10)
    assert as_dict(community.betweenness(df, parts=3)) == want
    # more edges than a task was once allowed
    many = spark.range(250_001).select(F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("m"), "id").alias("dst"))
    many = many.unionByName(many.select(F.col("dst").alias("src"), F.concat("src", F.lit("z")).alias("dst")))
    assert community.betweenness(many).groupBy("betweenness").count().orderBy("betweenness").collect() == [(0.0, 500_002), (1.0, 250_001)]


def test_import_prefixes_of_many_dependencies(spark):
    from itertools import product

    words = ["a", "b", "a.b", "b.a", "a.b.c", "a.b.", "a..b", "ab.c", "a.b.c.d.e", "b.c.d", "", None]
    deps = [(f"d{i}", g, p) for i, (g, p) in enumerate(product(words, words))] + [(None, "a.b", "a"), ("d1", "c", "b.x")]
    paths = [w for w in words if w] + ["a.b.c.d.e.f", "c.x", "a.x"]
    imports = spark.createDataFrame([(p,) for p in [*paths, *paths, None]], "import_path string")
    heads = {p: [".".join(p.split(".")[:n]) for n in (2, 3, 4) if n <= len(p.split("."))] for p in paths}
    match = lambda h, n: h == n or n.startswith(h + ".") or h.startswith(n + ".")
    want = {(p, d) for p, (d, *names) in product(paths, deps) if any(match(h, n) for h in heads[p] for n in names if n)}
    got = matching.import_dependencies(imports, spark.createDataFrame(deps, "dep_id string, group_id string, package string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    # the matches are neither shuffled nor told apart after they are joined
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.lstrip().startswith("Aggregate")


def test_call_ladder_by_brute_force(spark):
    import random

    deal = random.Random(3)
    pick = lambda *x: deal.choice(x)
    methods = [(f"s{i}", pick("f", "g"), pick("A", "B", "C"), pick("1", "2", "3"), pick(0, 1, None), pick(True, False)) for i in range(25)]
    calls = [(i, f"s{i % 25}", pick("this", "same_class", "static", "instance", "super"), pick("f", "g", "h"), pick("A", "B", "Z", None), pick(0, 1, 2, None), pick("A", "C"), pick("1", "2", "9")) for i in range(300)]
    creates = [(f"s{i}", pick("A", "B"), pick("1", "2", "3")) for i in range(20)]
    want = set()
    for _, src, kind, name, target, argc, owner, file in calls:
        named = [m for m in methods if m[1] == name]
        fit = [m for m in named if argc is None or m[4] is None or m[4] == argc]
        if kind in ("this", "same_class"):
            steps = [[m for m in fit if m[3] == file and m[2] == o] for o in (target, owner)]
        elif kind == "static":
            steps = [[m for m in named if m[5] and m[2] == target]]
        else:
            alone = [m for m in fit if m[3] == file]
            steps = [[m for m in fit if m[2] == target], [m for m in fit if m[2] == owner and m[3] == file], [m for m in fit if (src, m[2], m[3]) in creates], alone if len(alone) == 1 else []]
        want |= {(src, m[0], kind) for m in next(filter(None, steps), [])}
    got = ladders.call_edges(
        spark.createDataFrame(calls, "id int, src string, kind string, name string, target string, argc int, owner string, file string"),
        spark.createDataFrame(methods, "sig string, name string, owner string, file string, arity int, is_static boolean").limit(1000),
        spark.createDataFrame(creates, "src string, type string, file string"),
    )
    assert values(got) == sorted(want)
    # no table of methods goes to the driver, whatever its size seems to be
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
