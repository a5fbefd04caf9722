from riskgraph.operators import matching


def test_names_anywhere_in_the_criteria(spark):
    deps = [
        ("d1", "io.nettyproject", "io-netty", "1.0"), ("d2", "org.apache.commons", "commons-lang3", "1.0"), ("d3", "com.acmecorp", "widget", "1.0"),
        ("d4", "com.acmecorp", "gadget", "1.0"), ("d5", "com.othercorp", "widget", "1.0"), ("d6", "com.acmecorp", "core", "1.0"),
    ]
    criteria = ["cpe:2.3:a:nettyproject:io-netty:*", "cpe:2.3:a:apache:commons_lang3:*", "cpe:2.3:a:acmecorp:superwidget_core:*"]
    bound = "struct<criteria:string,versionStartIncluding:string,versionStartExcluding:string,versionEndIncluding:string,versionEndExcluding:string>"
    cves = spark.createDataFrame([(f"CVE-{i}", [([([(c, None, None, "2.0", None)],)],)]) for i, c in enumerate(criteria)], f"id string, configurations array<struct<nodes:array<struct<cpeMatch:array<{bound}>>>>>")
    got = matching.vulnerable_dependencies(spark.createDataFrame(deps, "dep_id string, group_id string, artifact_id string, version string"), cves)
    assert sorted(map(tuple, got.collect())) == [("CVE-0", "d1", 0.7, "fuzzy"), ("CVE-1", "d2", 1.0, "precise_gav"), ("CVE-2", "d3", 0.7, "fuzzy")]
