"""Commands: ``ingest ROOT OUT``, ``analyse OUT``, ``report OUT`` and ``query NAME DIR``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from riskgraph import plans
from riskgraph.operators import advisories, matching
from riskgraph.plans import flow, report, sources

TABLES = [*flow.CODE_ORDER, "commit", "developer", "parent", "file_version", "changed", "dependency", "depends_on", "missing", "cve", "affects"]


def main(argv: list[str] | None = None) -> None:
    ask = argparse.ArgumentParser(prog="riskgraph", description=__doc__)
    commands = ask.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ingest", help="read a clone and write its graph tables")
    one.add_argument("root"), one.add_argument("out"), one.add_argument("--cves", help="saved answers of the vulnerability list"), one.add_argument("--advisories", help="saved advisories")
    one.add_argument("--resolved", help="a build tool's listing"), one.add_argument("--no-history", action="store_true")
    commands.add_parser("analyse", help="write scores onto the methods").add_argument("out")
    two = commands.add_parser("report", help="print the risk register")
    two.add_argument("out"), two.add_argument("--format", default="markdown", choices=("markdown", "json")), two.add_argument("--top", type=int, default=20)
    three = commands.add_parser("query", help="show a query over test tables")
    three.add_argument("name", choices=sorted(plans.QUERIES)), three.add_argument("folder")
    asked = ask.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if asked.command == "ingest":
        cves = matching.normalised_cves(advisories.saved_entries(spark, asked.cves)) if asked.cves else None
        if asked.advisories:
            more = advisories.advisories_as_cves(advisories.saved_advisories(spark, asked.advisories))
            cves = more if cves is None else advisories.with_advisories(cves, more)
        flow.saved(flow.ingest(spark, asked.root, cves, not asked.no_history, asked.resolved), asked.out)
    elif asked.command == "query":
        plans.QUERIES[asked.name](spark, asked.folder).show(50, truncate=False)
    else:
        there = [n for n in TABLES if spark._jvm.org.apache.hadoop.fs.Path(f"{asked.out}/{n}").getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{asked.out}/{n}"))]
        g = flow.opened(spark, asked.out, there)
        if asked.command == "analyse":
            flow.require_calls(g.calls)
            flow.saved({"scored_method": flow.scored_methods(g.method, g.calls)}, asked.out)
        else:
            print(report.rendered(sources.numbered(sources.risk_report(g, asked.top)), asked.format, asked.top))


if __name__ == "__main__":
    main()
