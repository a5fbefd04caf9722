"""Commit histories: a Python data source over a local clone, ``format("gitlog")``.

The driver lists the commits, and each partition reads ``commitsPerPartition`` of them, so a
task holds no whole history. Two passes, one for names and one for line counts, since one
log cannot carry both. The option ``since`` bounds what git is asked for; clones must be
where the executors find them.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "sha string, author_name string, author_email string, date string, parents string, message string, file_path string, change_type string, renamed_from string, additions long, deletions long"
MARK, BODY = "\x1e", "\x1d"


def git(repo: str, *args: str, asked: str | None = None) -> str:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True, input=asked.encode() if asked is not None else None)
    return done.stdout.decode("utf-8", "replace")


def is_ancestor(repo: str, old: str, new: str) -> bool:
    return subprocess.run(["git", "-C", repo, "merge-base", "--is-ancestor", old, new], capture_output=True).returncode == 0


def changed_names(repo: str, old: str, new: str) -> list[tuple[str, str, str | None]]:
    """Rows (code, old path, new path) of what differs between two commits."""
    fields, out = iter(git(repo, "diff", "--name-status", "-z", "-M", old, new).split("\0")), []
    for code in fields:
        if code:
            first = next(fields)
            out.append((code[0], first, next(fields) if code[0] in "RC" else None))
    return out


def parse_names(log: str) -> Iterator[tuple[list[str], list[tuple[str, str, str | None]]]]:
    """Header fields and (code, path, old path) of each commit of a -z --name-status log."""
    for block in log.split(MARK)[1:]:
        head, _, rest = block.partition(BODY)
        fields = [f for f in rest.lstrip("\0\n").split("\0")]
        changes, i = [], 0
        while i < len(fields) - 1 and fields[i].strip():
            code = fields[i].strip()
            if code[0] in "RC":
                changes.append((code[0], fields[i + 2], fields[i + 1]))
                i += 3
            else:
                changes.append((code[0], fields[i + 1], None))
                i += 2
        yield head.split("\x1f"), changes


def parse_counts(log: str) -> dict[tuple[str, str], tuple[int | None, int | None]]:
    """Added and deleted lines by (sha, path) of a -z --numstat log; binary files have none."""
    out = {}
    for block in log.split(MARK)[1:]:
        sha, _, rest = block.partition(BODY)
        fields = rest.lstrip("\0\n").split("\0")
        i = 0
        while i < len(fields) and "\t" in fields[i]:
            added, deleted, path = fields[i].strip("\n").split("\t", 2)
            if not path:
                path, i = fields[i + 2], i + 2
            out[sha, path] = tuple(None if n == "-" else int(n) for n in (added, deleted))
            i += 1
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        since, branch, most = self.options.get("since"), self.options.get("branch", "HEAD"), int(self.options.get("commitsperpartition", 5000))
        out = []
        for repo in self.options["path"].split(","):
            commits = git(repo, "rev-list", f"{since}..{branch}" if since else branch).split()
            out += [InputPartition((repo, commits[i : i + most])) for i in range(0, len(commits), most)]
        return out or [InputPartition((None, []))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        repo, commits = partition.value
        if not commits:
            return
        asked = "\n".join(commits) + "\n"
        shown = ("log", "--no-walk=unsorted", "--stdin", "-z", "-M")
        counts = parse_counts(git(repo, *shown, "--numstat", "--format=%x1e%H%x1d", asked=asked))
        for head, changes in parse_names(git(repo, *shown, "--name-status", "--format=%x1e%H%x1f%an%x1f%ae%x1f%cI%x1f%P%x1f%s%x1d", asked=asked)):
            for code, path, old in changes or [(None, None, None)]:
                yield (*head[:6], path, code, old, *counts.get((head[0], path), (None, None)))


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def history_tables(spark: SparkSession, path: str, since: str | None = None) -> dict[str, DataFrame]:
    """commit, developer, parent, file_version and changed tables of a clone."""
    spark.dataSource.register(GitLog)
    reader = spark.read.format("gitlog")
    rows = (reader.option("since", since) if since else reader).load(path)
    commits = rows.select("sha", F.col("date").cast("timestamp").alias("date"), "message", "author_email", "author_name", "parents").dropDuplicates(["sha"])
    changed = rows.filter("file_path is not null")
    return {
        "commit": commits.select("sha", "date", "message", "author_email"),
        "developer": commits.groupBy(F.col("author_email").alias("email")).agg(F.max_by("author_name", F.struct("date", "author_name")).alias("name")),
        "parent": commits.select("sha", F.explode(F.split("parents", " ")).alias("parent")).filter("parent <> ''"),
        "file_version": changed.select("sha", F.col("file_path").alias("path")).distinct(),
        "changed": changed.select("sha", F.col("file_path").alias("path"), "change_type", "renamed_from", "additions", "deletions"),
    }
