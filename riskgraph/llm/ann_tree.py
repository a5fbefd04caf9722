"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, best bin first.

The tree is fitted on the driver to a sample of at most ``SAMPLE`` vectors (a hash of id
and vector picks them); every vector is then assigned to a leaf. A query walks the tree
with a priority queue: the nearest unopened node is opened next, leaves are visited in the
order they come up. How many leaves are visited is calibrated on the sample: sampled
vectors look for their true neighbours among the sample, and the number of visits widens
until the target recall is reached. The tree has at most ``MAX_LEAVES`` leaves, so it and
the visits of a query are bounded at any size of the table.

A leaf's rows are cut into cells of bounded size by hash, and so are the queries that
visit it; a cell scores its queries against its rows and returns the k best of each. Scores
are computed in double precision on the original vectors, sums in one fixed order, so
equal vectors tie exactly.

Vectors null, zero, or with null or non-finite components take no part; nor do vectors of
another length than most. A query's own row is any row of its vec_id. Rows that repeat an
id and vector ask once, and are candidates each.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.durable import Stage
from riskgraph.llm.vectors import best, finite, matrix, ranked, usual_length
from riskgraph.llm.words import trimmed

SAMPLE = 40_000
MAX_LEAVES = 4096
BRANCH = 8
#: Sampled vectors whose true neighbours calibrate the visits.
CALIBRATE = 400
#: Leaves of a query whose k best bound what the rest of its leaves return.
FIRST = 8


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _lloyd(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Centres of up to k clusters and the cluster of each row."""
    centres = np.unique(x[rng.choice(len(x), min(len(x), 4 * k), replace=False)], axis=0)
    centres = centres[rng.permutation(len(centres))[:k]]
    for _ in range(rounds):
        near = ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    near = ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)
    return centres, near


class Tree:
    """Nodes with the centres of their children; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, seed: int = 1):
        self.centres: list[np.ndarray] = []
        self.children: list[list[tuple[bool, int]]] = []
        self.leaves = 0
        if len(sample):
            self._grow(sample, max(1, leaf_rows), np.random.default_rng(seed))
        self.leaves = max(1, self.leaves)

    def _grow(self, x: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> tuple[bool, int]:
        """(is a leaf, number) of the node over the rows x."""
        if len(x) > leaf_rows:
            centres, near = _lloyd(x, BRANCH, rng)
            if len(np.unique(near)) > 1:
                at = len(self.centres)
                self.centres.append(centres), self.children.append([])
                for c in range(len(centres)):
                    self.children[at].append(self._grow(x[near == c], leaf_rows, rng))
                return False, at
        self.leaves += 1
        return True, self.leaves - 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row falls into."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.centres else []
        while todo:
            node, rows = todo.pop()
            c = self.centres[node]
            near = ((c * c).sum(axis=1) - 2 * (x[rows] @ c.T)).argmin(axis=1)
            for i, (leaf, number) in enumerate(self.children[node]):
                some = rows[near == i]
                if leaf:
                    out[some] = number
                elif len(some):
                    todo.append((number, some))
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first leaves in best-bin-first order."""
        if not self.centres:
            return [0]
        out: list[int] = []
        queue = [(0.0, False, 0)]
        while queue and len(out) < most:
            _, leaf, number = heapq.heappop(queue)
            if leaf:
                out.append(number)
                continue
            gap = self.centres[number] - query
            for d, (is_leaf, child) in zip((gap * gap).sum(axis=1).tolist(), self.children[number]):
                heapq.heappush(queue, (d, is_leaf, child))
        return out

    def calibrated(self, sample: np.ndarray, k: int, recall: float) -> int:
        """Leaves to visit for the recall, measured for some rows of the sample among all of it."""
        ask = np.linspace(0, len(sample) - 1, min(CALIBRATE, len(sample))).astype(int)
        if not self.centres or len(sample) <= k:
            return self.leaves
        scores = sample[ask] @ sample.T
        scores[np.arange(len(ask)), ask] = -2
        true = np.argpartition(-scores, k, axis=1)[:, :k]
        leaf = self.leaf_of(sample)
        order = [np.argsort(np.array(self.visits(sample[i], self.leaves))) for i in ask]
        at = np.array([o[leaf[t]] for o, t in zip(order, true)])
        most = 1
        while most < self.leaves and (at < most).mean() < recall:
            most = min(self.leaves, most + max(1, most // 8))
        return most


def nearest(
    rows: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
    recall: float = 0.97, leaf_rows: int = 512, cell_rows: int = 16384, cell_queries: int = 2048,
) -> DataFrame:
    """The k nearest found of each row that ``queries`` (a condition on vec_id) picks.

    Rows query_id, rank (from 1), vec_id, score (cosine); ties go to the smaller vec_id.
    """
    spark = rows.sparkSession
    plain = rows.select(rows[vec_id].cast("long").alias("vec_id"), rows[vector].cast("array<double>").alias("v"))
    plain = plain.filter(finite(F.col("v")) & F.exists("v", lambda x: x != 0))
    dims = usual_length(plain, "v")
    plain = plain.filter(F.size("v") == dims)
    n = plain.count()
    lot = F.pmod(F.xxhash64(F.lit(9), "vec_id", "v"), F.lit(1 << 30))
    drawn = plain.filter(lot < int((1 << 30) * min(1.0, 0.95 * SAMPLE / max(n, 1)))).limit(SAMPLE).select("v").toArrow()
    sample = _unit(matrix(drawn["v"], np.float64)) if drawn.num_rows else np.zeros((0, max(dims, 1)))
    size = max(leaf_rows, n // MAX_LEAVES) * len(sample) / max(n, 1)
    tree = Tree(sample, int(size))
    most = tree.calibrated(sample, k, recall)
    shared = spark.sparkContext.broadcast(tree)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                x = _unit(matrix(b.column(1), np.float64))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.leaf_of(x))], ["vec_id", "v", "leaf"])

    def walk(batches):
        for b in batches:
            if b.num_rows:
                leaves = [shared.value.visits(x, most) for x in _unit(matrix(b.column(1), np.float64))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaves, pa.list_(pa.int64()))], ["vec_id", "v", "q", "leaves"])

    schema = T.StructType(plain.schema.fields + [T.StructField("leaf", T.LongType())])
    stage = Stage(spark, "ann")
    members = stage.keep(plain.mapInArrow(trimmed(assign), schema))
    asked = plain.filter(F.col("vec_id").isNotNull()).filter(queries).distinct().withColumn("q", F.xxhash64("vec_id", "v"))
    visits = stage.keep(asked.mapInArrow(trimmed(walk), T.StructType(asked.schema.fields + [T.StructField("leaves", T.ArrayType(T.LongType()))])))
    # the first leaves give each query a score to beat; the others return only what reaches it
    early = visits.withColumn("leaf", F.explode(F.slice("leaves", 1, FIRST))).withColumn("bar", F.lit(-2.0)).drop("leaves")
    begun = stage.keep(_scored(members, early, k, cell_rows, cell_queries))
    bars = ranked(begun, k, "score", keep_query=True).filter(F.col("rank") == k).select("q", F.col("score").alias("bar"))
    late = visits.withColumn("leaf", F.explode(F.expr(f"slice(leaves, {FIRST + 1}, greatest(size(leaves) - {FIRST}, 0))"))).drop("leaves")
    late = late.join(bars, "q", "left").fillna(-2.0, ["bar"]).select(*early.columns)
    return ranked(begun.unionByName(_scored(members, late, k, cell_rows, cell_queries)), k, "score")


def _scored(members: DataFrame, visits: DataFrame, k: int, cell_rows: int, cell_queries: int) -> DataFrame:
    """The k best of each leaf for the queries that visit it, if they reach the query's bar."""
    # cells: neither a leaf of very many rows nor one of very many queries meets in one task
    per_leaf = members.groupBy("leaf").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("rbs"))
    per_ask = visits.groupBy("leaf").agg(F.ceil(F.count("*") / cell_queries).cast("int").alias("qbs"))
    cells = F.broadcast(per_leaf.join(per_ask, "leaf"))  # at most a row for each leaf
    left = members.join(cells, "leaf").withColumn("rb", F.pmod(F.xxhash64("vec_id", "v", F.lit(6)), F.col("rbs")).cast("int"))
    left = left.withColumn("qb", F.explode(F.expr("sequence(0, qbs - 1)"))).select("leaf", "rb", "qb", "vec_id", "v")
    right = visits.join(cells, "leaf").withColumn("qb", F.pmod(F.xxhash64("q", F.lit(6)), F.col("qbs")).cast("int"))
    right = right.withColumn("rb", F.explode(F.expr("sequence(0, rbs - 1)"))).select("leaf", "rb", "qb", "q", "vec_id", "v", "bar")
    last = np.iinfo(np.int64).max

    def cell(block: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if block.num_rows and ask.num_rows:
            ids = np.array([last if i is None else i for i in block["vec_id"].to_pylist()], np.int64)
            x = matrix(block["v"], np.float64)
            length = np.sqrt((x * x).sum(axis=1))
            for q, own, bar, y in zip(ask["q"].to_pylist(), ask["vec_id"].to_pylist(), ask["bar"].to_pylist(), matrix(ask["v"], np.float64)):
                score = (x * y).sum(axis=1) / (length * np.sqrt((y * y).sum()))
                some = np.flatnonzero((ids != own) & (score >= bar))
                if len(some):
                    top = some[best(score[some], ids[some], k)]
                    for column, values in zip(out, ([q] * len(top), [own] * len(top), ids[top].tolist(), score[top].tolist())):
                        column += values
        out[2] = [None if i == last else i for i in out[2]]
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["q", "query_id", "vec_id", "score"])

    return left.groupBy("leaf", "rb", "qb").cogroup(right.groupBy("leaf", "rb", "qb")).applyInArrow(cell, "q long, query_id long, vec_id long, score double")
