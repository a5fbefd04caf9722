"""Exact top-k by integer inner product over an impact-ordered, score-at-a-time index.

Vectors are quantised to integers. An index covers a block of rows. Dense vectors have
every row in the postings of every dimension, so postings are cut by value into bit planes:
the segment (dimension, b) is the set, a bitmap, of the rows whose component above the
dimension's least has bit b, and its impact on a query's scores is 2**b times the query's
weight there. For each query the segments of all dimensions are processed by descending
impact, quantised to powers of two, into accumulators; many queries are worked on side by
side, each in its own order. A row can still gain or lose no more than the positive or
negative impacts that are left. A query stops as soon as this proves that only a small
share of the rows can reach the k-th best exact score known so far (or no segment is left);
all rows that can, and no others, are rescored exactly. So the result is exact wherever a
query stops.

Each block of rows meets all queries in one task: its index is built once, and the queries
stream through it batch by batch, so a task holds one block and one batch. A query's
partial results are k rows per block.

Vectors null, or with null or non-finite components, take no part; nor do vectors of
another length than most rows have. A query's own row is any row of its vec_id. Rows that
repeat an id and vector ask once, and are candidates each. Components of 2**28 or more in
absolute value after quantising stop the job with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.vectors import best, finite, matrix, ranked, usual_length
from riskgraph.llm.words import trimmed

#: Share of a block's rows that may be left to exact rescoring.
RESCORE = 0.05
#: Queries whose accumulators are held together.
TOGETHER = 256


class ImpactIndex:
    """Bit planes of a block of integer vectors, highest level first."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.least = rows.min(axis=0)
        above = rows - self.least
        self.levels = int(above.max()).bit_length()
        self.bits = [(above >> b & 1).astype(bool) for b in range(self.levels)]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query ids and scores of the k best rows but those with its own id."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(0, len(queries), TOGETHER):
            out += self._search(queries[i : i + TOGETHER], own[i : i + TOGETHER], k)
        return out

    def _search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        n = len(self.rows)
        # sums of products stay whole numbers that the type holds exactly
        reach = float(np.abs(queries).sum(axis=1).max()) * 2.0**self.levels
        kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else object
        base = queries @ self.least
        acc = np.zeros((len(queries), n), kind)
        #: Power of two of each weight, -1 for none; a segment's impact has that of its weight and bit together.
        power = np.where(queries != 0, np.frexp(np.abs(queries).astype(np.float64))[1] - 1, -1)
        most = 2**self.levels - 1
        up, down = queries.clip(min=0).sum(axis=1) * most, queries.clip(max=0).sum(axis=1) * most  # what is left to gain and to lose
        waiting = list(range(len(queries)))
        bar: dict[int, int] = {}
        found: list = [None] * len(queries)
        highest = int(power.max(initial=-1)) + self.levels - 1 if self.levels else -1
        for impact in range(highest, -1, -1):
            for b in range(self.levels):
                now = np.where(power[waiting] == impact - b, queries[waiting], 0)
                used = np.flatnonzero(now.any(axis=0))
                if len(used):
                    acc[waiting] += (now[:, used].astype(kind) * 2**b) @ self.bits[b][:, used].T.astype(kind)
                    up[waiting] -= now.clip(min=0).sum(axis=1) * 2**b
                    down[waiting] -= now.clip(max=0).sum(axis=1) * 2**b
            still = []
            for i in waiting:
                # unless the slack is well below the spread of the scores, no proof is in sight
                if int(up[i] - down[i]) > 4 * float(acc[i, :: max(1, n // 256)].std()) and impact:
                    still.append(i)
                    continue
                if i not in bar:
                    near = min(n, 2 * k + 1)
                    guess = np.argpartition(acc[i], n - near)[n - near :]
                    guess = guess[self.ids[guess] != own[i]]
                    exact = np.sort(self.rows[guess] @ queries[i])
                    bar[i] = int(exact[-k] - base[i]) if len(exact) >= k else int(queries[i].clip(max=0).sum()) * most
                members = np.flatnonzero(acc[i] >= bar[i] - int(up[i]))
                if len(members) <= max(8 * k, RESCORE * n) or not impact:
                    found[i] = self._rescored(members, queries[i], own[i], k)
                else:
                    still.append(i)
            waiting = still
        for i in waiting:  # rows that are all alike have no segment
            found[i] = self._rescored(np.arange(n), queries[i], own[i], k)
        return found

    def _rescored(self, members: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        members = members[self.ids[members] != own]
        scores = self.rows[members] @ query
        top = best(scores, self.ids[members], k)
        return self.ids[members[top]], scores[top]


def _quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def exact_top_k(
    rows: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64,
    block_rows: int = 16384,
) -> DataFrame:
    """The k highest scores of each row that ``queries`` (a condition on vec_id) picks.

    Rows query_id, rank (from 1), vec_id, score: the inner product of the vectors after
    floor(scale * x) of each component; ties go to the smaller vec_id.
    """
    plain = rows.select(rows[vec_id].cast("long").alias("vec_id"), rows[vector].alias("v"))
    plain = plain.filter(finite(F.col("v")))
    dims = usual_length(plain, "v")
    plain = plain.filter(F.size("v") == dims).select("vec_id", _quantised(F.col("v"), scale).alias("v"))
    far = F.exists("v", lambda x: F.abs(x) >= F.lit(1 << 28))
    plain = plain.withColumn("v", F.when(far, F.raise_error(F.lit("a component is too large for exact scores")).cast("array<bigint>")).otherwise(F.col("v")))
    asked = plain.filter(F.col("vec_id").isNotNull()).filter(queries).distinct().withColumn("q", F.xxhash64("vec_id", "v"))
    row_blocks = max(1, -(-plain.count() // block_rows))
    left = plain.select(F.pmod(F.xxhash64(F.lit(5), "vec_id", "v"), F.lit(row_blocks).cast("long")).alias("rb"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("q"), "vec_id", "v")
    right = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))).alias("rb"), F.lit(1).alias("kind"), "q", "vec_id", "v")
    # of each block first the rows and then the queries
    dealt = left.unionByName(right).repartition(row_blocks, "rb").sortWithinPartitions("rb", "kind")
    last = np.iinfo(np.int64).max

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, rows, index = None, [], [], None
        for batch in batches:
            step = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            cuts = [0, *(np.flatnonzero((step[:, 1:] != step[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if step[0, a] != block:
                    block, ids, rows, index = step[0, a], [], [], None
                if step[1, a] == 0:
                    ids.append(np.array([x if x is not None else last for x in part.column(3).to_pylist()], np.int64))
                    rows.append(matrix(part.column(4), np.int64))
                    continue
                if index is None and rows:
                    index = ImpactIndex(np.concatenate(ids), np.concatenate(rows))
                    ids, rows = [], []
                if index is None:
                    continue
                own = part.column(3).to_numpy()
                found = index.search(matrix(part.column(4), np.int64), own, k)
                size = np.array([len(f) for f, _ in found])
                near = np.concatenate([f for f, _ in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column(2).to_numpy(), size)), pa.array(np.repeat(own, size)), pa.array(near, mask=near == last), pa.array(np.concatenate([s for _, s in found]), pa.int64())],
                    ["q", "query_id", "vec_id", "score"],
                )

    partial = dealt.mapInArrow(trimmed(search), "q long, query_id long, vec_id long, score long")
    return ranked(partial, k, "score")
