"""Vectors as rows of bytes: what the two search operators share."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def usual_length(rows: DataFrame, vector: str) -> int:
    """The most frequent length of a vector column, the smaller one of equals; 0 for no rows."""
    top = rows.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return top["n"] if top else 0


def matrix(column, dtype) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    n = len(column)
    return np.asarray(column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten(), dtype).reshape(n, -1)


def ranked(partial: DataFrame, k: int, score: str, keep_query: bool = False) -> DataFrame:
    """The k best of each query out of partial results (q, query_id, vec_id, score), ties to the smaller vec_id.

    A query has at most k rows from each block it met, so a window's rows are bounded by
    the number of blocks.
    """
    order = W.partitionBy("q").orderBy(F.desc(score), F.col("vec_id").asc_nulls_last())
    out = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select(*(["q"] if keep_query else []), "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        over = np.flatnonzero(scores > bar)
        ties = np.flatnonzero(scores == bar)
        need = k - len(over)
        if len(ties) > need:
            ties = ties[np.argpartition(ids[ties], need - 1)[:need]] if need < len(ties) else ties
        some = np.r_[over, ties]
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))]
