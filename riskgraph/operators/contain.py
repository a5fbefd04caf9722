"""Which texts contain which strings, without comparing every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 5


def _grams(text: Column, size: Column) -> Column:
    """Distinct runs of ``size`` signs."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def containing(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """Rows (needle, text): the distinct texts that contain each distinct needle, sign by sign.

    Candidates meet on runs of ``GRAM`` signs, or all of a shorter needle: of a needle's runs
    the one that the fewest texts have, since what contains the needle has it too. Empty
    needles and nulls are in no text.
    """
    needles = needles.select("needle").filter(F.length("needle") > 0).distinct().withColumn("size", F.least(F.length("needle"), F.lit(GRAM)))
    sizes = [r["size"] for r in needles.select("size").distinct().collect()]  # five at most
    if not sizes:
        return texts.select(F.lit("").alias("needle"), "text").limit(0)
    distinct = texts.select("text").filter("text is not null").distinct()
    runs = distinct.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).withColumn("gram", F.explode(_grams(F.col("text"), F.col("size"))))
    wanted = needles.withColumn("gram", F.explode(_grams(F.col("needle"), F.col("size"))))
    frequent = runs.groupBy("gram").count()
    rarest = wanted.join(frequent, "gram").groupBy("needle").agg(F.count("*").alias("met"), F.min_by("gram", F.struct("count", "gram")).alias("gram"))
    # a run that no text has rules the needle out
    possible = wanted.groupBy("needle").agg(F.count("*").alias("runs")).join(rarest, "needle").filter("met = runs").select("needle", "gram")
    return possible.join(runs.select("text", "gram"), "gram").filter(F.contains("text", "needle")).select("needle", "text")
