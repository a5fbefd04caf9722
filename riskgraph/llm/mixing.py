"""Mixes sources to target weights: fixed-length blocks, multinomial counts, index permutations.

The words of each source lie on one line, document after document, cut into blocks of
``block_words``. Every output shard holds the same number of slots in expectation: of each
source the whole part of its share, and the rest drawn from a multinomial over the
fractions. The k-th slot of a source takes, in pass k div n over its n blocks, the block
that a pseudorandom permutation of 0..n-1 (one per source and pass) gives for k mod n, so
no block is taken more than one time above another. Blocks meet their words by index.
Slots beyond ``most`` passes over a source, which chance may draw, stay empty.

The multinomial is stratified: only the fractions of the shares are left to chance, so the
variance of a source's count in a shard is that of less than one slot for each source, and
never that of all slots.

Only DataFrame functions run here. No window spans a source's documents or all shards:
places on the line come from sums over hashed chunks of a source and sums within a chunk,
and the slots before a shard from sums over runs of ``run`` shards and sums within a run.
Only one row per source, or per source and chunk or run, is ever ordered in a single task.
The order on the line depends on ids, sources and texts alone, so reruns agree. Nulls: a
null text has no words, a null source is a source, the last one; a null id is an id like
others. Documents without words take nothing. Repeated rows each have their own place; rows
alike in id, source and text are told apart by their other columns where these differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.durable import Stage
from riskgraph.llm.words import free_name

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 10


def targets(sizes: DataFrame, most: int = 3, period: int = 3) -> DataFrame:
    """Adds ``sid`` (from 0, by code point, null last) and ``target`` to rows (source, source_size).

    Weights are 1 to ``period``, repeating. Filling up to ``most`` times the size goes in
    the order of that bound over the weight: a source is full if its share of what the
    fuller ones leave reaches its bound.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("sid", F.row_number().over(order) - 1)
    s = s.withColumn("__w", (F.col("sid") % period + 1).cast("long")).withColumn("__cap", F.col("source_size") * most)
    fill = W.orderBy((F.col("__cap") / F.col("__w")).asc(), "sid")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("__cap").over(before), F.lit(0))
    weight = F.sum("__w").over(all_rows) - F.coalesce(F.sum("__w").over(before), F.lit(0))
    s = s.withColumn("__left", left).withColumn("__weight", weight)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    s = s.withColumn("__full", big("__cap") * big("__weight") <= big("__w") * big("__left"))
    level = F.min(F.when(~F.col("__full"), F.struct(F.col("__cap") / F.col("__w"), "sid", F.col("__left") / F.col("__weight").cast("double")))).over(all_rows)
    s = s.withColumn("__level", level.getField("col3"))
    target = F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(F.col("__w") * F.col("__level"))
    return s.select("source", "sid", "source_size", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) fixed by its arguments."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def permuted(x: Column, n: Column, *seed: Column) -> Column:
    """Place of x in a pseudorandom permutation of 0..n-1: swap-or-not rounds keyed by the seed."""

    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(1), r, *seed), n) - x, n)
        swap = F.xxhash64(F.lit(2), r, F.greatest(x, other), *seed) < 0
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), turn)


class Mix:
    """A mix of one table; see ``documents()``, ``slots()`` and ``texts()``."""

    def __init__(
        self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", most: int = 3,
        block_words: int = 128, shard_slots: int = 4096, chunks: int = 4096, cells: int = 4096, run: int = 4096, task_slots: int = 200_000,
        seed: int = 7,
    ):
        self.docs, self.text, self.name = docs, docs[text], text
        self.block, self.most, self.seed = block_words, most, F.lit(seed)
        spark = docs.sparkSession
        self.stage = Stage(spark, "mix")
        body = F.coalesce(self.text.cast("string"), F.lit(""))
        #: Fixes a row's place; rows alike in id, source and text are interchangeable.
        key, of = docs[doc_id].cast("string"), docs[source].cast("string")
        self.mark = F.xxhash64(key.isNull(), key, of.isNull(), of, body)
        rows = docs.select(
            docs[doc_id].alias("doc_id"), of.alias("source"),
            F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), self.mark.alias("mark"),
        )
        rows = self.stage.keep(rows)
        sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        self.sources = self.stage.keep(targets(sizes, most))
        named = self.sources.withColumnRenamed("source", "__source")
        rows = rows.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("mark", F.lit(3)), chunks))
        sums = rows.groupBy("sid", "chunk").agg(F.sum("size").alias("chunk_size"))
        through = W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.select("sid", "chunk", F.coalesce(F.sum("chunk_size").over(through), F.lit(0)).alias("chunk_at"))
        within = W.partitionBy("sid", "chunk").orderBy("mark", F.col("doc_id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumn("place", F.coalesce(F.sum("size").over(within), F.lit(0)))
        rows = rows.join(sums, ["sid", "chunk"]).withColumn("at", F.col("chunk_at") + F.col("place"))
        self.rows = self.stage.keep(rows.select("doc_id", "mark", "sid", "size", "source_size", "target", "at"))
        self._draw(shard_slots, cells, run, task_slots)

    def _draw(self, shard_slots: int, cells: int, run: int, task_slots: int) -> None:
        """Multinomial counts per shard and source, and from them the passes over each block."""
        spark, seed = self.docs.sparkSession, self.seed
        src = self.sources.filter("source_size > 0").select("sid", F.ceil(F.col("source_size") / self.block).alias("n"), "source_size", "target")
        src = src.withColumn("want", F.col("target") * F.col("n") / F.col("source_size"))
        total = src.agg(F.sum("want")).first()[0] or 0.0
        shards = max(1, round(total / shard_slots))
        src = src.withColumn("each", F.col("want") / shards).withColumn("whole", F.floor("each"))
        src = src.withColumn("part", F.col("each") - F.col("whole"))
        order = W.orderBy("sid")
        src = src.withColumn("hi", F.sum("part").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col("part"))
        loose = src.agg(F.sum("part")).first()[0] or 0.0
        shard = spark.range(shards).withColumnRenamed("id", "shard")
        # the drawn part: a number falls into a cell of equal width, and into one source's stretch there
        width = max(loose, 1e-12) / cells
        grid = src.filter("part > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.least(F.floor(F.col("hi") / width), F.lit(cells - 1)))))
        draws = shard.withColumn("r", F.explode(F.expr(f"sequence(0, {int(loose) + 1})")))
        draws = draws.filter(F.col("r") < F.floor(F.lit(loose) + _uniform(F.lit(4), "shard", seed)))
        draws = draws.withColumn("u", _uniform(F.lit(5), F.col("shard"), F.col("r"), seed) * loose).withColumn("cell", F.least(F.floor(F.col("u") / width), F.lit(cells - 1)))
        drawn = draws.join(grid.select("cell", "sid", "lo", "hi"), "cell").filter("u >= lo and u < hi").groupBy("sid", "shard").agg(F.count("*").alias("extra"))
        known = src.select("sid", "n", "whole")
        counts = known.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        counts = counts.join(drawn, ["sid", "shard"], "left").withColumn("count", F.col("whole") + F.coalesce("extra", F.lit(0)))
        # slots of the source before each shard: those before its run of shards, and within the run
        counts = counts.withColumn("run", F.col("shard").cast("long") - F.col("shard").cast("long") % run)
        runs = counts.groupBy("sid", "run").agg(F.sum("count").alias("in_run"))
        runs = runs.withColumn("run_first", F.coalesce(F.sum("in_run").over(W.partitionBy("sid").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        within = W.partitionBy("sid", "run").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
        counts = counts.withColumn("first", F.coalesce(F.sum("count").over(within), F.lit(0))).join(runs.drop("in_run"), ["sid", "run"])
        counts = counts.withColumn("first", F.col("first") + F.col("run_first"))
        counts = counts.withColumn("count", F.least("count", F.greatest(F.lit(0), F.col("n") * self.most - F.col("first"))))
        self.counts = self.stage.keep(counts.filter("count > 0").select("sid", "n", "shard", "count", "first"))
        # a shard's slots come out of one row, so the number of tasks follows the slots and not the rows' bytes
        tasks = int(total // task_slots) + 1
        slots = self.counts.repartition(tasks, "sid", "shard").withColumn("k", F.explode(F.expr("sequence(first, first + count - 1)")))
        slots = slots.withColumn("turn", F.floor(F.col("k") / F.col("n")))
        slots = slots.withColumn("block", permuted(F.col("k") % F.col("n"), F.col("n"), F.col("sid"), F.col("turn"), seed))
        self._slots = slots.select("shard", "sid", "k", "turn", "block")
        self.times = self.stage.keep(self._slots.groupBy("sid", "block").agg(F.count("*").alias("times")))

    def slots(self) -> DataFrame:
        """The mix itself: each slot of each shard with its source's number, pass and block."""
        return self._slots

    def _pieces(self) -> DataFrame:
        """Stretches of documents in blocks, with the times the block is taken."""
        b = self.block
        some = self.rows.filter("size > 0")
        p = some.withColumn("block", F.explode(F.expr(f"sequence(at div {b}, (at + size - 1) div {b})")))
        p = p.withColumn("begin", F.greatest(F.col("block") * b - F.col("at"), F.lit(0)))
        p = p.withColumn("words", F.least((F.col("block") + 1) * b - F.col("at"), F.col("size")) - F.col("begin"))
        return p.join(self.times, ["sid", "block"])

    def documents(self) -> DataFrame:
        """Per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
        taken = self._pieces().groupBy("sid", "at").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        key = F.when(F.col("size") > 0, F.col("at"))
        out = self.rows.withColumn("__at", key).join(taken.withColumnRenamed("at", "__at"), ["sid", "__at"], "left")
        return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def texts(self) -> DataFrame:
        """The documents' rows with the words taken, one row for each pass that takes any.

        All columns stay; text becomes the words taken in that pass, joined by one space,
        or, where the pass takes the whole document, the text as it was.
        """
        runs = self._pieces().withColumn("turn", F.explode(F.expr("sequence(1, times)")))
        runs = runs.groupBy("sid", "at", "mark", "size", "turn").agg(F.sort_array(F.collect_list(F.struct("begin", "words"))).alias("runs"), F.sum("words").alias("got"))
        # rows alike in id, source and text lie side by side on the line, which numbers them
        # (written, so that its size is known: texts are not shuffled to tell a few such rows from the rest)
        twins = self.rows.groupBy("mark").agg(F.count("*").alias("alike"), F.min("at").alias("begin_at")).filter("alike > 1").select("mark", "begin_at")
        twins = self.stage.keep(twins)
        runs = runs.join(twins, "mark", "left")
        runs = runs.withColumn("nth", F.when(F.col("begin_at").isNotNull(), ((F.col("at") - F.col("begin_at")) / F.col("size") + 1).cast("int")).otherwise(1))
        names = {n: free_name(self.docs.columns, f"__{n}") for n in ("mark", "nth", "runs", "got", "size")}
        mark, number = names["mark"], names["nth"]
        marked, twins = self.docs.withColumn(mark, self.mark), twins.withColumnRenamed("mark", mark)
        others = [F.col(f.name) for f in self.docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        again = marked.join(twins, mark, "left_semi").withColumn(number, F.row_number().over(W.partitionBy(mark).orderBy(F.xxhash64(*others))))
        once = marked.join(twins, mark, "left_anti").withColumn(number, F.lit(1))
        taken = runs.select(*(F.col(n).alias(names[n]) for n in names))
        out = once.unionByName(again).join(taken, [mark, number])
        name = self.name
        words = F.filter(F.split(F.col(name), r"[\x20\x09-\x0D]+"), lambda w: w != "")
        cut = F.array_join(F.flatten(F.transform(names["runs"], lambda r: F.slice(words, r["begin"].cast("int") + 1, r["words"].cast("int")))), " ")
        text = F.when(F.col(names["got"]) == F.col(names["size"]), F.col(name)).otherwise(cut)
        return out.withColumn(name, text).select(*self.docs.columns)
