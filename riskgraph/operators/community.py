"""Communities (Louvain) and betweenness of call graphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.durable import Stage
from riskgraph.operators.components import components


def class_edges(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Calls lifted to the classes of caller and callee; their number is the weight."""
    owner = methods.select("method_signature", F.concat_ws("@", "class_name", "file").alias("owner"))
    rows = calls.join(owner.select(F.col("method_signature").alias("src"), F.col("owner").alias("a")), "src")
    rows = rows.join(owner.select(F.col("method_signature").alias("dst"), F.col("owner").alias("b")), "dst")
    return rows.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("weight"))


def louvain(edges: DataFrame, levels: int = 5, rounds: int = 8) -> DataFrame:
    """Rows (node, community): modularity communities of undirected edges (src, dst, optional weight).

    Each round every node weighs the gain of moving to a neighbour's community; of the nodes
    only a hashed half moves, so that two neighbours seldom swap. When a level gains no more,
    communities become nodes of the next. A community is named by its least member. All of it
    is joins and sums over edges; only the modularity comes back to the driver.
    """
    stage = Stage(edges.sparkSession, "louvain")
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    plain = edges.filter("src is not null and dst is not null").select("src", "dst", w.alias("w"))
    both = plain.unionByName(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    graph = stage.keep(both.groupBy("src", "dst").agg(F.sum("w").alias("w")))
    total = graph.agg(F.sum("w")).first()[0] or 0.0
    names = stage.keep(graph.select(F.col("src").alias("node"), F.col("src").alias("community")).distinct())
    if not total:
        return names
    for _ in range(levels):
        degree = stage.keep(graph.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")))
        place = stage.keep(degree.select("node", F.col("node").alias("c"), "k"))
        before = _modularity(graph, place, total)
        best, kept = before, place
        for r in range(rounds):
            sums = place.groupBy("c").agg(F.sum("k").alias("kc"))
            to = graph.filter("src <> dst").join(place.select(F.col("node").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("node"), "c").agg(F.sum("w").alias("kin"))
            options = to.unionByName(place.select("node", "c").withColumn("kin", F.lit(0.0))).groupBy("node", "c").agg(F.sum("kin").alias("kin"))
            options = options.join(sums, "c").join(place.select("node", F.col("c").alias("own"), "k"), "node")
            rest = F.col("kc") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
            gain = F.col("kin") - rest * F.col("k") / total
            choice = options.groupBy("node").agg(F.max_by("c", F.struct(gain, F.col("c") == F.col("own"), F.xxhash64("c"))).alias("new"))
            may = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0
            place = stage.keep(place.join(choice, "node").select("node", F.when(may, F.col("new")).otherwise(F.col("c")).alias("c"), "k"))
            now = _modularity(graph, place, total)
            if now > best + 1e-9:
                best, kept = now, place
            elif r % 2:
                break
        if best <= before + 1e-9:
            break
        names = stage.keep(names.join(kept.select(F.col("node").alias("community"), "c"), "community").select("node", F.col("c").alias("community")))
        a, b = kept.select(F.col("node").alias("src"), F.col("c").alias("a")), kept.select(F.col("node").alias("dst"), F.col("c").alias("b"))
        graph = stage.keep(graph.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
        stage.free()
    least = names.groupBy("community").agg(F.min("node").alias("least"))
    return names.join(least, "community").select("node", F.col("least").alias("community"))


def _modularity(graph: DataFrame, place: DataFrame, total: float) -> float:
    a, b = place.select(F.col("node").alias("src"), F.col("c").alias("a")), place.select(F.col("node").alias("dst"), F.col("c").alias("b"))
    inside = graph.join(a, "src").join(b, "dst").filter("a = b").agg(F.sum("w")).first()[0] or 0.0
    squares = place.groupBy("c").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0
    return inside / total - squares / total**2


def modularity(edges: DataFrame, communities: DataFrame) -> float:
    """Of undirected edges under rows (node, community)."""
    plain = edges.select("src", "dst", F.lit(1.0).alias("w"))
    graph = plain.unionByName(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    place = graph.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).join(communities, "node").withColumnRenamed("community", "c")
    return _modularity(graph, place, graph.count())


#: Edges of small components that one group takes; nodes times edges of a component for which a group of sources is made; most groups of one.
PACK_EDGES, PART_WORK, MOST_PARTS = 20_000, 10**8, 256
#: Pairs of a source and a node or edge that are held at once.
PAIRS_HELD = 2_000_000


def betweenness(edges: DataFrame, most_edges: int | None = None, parts: int = 64) -> DataFrame:
    """Rows (node, betweenness) of directed unweighted edges, exact (Brandes).

    No path leaves its connected component, so a task holds the edges of components only: of
    many small ones, or of one large one with a share of its sources. Nodes are numbers
    meanwhile. Nothing is gathered on the driver, and nothing is sampled; a graph of more than
    ``most_edges`` edges is refused if the caller says so.
    """
    stage = Stage(edges.sparkSession, "between")
    plain = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    nodes = stage.keep(plain.select(F.col("src").alias("node")).unionByName(plain.select(F.col("dst").alias("node"))).distinct())
    nodes = stage.keep(nodes.withColumn("id", F.monotonically_increasing_id()))
    number = lambda end, name: nodes.select(F.col("node").alias(end), F.col("id").alias(name)).hint("merge")
    pairs = stage.keep(plain.join(number("src", "u"), "src").join(number("dst", "v"), "dst").select("u", "v"))
    n = pairs.count()
    if most_edges is not None and n > most_edges:
        raise ValueError(f"{n} edges are more than the {most_edges} that are allowed")
    roots = stage.keep(components(pairs, stage))
    rows = pairs.hint("merge").join(roots.withColumnRenamed("node", "u"), "u", "left").select("u", "v", F.coalesce("root", "u").alias("root"))
    # a component is at most a node larger than its edges
    size = rows.groupBy("root").agg(F.count("*").alias("m"))
    m = F.col("m").cast("double")
    size = size.withColumn("shares", F.least(F.ceil(m * (m + 1) / PART_WORK), F.lit(MOST_PARTS)).cast("int"))
    size = size.withColumn("pack", F.when(F.col("shares") == 1, -1 - F.pmod(F.xxhash64("root"), F.lit(-(-n // PACK_EDGES) or 1))).otherwise(F.col("root")))
    share = lambda end: F.pmod(F.xxhash64(end), F.col("shares")).cast("int")
    rows = rows.hint("merge").join(size, "root").select("pack", "u", "v", share("u").alias("of_u"), share("v").alias("of_v"), F.explode(F.expr("sequence(0, shares - 1)")).alias("share"))
    sums = rows.repartition(parts, "pack", "share").groupBy("pack", "share").applyInArrow(_dependencies, "id long, betweenness double")
    sums = sums.groupBy("id").agg(F.sum("betweenness").alias("betweenness"))
    return nodes.hint("merge").join(sums, "id", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _dependencies(rows: pa.Table) -> pa.Table:
    """Sums of dependencies over the sources of a share, by Brandes' two passes over many sources side by side."""
    u, v, of_u, of_v, share = (rows[c].to_numpy() for c in ("u", "v", "of_u", "of_v", "share"))
    names, at = np.unique(np.r_[u, v], return_inverse=True)
    n, a, b = len(names), at[: len(u)], at[len(u) :]
    sources = np.unique(np.r_[a[of_u == share], b[of_v == share]])
    after, degree = b[np.argsort(a, kind="stable")], np.bincount(a, minlength=n)
    begin = np.cumsum(degree) - degree
    total = np.zeros(n)
    side = max(1, PAIRS_HELD // (n + len(a)))
    # a cell is a source of the turn and a node
    dist, paths, sums = np.full(side * n, -1, np.int32), np.zeros(side * n), np.zeros(side * n)
    for some in (sources[i : i + side] for i in range(0, len(sources), side)):
        first = front = np.arange(len(some)) * n + some
        dist[first], paths[first] = 0, 1
        steps, seen = [], [first]
        while len(front):
            node = front % n
            count = degree[node]
            to = np.repeat(front - node, count) + after[np.arange(count.sum()) + np.repeat(begin[node] - np.cumsum(count) + count, count)]
            by = np.repeat(front, count)
            front = np.unique(to[dist[to] < 0])
            dist[front] = len(seen)
            on = dist[to] == len(seen)
            by, to = by[on], to[on]
            np.add.at(paths, to, paths[by])
            steps.append((by, to))
            seen.append(front)
        for by, to in reversed(steps):
            np.add.at(sums, by, paths[by] / paths[to] * (1 + sums[to]))
        sums[first] = 0
        cells = np.concatenate(seen)
        np.add.at(total, cells % n, sums[cells])
        dist[cells], paths[cells], sums[cells] = -1, 0, 0
    some = np.flatnonzero(total)
    return pa.table({"id": pa.array(names[some], pa.int64()), "betweenness": pa.array(total[some], pa.float64())})
