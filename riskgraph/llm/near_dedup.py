"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures.

A document's set is its distinct word shingles (A-Z lower-cased); with fewer words than a
shingle, its whole word sequence. Documents of equal sets are one node. A node's signature
has ``chunks`` times ``SYMBOLS`` minima of 16 bits. Two signatures that differ in at most
``2 * chunks - 1`` symbols have, by the pigeonhole principle, a chunk with at most one
error; so each chunk is indexed under every choice of three of its four symbols, and all
pairs within that distance meet under some key. Candidates are confirmed on the full sets.

Links are found without emitting all pairs of a key. A few rounds test one pivot of each
key, the same ones in all keys where they can be, against the members in other components,
and components grow by the confirmed links; a group of copies mostly needs no more. What
is then still mixed in a key are texts alike but not linked. Those outside their key's
largest component are settled against all they are connected with by such keys, in cells
of bounded size that count common shingles exactly and emit links only. So every pair that
meets under a key and is not in one component in the end has been tested on its sets, or,
in the rounds with pivots, is known to differ in more symbols than the index guarantees to
find: of pairs at a similarity of 0.85 about two in ten million do, at 0.80 two in 100,000.

Ids are whole numbers; others stop the job. Nulls, and texts without words, have an empty
set and are linked with nothing. Rows that repeat an id share its component if their texts
do; a null id never names a component unless all its ids are null. Sets are told apart by
64-bit hashes of their shingles and nodes by 64 bits of two sums over these; a false meeting
has odds of about n**2 / 2**65.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.durable import Stage
from riskgraph.llm.words import WordHashes, blocks, free_name, mix, release, text_bytes, trimmed, windows
from riskgraph.operators.components import components

SYMBOLS = 4
SYMBOL_BYTES = 2
#: Rounds with one pivot for each key, before what is left is settled in cells.
STARS = 2
#: Characters of text, and texts, in a block of a cell.
CELL_BYTES = 4 << 20
CELL_ROWS = 2048
#: Rows of a key that are compared with as many others at a time.
KEY_ROWS = 1024
#: Symbols in which signatures may differ beyond what the index guarantees, for nodes that meet to be tested in cells.
SLACK = 4


def shingle_sets(texts: list[bytes], hashes: WordHashes, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (already lower-cased bytes)."""
    h, counts = hashes.flat(texts)
    win, fits = windows(h, counts, width)
    ends = np.cumsum(counts)
    out = []
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        if b - a >= width:
            out.append(np.unique(win[a : b - width + 1]))
        elif b > a:
            one = np.uint64(b - a)
            for x in h[a:b]:
                one = mix(np.array([one ^ x]), 17)[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name of each set; 0 for an empty one."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.zeros(len(sets), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        flat = np.concatenate([sets[i] for i in some])
        first = np.r_[0, np.cumsum(size[some])[:-1]]
        a, b = np.add.reduceat(mix(flat, 101), first), np.add.reduceat(mix(flat, 102), first)
        out[some] = mix(mix(a, 103) + b * np.uint64(3) + size[some].astype(np.uint64), 104)
    return out


def signatures(sets: list[np.ndarray], count: int) -> list[bytes | None]:
    """``count`` minima of 16 bits for each set that isn't empty."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    some = np.flatnonzero(size)
    out: list[bytes | None] = [None] * len(sets)
    if not len(some):
        return out
    flat = np.concatenate([sets[i] for i in some])
    first = np.r_[0, np.cumsum(size[some])[:-1]]
    seeds = mix(np.arange(2 * count, dtype=np.uint64), 7)
    sig = np.empty((len(some), count), "<u2")
    for k in range(count):
        low = np.minimum.reduceat((flat ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1)), first)
        sig[:, k] = (mix(low, 11) & np.uint64(0xFFFF)).astype(np.uint16)
    for row, i in enumerate(some.tolist()):
        out[i] = sig[row].tobytes()
    return out


def _sign(docs: DataFrame, width: int, count: int) -> DataFrame:
    """Rows (doc_id, mark, n_shingles, node, sig) of rows (doc_id, text, mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = [text_bytes(t, lower=True) for t in batch.column(1).to_pylist()]
            for s in blocks(texts):
                sets = shingle_sets(texts[s], hashes, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(s.start, s.stop - s.start), batch.column(2).slice(s.start, s.stop - s.start),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array(set_ids(sets).view(np.int64)), pa.array(signatures(sets, count), pa.binary()),
                    ],
                    ["doc_id", "mark", "n_shingles", "node", "sig"],
                )

    return docs.mapInArrow(trimmed(run), "doc_id long, mark long, n_shingles long, node long, sig binary")


def _index(nodes: DataFrame, chunks: int) -> DataFrame:
    """Rows (key, node): a key for each chunk and each symbol of it that may be wrong."""
    keys = []
    for c in range(chunks):
        part = [F.substring("sig", (c * SYMBOLS + k) * SYMBOL_BYTES + 1, SYMBOL_BYTES) for k in range(SYMBOLS)]
        keys += [F.xxhash64(F.lit(c * SYMBOLS + w), *(p for k, p in enumerate(part) if k != w)) for w in range(SYMBOLS)]
    return nodes.select("node", "n", F.explode(F.array(*keys)).alias("key"))


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets reach the similarity; rows (u, v)."""
    # the same plan at every size: a small side would be broadcast and a larger one not
    both = pairs.hint("merge").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = both.hint("merge").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "ta", "b", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def made(node: int, text: str) -> np.ndarray:
            if node not in known:
                known[node] = shingle_sets([text_bytes(text, lower=True)], hashes, width)[0]
                if len(known) > 64:
                    known.popitem(last=False)
            known.move_to_end(node)
            return known[node]

        for batch in batches:
            u, v = [], []
            for a, ta, b, tb in zip(*(batch.column(i) for i in range(4))):
                x, y = made(a.as_py(), ta.as_py()), made(b.as_py(), tb.as_py())
                same = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * same >= percent * (len(x) + len(y) - same):
                    u.append(a.as_py()), v.append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return both.mapInArrow(trimmed(run), "u long, v long")


def _may_reach(n: str, m: str, percent: int):
    """Whether sets of these sizes can have the similarity."""
    return F.least(F.col(n), F.col(m)) * 100 >= F.greatest(F.col(n), F.col(m)) * percent


def _alike(mixed: DataFrame, nodes: DataFrame, percent: int, limit: int) -> DataFrame:
    """Rows (u, v, open): u and v are near, or connected by near ones, or the same, and ``open`` says whether u is to be tested.

    Near are two nodes of a key in different components whose sizes allow the similarity and
    whose signatures differ in at most ``limit + SLACK`` symbols, in more than ``limit`` if
    one was a pivot of the key. A key's rows are compared in blocks of ``KEY_ROWS`` by their
    signatures alone; of the near pairs of all a task's blocks a tree for each connected set is
    emitted, so that a node has one row for a task, however many keys and blocks it is in there.
    """
    blocks_of = mixed.groupBy("key").agg(F.ceil(F.count("*") / KEY_ROWS).cast("int").alias("nb"))
    rows = mixed.hint("merge").join(blocks_of, "key").hint("merge").join(nodes.select("node", "sig"), "node")
    b = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    rows = rows.withColumn("b", b).withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
    rows = rows.withColumn("lb", F.least("b", "other")).withColumn("rb", F.greatest("b", "other"))
    rows = rows.select("key", "lb", "rb", "b", "node", "comp", (F.col("comp") != F.col("main")).alias("off"), "done", "n", "sig")
    rows = rows.repartition("key", "lb", "rb").sortWithinPartitions("key", "lb", "rb", "b", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []
        held = 0
        # what was found, first the trees of all before, each node once with its root
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
        for batch in batches:
            left.append(batch)
            held += batch.num_rows
            if held < 4 * KEY_ROWS:
                continue
            table = pa.Table.from_batches(left).combine_chunks()
            cut = _cells(table)[-2]  # the last cell may go on in the next batch
            found += near(table.slice(0, cut))
            left, held = table.slice(cut).to_batches(), table.num_rows - cut
            if sum(len(x[0]) for x in found[1:]) > max(16 * KEY_ROWS, len(found[0][0])):
                found = [grown(found)]
        if held:
            found += near(pa.Table.from_batches(left).combine_chunks())
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in grown(found)], ["u", "v", "open"])

    def near(table: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
        if table.num_rows:
            node, comp, n, rb, block = (table[c].to_numpy() for c in ("node", "comp", "n", "rb", "b"))
            off, done = (table[c].to_numpy(zero_copy_only=False) for c in ("off", "done"))
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u2").reshape(table.num_rows, -1)
            ends = _cells(table)
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
                mid = lo + int(np.searchsorted(block[lo:hi], rb[lo]))
                i, j = _near_rows(sig, n, comp, done, (lo, mid if mid > lo else hi), (mid, hi), percent, limit)
                if len(i):
                    root = _trees(i - lo, j - lo, hi - lo)
                    hit = np.unique(np.r_[i, j])
                    yield node[hit], node[root[hit - lo] + lo], off[hit]

    def grown(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        u, v, open_ = (np.concatenate(x) for x in zip(*found))
        names, at = np.unique(np.r_[u, v], return_inverse=True)
        root = _trees(at[: len(u)], at[len(u) :], len(names))
        tested = np.zeros(len(names), bool)
        np.logical_or.at(tested, at[: len(u)], open_)
        return names, names[root], tested

    return rows.mapInArrow(trimmed(run), "u long, v long, open boolean")


def _cells(table: pa.Table) -> np.ndarray:
    """Where each run of equal (key, lb, rb) begins, and the end."""
    new = np.zeros(max(table.num_rows - 1, 0), bool)
    for c in ("key", "lb", "rb"):
        x = table[c].to_numpy()
        new |= x[1:] != x[:-1]
    return np.r_[0, np.flatnonzero(new) + 1, table.num_rows]


def _near_rows(
    sig: np.ndarray, n: np.ndarray, comp: np.ndarray, done: np.ndarray, one: tuple[int, int], two: tuple[int, int], percent: int, limit: int
) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of near pairs between two ranges, each in ascending order of n; see _alike()."""
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    sizes = n[two[0] : two[1]]
    for a in range(*one, 64):
        z = min(a + 64, one[1])
        lo = two[0] + int(np.searchsorted(100 * sizes, percent * n[a]))
        hi = two[0] + int(np.searchsorted(percent * sizes, 100 * n[z - 1], "right"))
        if lo >= hi:
            continue
        differ = comp[a:z, None] != comp[None, lo:hi]
        if one == two:
            differ &= np.arange(a, z)[:, None] < np.arange(lo, hi)
        if differ.size < 4096 or differ.mean() < 0.25:  # a few pairs, or few of many, one by one
            i, j = np.nonzero(differ)
            far = (sig[a + i] != sig[lo + j]).sum(1)
        else:
            count = np.zeros(differ.shape, np.uint8)
            theirs = np.ascontiguousarray(sig[lo:hi].T)
            for k in range(sig.shape[1]):
                count += sig[a:z, k, None] != theirs[k]
            i, j = np.nonzero((count <= limit + SLACK) & differ)
            far = count[i, j]
        i, j = i + a, j + lo
        fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        hit = fits & (far <= limit + SLACK) & ((far > limit) | ~(done[i] | done[j]))
        out_i.append(i[hit]), out_j.append(j[hit])
    return np.concatenate(out_i), np.concatenate(out_j)


def _trees(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """For each of ``size`` rows the least row that it is connected with by pairs (i, j)."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _settled(mixed: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int, limit: int, stage: Stage) -> DataFrame:
    """Links (u, v) between components among nodes that meet under keys still mixed; one per node and component.

    Nodes that are connected by near signatures under such keys form a cluster; a key alone,
    which any passage that many texts share can make, connects none. A cell holds two blocks of a
    cluster, of ``CELL_BYTES`` of text and ``CELL_ROWS`` texts each, and counts what the sets of one block have in
    common with those of the other over an inverted list; only links leave it.
    """
    near = stage.keep(_alike(mixed, nodes, percent, limit))
    comps = mixed.select("node", "comp").distinct()
    open_ = near.groupBy(F.col("u").alias("node")).agg(F.bool_or("open").alias("open"))
    clusters = components(near.filter("u <> v").select("u", "v"), stage).withColumnRenamed("root", "cluster")
    rows = open_.join(comps, "node").join(clusters, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    rows = stage.keep(rows.join(texts, "node").select("cluster", "node", "comp", "open", "text"))
    size = rows.groupBy("cluster").agg(F.ceil(F.greatest(F.sum(F.length("text")) / CELL_BYTES, F.count("*") / CELL_ROWS)).cast("int").alias("nb"))
    rows = rows.join(size, "cluster").withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")).withColumn("every", F.expr("sequence(0, nb - 1)"))
    left = rows.filter("open").select("cluster", F.col("b").alias("lb"), F.explode("every").alias("rb"), "node", "comp", "text")
    right = rows.select(F.col("cluster").alias("cluster2"), F.explode("every").alias("lb2"), F.col("b").alias("rb2"), *(F.col(c).alias(f"{c}2") for c in ("node", "comp", "text")))

    def cell(one: pa.Table, two: pa.Table) -> pa.Table:
        u, v = [], []
        if one.num_rows and two.num_rows:
            hashes = WordHashes()
            read = lambda column: shingle_sets([text_bytes(x, lower=True) for x in column.to_pylist()], hashes, width)
            theirs, mine = read(two["text2"]), read(one["text"])
            sizes = np.fromiter(map(len, theirs), np.int64, len(theirs))
            flat = np.concatenate(theirs)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], np.repeat(np.arange(len(theirs)), sizes)[order]
            nodes, comps = two["node2"].to_numpy(), two["comp2"].to_numpy()
            for node, comp, x in zip(one["node"].to_pylist(), one["comp"].to_pylist(), mine):
                lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
                n = hi - lo
                at = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
                same = np.bincount(owner[at], minlength=len(theirs))
                hit = np.flatnonzero((100 * same >= percent * (len(x) + sizes - same)) & (comps != comp))
                _, first = np.unique(comps[hit], return_index=True)
                u += [node] * len(first)
                v += nodes[hit[first]].tolist()
            if len(theirs) + len(mine) > CELL_ROWS // 4:
                release()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return left.groupBy("cluster", "lb", "rb").cogroup(right.groupBy("cluster2", "lb2", "rb2")).applyInArrow(cell, "u long, v long")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, chunks: int = 10, marks: bool = False
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least id of its group), kept (it is that id).

    ``marks`` adds the hash of each row's text. ``percent``: Jaccard similarity from which
    two sets are linked.
    """
    stage = Stage(docs.sparkSession, "near")
    count = chunks * SYMBOLS
    plain = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    signed = stage.keep(_sign(plain.withColumn("mark", F.xxhash64("text")), width, count))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("f")
    nodes = signed.filter("n_shingles > 0").groupBy("node").agg(first, F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    nodes = stage.keep(nodes.select("node", F.col("f.doc_id").alias("id"), F.col("f.mark").alias("mark"), "n", "sig"))
    index = _index(nodes, chunks)
    shared = index.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    found = index.join(shared, "key").select("key", "node", F.col("node").alias("comp"), F.lit(False).alias("done"), "n")
    members = stage.keep(found)

    # one text for each node that has candidates: its first row's
    used = stage.keep(members.select("node").distinct().join(nodes.drop("sig", "n"), "node"))
    rows = plain.withColumn("mark", F.xxhash64("text")).alias("p").join(used.alias("u").hint("merge"), F.expr("p.mark = u.mark and p.doc_id <=> u.id"))
    texts = stage.keep(rows.select("node", "p.text"))
    if texts.count() > used.count():
        texts = stage.keep(texts.dropDuplicates(["node"]))

    # the distance within which the index finds every pair
    limit = 2 * chunks - 1
    symbol = lambda side, k: F.substring(side, k * SYMBOL_BYTES + 1, SYMBOL_BYTES)
    apart = sum((F.when(symbol("sa", k) != symbol("sb", k), 1).otherwise(0) for k in range(count)), F.lit(0))
    tested: DataFrame | None = None
    links: DataFrame | None = None
    labels: DataFrame | None = None
    for turn in range(STARS + 1):
        sizes = members.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key")
        sizes = sizes.agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("m", "comp")).alias("main"))
        mixed = stage.keep(members.join(sizes.filter("comps > 1").select("key", "main"), "key"))
        stage.drop(members)
        if mixed.isEmpty():
            break
        if turn < STARS:
            chosen = mixed.filter("comp <> main and not done").groupBy("key").agg(F.min(F.struct("node", "comp", "n")).alias("p"))
            chosen = stage.keep(chosen.select("key", *(F.col(f"p.{c}").alias(f"p_{c}") for c in ("node", "comp", "n"))))
            pairs = mixed.join(chosen, "key").filter((F.col("comp") != F.col("p_comp")) & _may_reach("n", "p_n", percent))
            pairs = pairs.select(F.least("p_node", "node").alias("a"), F.greatest("p_node", "node").alias("b")).distinct()
        else:
            new = stage.keep(_settled(mixed, nodes, texts, width, percent, limit, stage))
            labels = components(new if links is None else links.unionByName(new), stage)
            break
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
        pairs = pairs.join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
        pairs = stage.keep(pairs.filter(apart <= limit).select("a", "b"))
        new = stage.keep(_confirm(pairs, texts, width, percent))
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = new if links is None else links.unionByName(new)
        stage.free()
        labels = components(links, stage)
        done = chosen.select("key", F.col("p_node").alias("node"), F.lit(True).alias("was"))
        next_ = mixed.join(labels, "node", "left").join(done, ["key", "node"], "left")
        next_ = next_.select("key", "node", F.coalesce("root", "node").alias("comp"), (F.col("done") | F.col("was").isNotNull()).alias("done"), "n")
        members = stage.keep(next_)
        stage.drop(mixed, chosen)
    ids = nodes.select("node", "id")
    ids = ids.join(labels, "node", "left") if labels is not None else ids.withColumn("root", F.col("node"))
    ids = ids.withColumn("root", F.coalesce("root", "node"))
    least = ids.groupBy("root").agg(F.min("id").alias("component"))
    ids = stage.keep(ids.join(least, "root").select("node", "component"))
    out = signed.drop("sig").join(ids, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    kept = F.col("doc_id").eqNullSafe(component).alias("kept")
    return out.select("doc_id", *(["mark"] if marks else []), "n_shingles", component.alias("component_id"), kept)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when each group keeps the document of its least id.

    Rows without words are not linked and all stay. Of rows that repeat an id within a
    group one stays, that of the least hash of its text.
    """
    kept = near_duplicates(docs, doc_id, text, width, percent, marks=True).filter("kept")
    some = kept.filter("n_shingles > 0").groupBy("doc_id", "component_id").agg(F.min("mark").alias("mark"))
    stage = Stage(docs.sparkSession, "one")
    stay = stage.keep(some.select("doc_id", "mark").unionByName(kept.filter("n_shingles = 0").select("doc_id", "mark").distinct()))
    mark, id_ = free_name(docs.columns, "__mark"), free_name(docs.columns, "__id")
    marked = docs.withColumn(mark, F.xxhash64(docs[text].cast("string"))).withColumn(id_, docs[doc_id].cast("long")).alias("d")
    out = marked.join(stay.alias("s"), F.expr(f"d.{mark} = s.mark and d.{id_} <=> s.doc_id"), "left_semi")
    again = marked.groupBy(id_, mark).agg(F.count("*").alias("rows_alike")).filter("rows_alike > 1")
    if not again.isEmpty():
        empty = F.length(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x09-\x0D]", " "))) == 0
        out = out.filter(empty).unionByName(out.filter(~empty).dropDuplicates([id_, mark]))
    return out.select(*docs.columns)
