"""Distributed connected components over an edge table."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .tables import shared_dir


#: Edges up to which one task does what rounds of joins do beyond; both give the same rows.
SMALL = 20_000
#: Edges that a task holds at once as arrays, of a forest or of a block of a colouring.
PIECE = 1_000_000


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node of an edge; component is the smallest
    node reachable. Edges are undirected; nulls and self-loops are ignored.

    Alternates two rewrites until a round changes nothing: every node sends its
    larger neighbours to its smallest one, then its smaller neighbours. Each
    round is two shuffles of the edges, which never grow in number, and is
    written to the shared folder; the path to a component's root shrinks
    geometrically. A hub's neighbours are never gathered: its smallest one
    comes from a partially aggregated min, joined back to the edges. Up to SMALL
    edges, counted as they are written, one task unites them instead.
    """
    spark = edges.sparkSession
    e = (edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
         .where("u is not null and v is not null and u <> v")
         .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    marks = [F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("s"),
             F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 31) - 1))).alias("x")]

    def put(df: DataFrame, name: str) -> tuple[DataFrame, str, dict]:
        """Write df; its marks are taken as it is written."""
        path, seen = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", Observation()
        df.observe(seen, *marks).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path, seen.get

    def star(e: DataFrame, large: bool) -> DataFrame:
        """large: v' > node links to the node's minimum; else neighbours below it."""
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(low, "u")
        if large:
            pairs = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            pairs = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .union(low.select("u", F.col("m").alias("v"))))
        return pairs.where("u <> v").distinct()

    e, path, last = put(e, "edges")
    if last["n"] <= SMALL:
        return e.repartition(1).mapInPandas(_united, "node long, component long")
    while True:
        nxt, nxt_path, mark = put(star(star(e, True), False), "edges")
        delete_path(spark, path)
        e, path = nxt, nxt_path
        if mark == last:
            break
        last = mark
    return (e.groupBy("u").agg(F.min("v").alias("component"))
            .select(F.col("u").alias("node"), "component")
            .union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def _united(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, component) of edges (u, v) that fit one task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for pdf in frames:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            x, y = find(u), find(v)
            root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pd.DataFrame({"node": pd.Series(nodes, dtype="int64"), "component": pd.Series([find(x) for x in nodes], dtype="int64")})


def dense_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """connected_components() of bigint nodes with many more edges than nodes: each task
    first reduces its edges to a spanning forest, so edges that say nothing new are never
    shuffled. Forests are reduced again by fewer tasks while that halves them; if they end
    in one task, its forest gives the components, else the rounds go on from there."""
    from .tables import cut

    e = (edges.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("root"))
         .where("node is not null and root is not null and node <> root"))
    schema, e = "node long, root long", e.mapInArrow(_forests, "node long, root long")
    e = cut(e, "forest")
    n = e.count()
    while n > 0:
        tasks = math.ceil(n / PIECE)
        e = cut(e.repartition(tasks).mapInArrow(_forests, schema), "forest")
        before, n = n, e.count()
        if tasks == 1:
            break
        if n > before / 2:
            return connected_components(e, "node", "root")
    return e.select("node", F.col("root").alias("component")).union(e.select("root", "root").distinct())


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (node, root) to the smallest node of each tree that spans a piece of edges;
    trees are carried along from piece to piece while they fit one."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def out(node: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        return forest(np.concatenate([u for u, _ in held]), np.concatenate([v for _, v in held]))

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= PIECE:
            held = [reduced()]
            n = len(held[0][0])
            if n > PIECE / 2:
                yield out(*held[0])
                held, n = [], 0
    if n:
        yield out(*reduced())


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for each node but the smallest, root, of its component of edges u-v."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[:len(u)], at[len(u):]
    label = np.arange(len(ids))
    while True:
        x, y = label[u], label[v]
        apart = x != y
        if not apart.any():
            break
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    below = label != np.arange(len(ids))
    return ids[below], ids[label[below]]


def reachable(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node) that edges (a, b), either way, connect to a seed: whole components."""
    comp = connected_components(edges)
    hit = comp.join(seeds.select(F.col("node")), "node").select("component").distinct()
    return comp.join(hit, "component", "left_semi").select("node").union(seeds.select("node")).distinct()


def without_leaves(edges: DataFrame) -> DataFrame:
    """Edges (a, b) left after removing nodes of degree one until there are none."""
    from .tables import cut

    e = cut(edges.select("a", "b").distinct(), "edges")
    n = e.count()
    while True:
        ends = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node")))
        leaves = ends.groupBy("node").count().where("count = 1").select("node")
        e = cut(e.join(leaves, F.col("a") == F.col("node"), "left_anti")
                .join(leaves, F.col("b") == F.col("node"), "left_anti"), "edges")
        m = e.count()
        if m == n:
            return e
        n = m


def colouring(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, colour): a greedy colouring of undirected edges (a, b) in order of a hash of
    the node: each gets the smallest colour that no neighbour before it has. The order is
    cut into blocks with few edges inside; a block takes in the colours of the blocks
    before it by a join, each edge once, and one task goes node by node through what is
    inside. Edges among B blocks of n are n / B^2 in a block, so blocks grow with the root
    of n. nodes (node) adds isolated ones."""
    from .tables import cut

    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
    a, b = F.col("a"), F.col("b")
    turn = rank("b") < rank("a")
    before = cut(e.select(F.when(turn, a).otherwise(b).alias("node"), F.when(turn, b).otherwise(a).alias("earlier")).distinct(), "earlier")
    every = before.select("node").union(before.select("earlier"))
    every = (every.union(nodes.select("node")) if nodes is not None else every).distinct()
    starts = _blocks(before)
    block = lambda c: F.expr(" + ".join(["0", *[f"IF(xxhash64({c}) >= {s}L, 1, 0)" for s in starts]]))
    before = before.withColumns({"since": block("earlier"), "block": block("node")})
    if starts:
        before = cut(before, "blocks", "block")
    done = None
    for k in range(len(starts) + 1):
        rows = before.where(f"block = {k} AND since = {k}").select("node", "earlier", F.lit(None).cast("int").alias("taken"))
        if done is not None:
            taken = before.where(f"block = {k} AND since < {k}").join(done.withColumnRenamed("node", "earlier"), "earlier", "left")
            # What never stands behind another node has the first colour.
            rows = rows.union(taken.select("node", F.lit(None).cast("long"), F.coalesce("colour", F.lit(0))).distinct())
        got = cut(rows.withColumn("rank", F.xxhash64("node")).repartition(1).mapInArrow(_coloured, "node long, colour int"), "coloured")
        done = got if done is None else done.union(got)
    return every.join(done, "node", "left").select("node", F.coalesce("colour", F.lit(0)).alias("colour"))


def _blocks(before: DataFrame) -> list[int]:
    """Hashes at which blocks of the order start, but the first, so that no more than about
    PIECE pairs (node, earlier) are inside one: slices of the order are put together while
    they have no more. A hub's pairs are in its own slice only as far as the slice goes."""
    n = before.count()
    if n <= PIECE:
        return []
    slices = min(512, max(2, 4 * math.ceil(math.sqrt(n / PIECE))))
    width = (1 << 64) // slices + 1
    at = lambda c: F.expr(f"CAST(floor((CAST(xxhash64({c}) AS DECIMAL(20, 0)) + 9223372036854775808) / {width}) AS INT)")
    inside: dict[int, list[tuple[int, int]]] = {}
    for r in before.groupBy(at("node").alias("i"), at("earlier").alias("j")).count().collect():  # a row for each pair of slices
        inside.setdefault(r["i"], []).append((r["j"], r["count"]))
    starts, first, held = [], 0, 0
    for i in range(slices):
        more = sum(c for j, c in inside.get(i, []) if j >= first)
        if held and held + more > PIECE:
            starts.append(i * width - (1 << 63))
            first, held, more = i, 0, sum(c for j, c in inside.get(i, []) if j >= i)
        held += more
    return starts


def _coloured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Colours of the nodes of (node, earlier, taken, rank) rows, one by one in order of
    rank: earlier is a node of these rows, or one without any before it, whose colour is
    0; taken is a colour that a neighbour has."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got)
    node, rank = table["node"].to_numpy(), table["rank"].to_numpy()
    order = np.lexsort((node, rank))
    node = node[order]
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    ids, ends = node[first], np.r_[first[1:], len(node)]
    by_id = np.argsort(ids)
    none = len(ids)  # where what has no row of its own stands, with the first colour
    earlier = table["earlier"].fill_null(-1).to_numpy()[order]
    here = np.minimum(np.searchsorted(ids[by_id], earlier), none - 1)
    here = np.where(ids[by_id][here] == earlier, by_id[here], none)
    taken = table["taken"].fill_null(-1).to_numpy()[order]
    here = np.where(taken >= 0, none, here)
    colour = np.zeros(none + 1, np.int32)
    used = np.zeros(int(max(taken.max(), 0)) + int((ends - first).max()) + 2, bool)
    for k, (i, j) in enumerate(zip(first.tolist(), ends.tolist())):
        t = taken[i:j]
        seen = np.where(t >= 0, t, colour[here[i:j]])
        used[seen] = True
        colour[k] = used.argmin()
        used[seen] = False
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(colour[:none])], names=["node", "colour"])


def colour_counts(colours: DataFrame, edges: DataFrame) -> DataFrame:
    """(colour, nodes, neighbours): how many nodes a phase has, and neighbours of them."""
    both = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).groupBy("node").agg(
        F.count("*").alias("degree"))
    return (colours.join(both, "node", "left").groupBy("colour")
            .agg(F.count("*").alias("nodes"), F.coalesce(F.sum("degree"), F.lit(0)).alias("neighbours")))


def parity(cells: DataFrame) -> DataFrame:
    """cells (cx, cy, cz, ...) with their phase, 0 to 7, by the parity of their indices:
    cells of one phase never touch, so a phase needs no colouring."""
    return cells.withColumn("phase", F.expr("CAST(pmod(cx, 2) + 2 * pmod(cy, 2) + 4 * pmod(cz, 2) AS INT)"))
