"""Clouds and graphs with many more pairs than points."""

import duckdb
import pytest
from pyspark.sql import functions as F

from meshloom.operators import graph
from meshloom.plans import registry


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """The test cloud drawn together: the same points, a third of the size."""
    d = str(tmp_path_factory.mktemp("dense"))
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    part = F.expr("transform(embedding, (e, i) -> IF(i < 3, CAST(e / 4 AS FLOAT), e))")
    df.withColumn("embedding", part).write.parquet(f"{d}/embeddings.parquet")
    return d


def _same(spark, d, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{d}/embeddings.parquet/*.parquet')")
    df = registry.QUERIES[name](spark, d)
    cols = sorted(df.columns)
    plain = lambda rows: sorted(str(tuple(round(float(x), 6) if isinstance(x, float) else x for x in r)) for r in rows)
    got = plain(map(tuple, df.select(*cols).collect()))
    assert got == plain(c.sql(f"SELECT {', '.join(cols)} FROM ({registry.ORACLES[name]})").fetchall()) and got


def test_scans_fill_dense_cells(spark, dense):
    """Some 500 points within a few cells: more than their capacity in the first scan."""
    _same(spark, dense, "stream_integrate")


def _greedy(order, edges):
    at, near, colour = {p: i for i, p in enumerate(order)}, [[] for _ in order], []
    for a, b in edges:
        near[max(at[a], at[b])].append(min(at[a], at[b]))
    for seen in near:
        used = {colour[j] for j in seen}
        colour.append(next(c for c in range(len(used) + 1) if c not in used))
    return dict(zip(order, colour))


@pytest.mark.parametrize("name", ["cliques", "star"])
def test_blocks_of_a_colouring_are_one_greedy_colouring(spark, monkeypatch, name):
    """Five cliques of 30 in a row, or a hub with 300 neighbours, a hundred pairs to a block."""
    monkeypatch.setattr(graph, "PIECE", 100)
    edges = [(0, j) for j in range(1, 300)] if name == "star" else [
        (i, j) for i in range(130) for j in range(i + 1, min(i + 30, 130))]
    df = spark.createDataFrame(edges + edges[:9] + [(b, a) for a, b in edges[:9]] + [(-1, 5), (4, 4)], "a long, b long")
    taken = []
    monkeypatch.setattr(graph, "_blocks", lambda before, f=graph._blocks: taken.append(f(before)) or taken[-1])
    got = {r.node: r.colour for r in graph.colouring(df, spark.range(310).withColumnRenamed("id", "node")).collect()}
    order = [r.id for r in spark.range(-1, 310).selectExpr("id").orderBy(F.xxhash64("id")).collect()]
    assert got == _greedy(order, edges + [(-1, 5)]) and 1 <= len(taken[0]) <= 60


def test_components_from_forests(spark, monkeypatch):
    """Pieces of 50 edges: forests that are emitted, carried along, reduced again or not."""
    edges = [(i, i + 1) for i in range(60)] + [(500, j) for j in range(200, 260)] + [(100, 101), (101, 100), (7, 7), (None, 3), (-5, -9)]
    clique = [(i, j) for i in range(1000, 1030) for j in range(i) if j >= 1000]
    want = ({(i, 0) for i in range(61)} | {(i, 200) for i in [500, *range(200, 260)]} | {(100, 100), (101, 100), (-5, -9), (-9, -9)}
            | {(i, 1000) for i in range(1000, 1030)})
    df = spark.createDataFrame(edges + clique, "a long, b long")
    for piece in (50, 200, 1_000_000):
        monkeypatch.setattr(graph, "PIECE", piece)
        got = [tuple(r) for r in graph.dense_components(df).collect()]
        assert set(got) == want and len(got) == len(want)
    assert graph.dense_components(df.where("a IS NULL")).count() == 0


@pytest.mark.parametrize("name", ["components", "cluster_centroids"])
def test_clusters_of_a_dense_cloud(spark, name, tmp_path):
    """Four thousand pairs among 100 points."""
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 100")
    df.withColumn("embedding", F.expr("transform(embedding, (e, i) -> IF(i < 3, CAST(e / 3 AS FLOAT), e))")).write.parquet(f"{tmp_path}/embeddings.parquet")
    _same(spark, str(tmp_path), name)
