"""Fields of pairs by the batch against the expressions that the SQL is made of."""

import pytest
from pyspark.sql import functions as F

from meshloom.functions import expr as E
from meshloom.operators import extract as X
from meshloom.operators import lattice
from meshloom.operators import spatial as S
from meshloom.operators.tables import cloud, fence
from meshloom.plans import cloud_queries as C
from meshloom.plans import registry

SF = "/root/testdata/sf0.001"


def _bits(df, cols):
    """Rows to the last bit, but for the sign of zero."""
    rows = df.select(*[(F.col(c) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.select(*cols).dtypes]).collect()
    return sorted(repr(tuple(r)) for r in rows)


def _joins(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


@pytest.mark.parametrize("sym", [4, 6])
def test_classes_are_those_of_the_expressions(spark, sym):
    points = cloud(spark, SF)
    want = X.with_fields(S.radius_pairs(points, C.RADIUS).select("src", "dst"), points)
    for step in X.classify_steps(C.SCALE, sym, sym):
        want = fence(want.selectExpr(*step))
    cols = ("src", "dst", "d_dir", "error", "du", "dv", "class")
    got = X.classify_within(points, C.RADIUS, C.SCALE, sym, sym)
    rows = _bits(got, cols)
    assert rows == _bits(want, cols) and len(rows) > 5000
    assert rows == _bits(X.classify(S.radius_pairs(points, C.RADIUS).select("src", "dst"), points, C.SCALE, sym, sym), cols)


@pytest.mark.parametrize("sym", [2, 4, 6])
def test_directions_are_those_of_the_expressions(spark, sym):
    points = cloud(spark, SF)
    pairs, ends = X.pairs_with_fields(points, C.RADIUS), X.with_fields(C._edges(points), points)
    want = ends
    for step in C._compat_steps(sym):
        want = want.selectExpr(*step)
    cols = ("src", "dst", *[f"{n}{c}" for n in "pq" for c in "xyz"])
    assert _bits(lattice.compatible_directions(pairs, sym), cols) == _bits(want, cols)
    turned = E.into_plane(E.vec("a_q"), E.vec("a_n"), E.vec("b_n"))
    want = ends.where(f"{E.dot(E.vec('a_n'), E.vec('b_n'))} < 0.9999e0").selectExpr("src", "dst", *[f"{t} AS p{c}" for t, c in zip(turned, "xyz")])
    assert _bits(lattice.into_plane(pairs), want.columns) == _bits(want, want.columns)


def test_fields_that_are_missing_stay_missing(spark):
    points = cloud(spark, SF).where("pid < 200").withColumn("oy", F.expr("IF(pid % 3 = 0, null, oy)"))
    got = X.classify_within(points, C.RADIUS, C.SCALE)
    lost = got.where("src % 3 = 0 OR dst % 3 = 0")
    assert lost.count() == lost.where("error IS NULL AND d_dir IS NOT NULL AND class = 'link'").count() > 0
    assert got.where("error IS NULL").count() == lost.count()


@pytest.mark.parametrize("name", ["posy4_index", "posy6_index", "edge_classes", "field_energy", "rosy6_compat", "plane_rotations"])
def test_pairs_bring_their_fields_along(spark, name):
    """One join finds the pairs; none carries them, many times the points, to the fields."""
    assert _joins(registry.QUERIES[name](spark, SF)) == 1
