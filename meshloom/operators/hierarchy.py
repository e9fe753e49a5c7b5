"""Cleaning, keys and the multi-resolution summary with retractable aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E

#: Points a cell is tuned for, and the area above which a cell takes no more.
TARGET, CAPACITY = 15, 90
SUMS = ("weight", "sx", "sy", "sz", "snx", "sny", "snz")


def bounding_box(points: DataFrame) -> DataFrame:
    return points.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "xyz" for f in (F.min, F.max)])


def valid(points: DataFrame) -> DataFrame:
    """Rows whose position and normal are numbers."""
    cols = ("x", "y", "z", "nx", "ny", "nz")
    good = None
    for c in cols:
        ok = F.col(c).isNotNull() & ~F.isnan(c)
        good = ok if good is None else good & ok
    return points.where(good)


def above(points: DataFrame, height: float, matrix: list[float]) -> DataFrame:
    """Points whose transformed y is not below the height."""
    return points.where(F.expr(f"{E.affine(matrix, E.vec(''))[1]} >= {height!r}"))


def transformed(points: DataFrame, matrix: list[float]) -> DataFrame:
    p, n = E.affine(matrix, E.vec("")), E.linear(matrix, E.vec("n"))
    new = dict(zip(("x", "y", "z", "nx", "ny", "nz"), map(F.expr, p + n)))
    return points.select(*[new[c].alias(c) if c in new else c for c in points.columns])


def subsample(points: DataFrame, keep: int, of: int) -> DataFrame:
    """A fixed share of points by an arithmetic hash of the id, whose low 31 bits count
    so that the product stays within 64."""
    return points.where(F.expr(f"(pmod(pid, 2147483648) * 2654435761) % 4294967296 % {of} < {keep}"))


def auto_scale(points: DataFrame, share: float = 1.0) -> DataFrame:
    """Edge length, neighbour radius and registration error that suit the cloud."""
    diag2 = "+".join(f"(max({c}) - min({c})) * (max({c}) - min({c}))" for c in "xyz")
    scale = f"6.0 * sqrt(({diag2}) / ({share!r} * count(*)))"
    return points.agg(F.expr(scale).alias("scale"), F.expr(f"3.0 * {scale}").alias("radius"),
                      F.expr(f"0.02 * sqrt({diag2})").alias("max_error"))


def codes(points: DataFrame, origin: float, cell: float, bits: int = 12) -> DataFrame:
    """points with their Morton code at a sixteenth of the cell."""
    index = [E.grid_index(c, origin, cell / 16) for c in "xyz"]
    return points.withColumn("code", F.expr(E.morton(*index, bits)))


def grid_tuning(points: DataFrame, origin: float, cell: float) -> DataFrame:
    """Occupied cells at a first guess, and the cell size for TARGET points each."""
    index = [E.grid_index(c, origin, cell) for c in "xyz"]
    cells = points.select(*[F.expr(i).alias(n) for i, n in zip(index, ("cx", "cy", "cz"))]).groupBy("cx", "cy", "cz").count()
    return cells.agg(F.count("*").alias("cells"), F.sum("count").alias("points")).select(
        "cells", "points", F.expr(f"{cell!r} * pow({TARGET} / (points / cells), 0.33)").alias("size"))


def grid_plan(points: DataFrame) -> dict[str, float]:
    """Cell size for TARGET points each, levels of the hierarchy, and the origin (x, y, z)
    that centres the finest grid on the cloud. The first guess is the extent over the
    cube root of the points, corrected once by the cells that it fills. Two aggregates."""
    box = bounding_box(points).crossJoin(points.agg(F.count("*").alias("n"))).first()
    extent = max(box[f"max_{c}"] - box[f"min_{c}"] for c in "xyz")
    guess = 0.8 * extent / box["n"] ** 0.33
    index = [F.expr(f"CAST(floor({c} / {guess!r}) AS BIGINT)") for c in "xyz"]
    cells = points.select(*index).distinct().count()
    cell = guess * (TARGET / (box["n"] / cells)) ** 0.33
    halvings = max(0, math.ceil(math.log2(extent / cell)))
    wide = 2 ** halvings * cell
    return {"cell": cell, "levels": halvings + 2} | {c: 0.5 * (box[f"min_{c}"] + box[f"max_{c}"] - wide) for c in "xyz"}


def occupancy(coded: DataFrame, cell: float) -> DataFrame:
    """Occupied level-1 cells, points per cell, and average spacing."""
    c = coded.select(F.expr(E.ancestor("code", 1)).alias("cell")).groupBy("cell").count()
    return c.agg(F.count("*").alias("cells"), F.sum("count").alias("points")).select(
        "cells", F.expr("points / cells").alias("per_cell"),
        F.expr(f"sqrt(cells * {cell!r} * {cell!r} / points)").alias("spacing"))


def deltas(coded: DataFrame, levels: int, sign: int = 1) -> DataFrame:
    """Signed sums of every cell on every level.

    The finest level is aggregated first; coarser ones are rolled up from its
    cells, so the levels multiply cells and not points."""
    fine = coded.groupBy(F.expr(E.ancestor("code", 1)).alias("fine")).agg(
        F.lit(sign).cast("double").alias("one"), F.count("*").alias("n"),
        *[F.sum(c).alias(f"s{c}") for c in ("x", "y", "z", "nx", "ny", "nz")])
    signed = fine.select("fine", (F.col("n") * sign).cast("double").alias("weight"),
                         *[(F.col(c) * sign).alias(c) for c in SUMS[1:]])
    lifted = signed.select(F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level"), "fine", *SUMS)
    cell = F.expr("shiftright(fine, 3 * (level - 1))").alias("cell")
    return lifted.groupBy("level", cell).agg(*[F.sum(c).alias(c) for c in SUMS])


def summed(*changes: DataFrame) -> DataFrame:
    """Signed sums of several changes, cell by cell."""
    cols = ("level", "cell", *SUMS)
    rows = changes[0].select(*cols)
    for c in changes[1:]:
        rows = rows.union(c.select(*cols))
    return rows.groupBy("level", "cell").agg(*[F.sum(c).alias(c) for c in SUMS])


def merge(nodes: DataFrame, *changes: DataFrame) -> DataFrame:
    """Nodes after signed changes; empty cells vanish."""
    return summed(nodes, *changes).where("weight > 0.5")


def means(nodes: DataFrame) -> DataFrame:
    """Mean position and unit normal of each node, from its sums."""
    length = "nullif(sqrt(snx * snx + sny * sny + snz * snz), 0)"
    return nodes.selectExpr("level", "cell", "weight", *[f"s{c} / weight AS {c}" for c in "xyz"],
                            *[f"sn{c} / {length} AS n{c}" for c in "xyz"])


def with_capacity(incoming: DataFrame, nodes: DataFrame, capacity: float = CAPACITY) -> DataFrame:
    """Coded points whose level-1 cell is not full."""
    full = nodes.where(f"level = 1 AND weight > {capacity}").select(F.col("cell").alias("full"))
    return incoming.join(full, F.expr(f"{E.ancestor('code', 1)} = full"), "left_anti")


def apply_changes(points: DataFrame, nodes: DataFrame, levels: int, inserts: DataFrame | None = None,
                  updates: DataFrame | None = None, deletes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Points and nodes after one batch. Updates replace rows of their pid or, for
    an unknown pid, insert; deletes need pid only."""
    gone = None
    for change in (updates, deletes):
        if change is not None:
            ids = change.select("pid")
            gone = ids if gone is None else gone.union(ids)
    added = [c.select(*points.columns) for c in (inserts, updates) if c is not None]
    changes, kept = [], points
    if gone is not None:
        gone = gone.distinct()
        changes.append(deltas(points.join(gone, "pid", "left_semi"), levels, -1))
        kept = points.join(gone, "pid", "left_anti").select(*points.columns)
    for a in added:
        changes.append(deltas(a, levels))
        kept = kept.union(a)
    return kept, merge(nodes, *changes) if changes else nodes


def normal_buckets(points: DataFrame) -> DataFrame:
    """Points by truncated tenfold normal."""
    keys = [F.expr(f"CAST(CASE WHEN n{a} < 0 THEN ceil(n{a} * 10) ELSE floor(n{a} * 10) END AS INT)").alias(f"b{a}")
            for a in "xyz"]
    return points.groupBy(*keys).count().withColumnRenamed("count", "points")


def pca_moments(neighbours: DataFrame) -> DataFrame:
    """First and second moments of (src, x, y, z) rows per src."""
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    return neighbours.groupBy("src").agg(
        F.count("*").alias("k"), *[F.avg(a).alias(f"m{a}") for a in "xyz"],
        *[(F.avg(F.col(a) * F.col(b)) - F.avg(a) * F.avg(b)).alias(f"c{a}{b}") for a, b in pairs])


def face_normals(faces: DataFrame, points: DataFrame) -> DataFrame:
    """Unit vertex normals: sums of un-normalised cross products of (v0, v1, v2) faces."""
    f = faces
    for i in range(3):
        f = f.join(points.select(F.col("pid").alias(f"v{i}"), *[F.col(c).alias(f"p{i}{c}") for c in "xyz"]), f"v{i}")
    c = E.cross(E.sub(E.vec("p1"), E.vec("p0")), E.sub(E.vec("p2"), E.vec("p0")))
    per = f.select(F.explode(F.array("v0", "v1", "v2")).alias("pid"), *[F.expr(t).alias(f"c{a}") for t, a in zip(c, "xyz")])
    sums = per.groupBy("pid").agg(*[F.sum(f"c{a}").alias(f"c{a}") for a in "xyz"])
    return sums.select("pid", *[F.expr(t).alias(f"n{a}") for t, a in zip(E.unit(E.vec("c")), "xyz")])


def position_colours(points: DataFrame) -> DataFrame:
    """A colour from the position, for clouds without one, in Lab."""
    wave = lambda a: f"(32767.0 * (1.0 + sin(20.0 * {a})))"
    lab = E.rgb_to_lab(tuple(map(wave, "xyz")))
    return points.select(*points.columns, *[F.expr(t).alias(n) for t, n in zip(lab, ("l", "a", "b"))])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Double columns rounded, and no negative zero."""
    def r(name: str, kind: str) -> Column:
        return (F.round(name, digits) + 0.0).alias(name) if kind == "double" else F.col(name)

    return df.select(*[r(n, k) for n, k in df.dtypes])
