"""Registration of scans: manual, from picked pairs, and iterative closest points.

An iteration is one nearest-compatible join and one aggregation of the 27 sums of
the point-to-plane normal equations; the driver solves a 6x6 system."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from . import kernels
from .hierarchy import transformed
from .tables import cut

#: Outer iterations, the norm of the sparse residual, first penalty and its growth.
STEPS, POWER, PENALTY, GROWTH = 10, 1.5, 10.0, 1.2


def matrix(r: np.ndarray, t: np.ndarray) -> list[float]:
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = r, t
    return m.ravel().tolist()


def from_pairs(source: list, target: list) -> list[float]:
    """The rigid transform of picked point pairs."""
    return matrix(*kernels.rigid_fit(np.array(source, float), np.array(target, float)))


def manual(picked_source, picked_target) -> list[float]:
    """The translation of one picked pair."""
    return matrix(np.eye(3), np.array(picked_target, float) - np.array(picked_source, float))


def correspondences(scan: DataFrame, base: DataFrame, max_error: float, share: int = 10) -> DataFrame:
    """Source points with their target's position and normal; of each bucket of
    like normals one in `share` (by hash), at least one."""
    both = scan.select("pid", "x", "y", "z", "nx", "ny", "nz")
    near = nearest_compatible_between(both, base, max_error)
    bucket = [F.expr("CAST(nx * 10 AS INT)"), F.expr("CAST(ny * 10 AS INT)"), F.expr("CAST(nz * 10 AS INT)")]
    keyed = near.withColumn("bucket", F.hash(*bucket))
    first = keyed.groupBy("bucket").agg(F.min("src").alias("least"))
    return keyed.join(first, "bucket").where(F.expr(f"src = least OR pmod(xxhash64(src), {share}) = 0"))


def nearest_compatible_between(scan: DataFrame, base: DataFrame, max_error: float, cos: float = 0.7) -> DataFrame:
    """Each scan point (src, position, normal) with its nearest compatible base point."""
    from .spatial import radius_join

    cols = ("pid", "x", "y", "z", "nx", "ny", "nz")
    pairs = radius_join(scan.select(*cols), base.select(*cols), max_error / 2, ("x", "y", "z", "nx", "ny", "nz"))
    agree = F.expr(E.dot(E.vec("a_n"), E.vec("b_n"))) >= cos
    best = pairs.where(agree).groupBy("src").agg(F.min_by(F.struct(*[c for c in pairs.columns if c[:2] in ("a_", "b_")]),
                                                        F.struct("d2", "dst")).alias("m"))
    return best.select("src", *[F.col(f"m.a_{c}").alias(c) for c in cols[1:]], *[F.col(f"m.b_{c}").alias(f"t{c}") for c in cols[1:]])


def plane_step(pairs: DataFrame) -> list[float] | None:
    """The small motion that best moves sources onto target planes, with weights
    |residual|^(p-2) of the sparse norm; None with fewer than three pairs."""
    s, t, n = E.vec(""), E.vec("t"), E.vec("tn")
    r = E.dot(n, E.sub(t, s))
    row = E.cross(s, n) + n
    names = [f"r{i}" for i in range(6)]
    j = pairs.selectExpr(*[f"{e} AS {k}" for e, k in zip(row, names)], f"{r} AS r")
    j = j.withColumn("w", F.expr(f"pow(greatest(abs(r), 1e-6), {POWER - 2})"))
    sums = [F.sum(F.col("w") * F.col(names[a]) * F.col(names[b])).alias(f"a{a}{b}") for a in range(6) for b in range(a, 6)]
    got = j.agg(F.count("*").alias("n"), *sums, *[F.sum(F.col("w") * F.col(k) * F.col("r")).alias(f"b{i}") for i, k in enumerate(names)]).first()
    if got["n"] < 3:
        return None
    a = np.zeros((6, 6))
    for i in range(6):
        for k in range(i, 6):
            a[i, k] = a[k, i] = got[f"a{i}{k}"]
    x = np.linalg.lstsq(a + 1e-9 * np.trace(a) * np.eye(6), np.array([got[f"b{i}"] for i in range(6)]), rcond=None)[0]
    return matrix(kernels.small_rotation(x[:3]), x[3:])


def point_step(pairs: DataFrame) -> list[float]:
    """The rigid motion of sources onto target points, from 15 sums."""
    s, t = ("x", "y", "z"), ("tx", "ty", "tz")
    got = pairs.agg(*[F.avg(c).alias(c) for c in s + t], *[F.avg(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in s for b in t]).first()
    ca, cb = np.array([got[c] for c in s]), np.array([got[c] for c in t])
    h = np.array([[got[f"{a}_{b}"] for b in t] for a in s]) - np.outer(ca, cb)
    u, _, vt = np.linalg.svd(h)
    r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
    return matrix(r, cb - r @ ca)


def residual_norm(pairs: DataFrame) -> float:
    """The largest distance of a source from its target's plane."""
    r = E.dot(E.vec("tn"), E.sub(E.vec("t"), E.vec("")))
    return pairs.agg(F.max(F.abs(F.expr(r))).alias("r")).first()["r"] or 0.0


def calibrate(scan: DataFrame, base: DataFrame, picked_source: list, picked_target: list, max_error: float, **how) -> list[float]:
    """The transform of a scanner from picked pairs of points, refined by align()."""
    first = np.array(from_pairs(picked_source, picked_target)).reshape(4, 4)
    moved = transformed(scan.select("pid", "x", "y", "z", "nx", "ny", "nz"), first.ravel().tolist())
    return (np.array(align(moved, base, max_error, **how)).reshape(4, 4) @ first).ravel().tolist()


def turntable(poses: list[list[float]]) -> tuple[list[float], list[float]]:
    """Axis and a point on it, from the transforms of one object as it turns."""
    axis, point = kernels.turntable_axis(np.array(poses, float).reshape(-1, 4, 4))
    return axis.tolist(), point.tolist()


def align(scan: DataFrame, base: DataFrame, max_error: float, rounds: int = 4, steps: int = 5,
          share: int = 10) -> list[float]:
    """The transform that registers scan to base: rounds of a halving search radius.
    The scan is left alone while fewer than ten points have a partner."""
    total = np.eye(4)
    base = cut(base.select("pid", "x", "y", "z", "nx", "ny", "nz"), "base")
    for k in range(rounds):
        for _ in range(steps):
            moved = transformed(scan.select("pid", "x", "y", "z", "nx", "ny", "nz"), total.ravel().tolist())
            pairs = cut(correspondences(moved, base, max_error / 2 ** k, share), "pairs")
            if pairs.count() < 10:
                break
            step = plane_step(pairs)
            if step is None:
                break
            m = np.array(step).reshape(4, 4)
            total = m @ total
            if np.abs(m - np.eye(4)).max() < 1e-9 or residual_norm(pairs) < 1e-12:
                break
    return total.ravel().tolist()
