"""Symmetric fields of pairs, a batch of rows at a time.

The expressions that functions/expr.py states as SQL text, in the same order of operations
and so with the same bits: generated code of a whole chain of them is too long a method to
be compiled, and lambdas are not generated at all. Rows hold src, dst and the fields of
both ends, prefixed a_ and b_.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.expr import SIXTY

FIELDS = ("x", "y", "z", "nx", "ny", "nz", "qx", "qy", "qz", "ox", "oy", "oz")
#: Rows computed at once, so that what lies between stays in the cache.
ROWS = 4096
CLASSES = ("drop", "collapse", "link")
Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def _dot(a: Rows, b: Rows) -> np.ndarray:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: Rows, b: Rows) -> Rows:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _sub(a: Rows, b: Rows) -> Rows:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def _rotate(q: Rows, n: Rows, cos: float, sin: float) -> Rows:
    c = _cross(n, q)
    return tuple(cos * x + sin * y for x, y in zip(q, c))


def _directions(q: Rows, n: Rows, rosy: int) -> list[Rows]:
    if rosy == 2:
        return [q]
    if rosy == 4:
        return [q, _cross(n, q)]
    if rosy == 6:
        return [_rotate(q, n, SIXTY[0], -SIXTY[1]), q, _rotate(q, n, *SIXTY)]
    raise ValueError("rosy must be 2, 4 or 6")


def _second_axis(q: Rows, n: Rows, posy: int) -> Rows:
    if posy == 4:
        return _cross(n, q)
    if posy == 6:
        return _rotate(q, n, *SIXTY)
    raise ValueError("posy must be 4 or 6")


def compatible(q0: Rows, n0: Rows, q1: Rows, n1: Rows, rosy: int) -> tuple[Rows, Rows]:
    """expr.compatible_steps: of equal products the first."""
    a, b = _directions(q0, n0, rosy), _directions(q1, n1, rosy)
    d = [_dot(x, y) for x in a for y in b]
    best = np.zeros(len(d[0]), np.int8)
    largest, product = np.abs(d[0]), d[0]
    for k in range(1, len(d)):
        size = np.abs(d[k])
        more = size > largest
        best[more] = k
        largest, product = np.where(more, size, largest), np.where(more, d[k], product)
    sign = np.where(product < 0, -1.0, 1.0)
    first, second = best // len(b), best % len(b)
    k0 = tuple(np.choose(first, [v[c] for v in a]) for c in range(3))
    return k0, tuple(np.choose(second, [v[c] for v in b]) * sign for c in range(3))


def middle_point(p0: Rows, n0: Rows, p1: Rows, n1: Rows) -> Rows:
    c = _dot(n0, n1)
    d0, d1 = _dot(n0, p1) - _dot(n0, p0), _dot(n1, p0) - _dot(n1, p1)
    denom = 1.0 / (1.0 - c * c + 0.0001)
    l0, l1 = 2.0 * (d0 - c * d1) * denom, 2.0 * (d1 - c * d0) * denom
    return tuple(0.5 * (a + b) - 0.25 * (x * l0 + y * l1) for a, b, x, y in zip(p0, p1, n0, n1))


def _coordinates(o: Rows, q: Rows, t: Rows, p: Rows, scale: float, posy: int) -> Rows:
    d = _sub(p, o)
    u, v = _dot(q, d), _dot(t, d)
    if posy == 4:
        return np.floor(u / scale), np.floor(v / scale)
    return np.floor((4 * u - 2 * v) / 3.0 / scale), np.floor((4 * v - 2 * u) / 3.0 / scale)


def lattice_shift(a: Callable[[str], Rows], b: Callable[[str], Rows], scale: float, rosy: int, posy: int) -> tuple:
    """extract.classify_steps: (d_dir, error, du, dv, class as an index of CLASSES)."""
    k0, k1 = compatible(a("q"), a("n"), b("q"), b("n"), rosy)
    t0, t1 = _second_axis(k0, a("n"), posy), _second_axis(k1, b("n"), posy)
    m = middle_point(a(""), a("n"), b(""), b("n"))
    u0, v0 = _coordinates(a("o"), k0, t0, m, scale, posy)
    u1, v1 = _coordinates(b("o"), k1, t1, m, scale, posy)
    at = lambda o, k, t, u, v: [x + (y * u + z * v) * scale for x, y, z in zip(o, k, t)]
    gap = _sub(at(a("o"), k0, t0, u0, v0), at(b("o"), k1, t1, u1, v1))
    cost, best = None, np.zeros(len(u0), np.int8)
    # The 16 corner pairs: bits ti, bi, tj, bj of k; a first corner that is not taken adds nothing.
    first = [[np.zeros(1)] * 3, k0, t0, [x + y for x, y in zip(k0, t0)]]
    for k in range(16):
        s = first[2 * (k >> 3) + (k >> 2 & 1)]
        total = None
        for c in range(3):
            x = s[c]
            if k & 1:
                x = x - k1[c]
            if k & 2:
                x = x - t1[c]
            x = gap[c] + scale * x
            x *= x
            total = x if total is None else total + x
        if cost is None:
            cost = total
        else:
            best[total < cost] = k
            cost = np.minimum(cost, total)
    du = u0 + (best >> 2 & 1) - u1 - (best & 1)
    dv = v0 + (best >> 3) - v1 - (best >> 1 & 1)
    far, wide = np.abs(du), np.abs(dv)
    drop = (far > 1) | (wide > 1)
    if posy == 4:
        drop |= (far == 1) & (wide == 1)
    kind = np.where(drop, 0, np.where((du == 0) & (dv == 0), 1, 2)).astype(np.int8)
    g = _sub(k0, k1)
    return _dot(g, g), cost, du, dv, kind


def turned(q: Rows, source: Rows, target: Rows) -> Rows:
    """expr.into_plane."""
    c, axis = _dot(source, target), _cross(source, target)
    t, size = _cross(axis, q), _dot(axis, axis)
    along = _dot(axis, q) * (1 - c) / np.where(size == 0, np.nan, size)
    return tuple(np.where(c < 0.9999, x * c + y + k * along, x) for x, y, k in zip(q, t, axis))


def packed(points: DataFrame) -> DataFrame:
    """(pid, x, y, z, fields): the FIELDS of a point as doubles in a row, NaN for null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([batch.column(k + 1).to_numpy(zero_copy_only=False).astype(float) for k in range(len(FIELDS))])
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * (8 * len(FIELDS))
            fields = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], fields], names=["pid", "x", "y", "z", "fields"])

    return points.select("pid", *FIELDS).mapInArrow(run, "pid long, x double, y double, z double, fields binary")


def _unpacked(column: pa.Array) -> dict[str, Rows]:
    _, ends, data = column.buffers()
    start = int(np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset])
    rows = np.frombuffer(data, np.float64, len(column) * len(FIELDS), start).reshape(len(column), len(FIELDS))
    cols = np.ascontiguousarray(rows.T)
    return {v: tuple(cols[FIELDS.index(f"{v}{c}")] for c in "xyz") for v in ("", "n", "q", "o")}


def _by_batch(pairs: DataFrame, f: Callable, schema: str, where: Callable | None = None) -> DataFrame:
    """pairs (src, dst, a_fields, b_fields), those that where holds for, with what f makes
    of their fields; no number becomes null."""
    types = [pa.int64() if c.split()[1] == "long" else pa.int8() if c.split()[1] == "tinyint" else pa.float64() for c in schema.split(", ")]
    names = [c.split()[0] for c in schema.split(", ")]

    def column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        if values.dtype.kind != "f":
            return pa.array(values, kind)
        none = np.isnan(values)
        mask = none if none.any() else None
        if kind == pa.int64():
            values = np.where(none, 0, values).astype(np.int64)
        return pa.array(values, kind, mask=mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                rows = batch.slice(first, ROWS)
                with np.errstate(all="ignore"):
                    a, b = _unpacked(rows.column(2)), _unpacked(rows.column(3))
                    out = [rows.column(0), rows.column(1), *map(column, f(a.get, b.get), types)]
                    if where is not None:
                        keep = pa.array(where(a.get, b.get))
                        out = [x.filter(keep) for x in out]
                yield pa.RecordBatch.from_arrays(out, names=["src", "dst", *names])

    return pairs.select("src", "dst", "a_fields", "b_fields").mapInArrow(run, f"src long, dst long, {schema}")


def classified(pairs: DataFrame, scale: float, rosy: int = 4, posy: int = 4) -> DataFrame:
    """(src, dst, d_dir, error, du, dv, class) of pairs with fields."""
    out = _by_batch(pairs, lambda a, b: lattice_shift(a, b, scale, rosy, posy),
                    "d_dir double, error double, du long, dv long, kind tinyint")
    names = " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(CLASSES))
    return out.selectExpr("src", "dst", "d_dir", "error", "du", "dv", f"CASE kind {names} END AS class")


def compatible_directions(pairs: DataFrame, rosy: int) -> DataFrame:
    """(src, dst, px.., qx..): the compatible directions of pairs with fields."""
    def f(a, b):
        p, q = compatible(a("q"), a("n"), b("q"), b("n"), rosy)
        return *p, *q

    return _by_batch(pairs, f, ", ".join(f"{n}{c} double" for n in "pq" for c in "xyz"))


def into_plane(pairs: DataFrame) -> DataFrame:
    """(src, dst, px, py, pz): directions of the first end in the second's tangent plane,
    where the planes differ."""
    return _by_batch(pairs, lambda a, b: turned(a("q"), a("n"), b("n")), "px double, py double, pz double",
                     lambda a, b: _dot(a("n"), b("n")) < 0.9999)
