"""Scalar functions on 3-vectors, keys, colours and symmetric fields.

Every function returns SQL text over double columns that Spark and any ANSI engine
evaluate alike, so that a plan stays one chain of built-in expressions inside
whole-stage code generation. A vector is a triple of SQL texts.
"""

from __future__ import annotations

import functools
import re

Vec = tuple[str, str, str]
_DECIMAL = re.compile(r"(?<![\w.])(\d+\.\d+)(?![\w.])")


def _doubles(f):
    """Decimal literals in the SQL become doubles (1.5 -> 1.5e0): engines differ in
    the arithmetic of decimals."""

    def plain(v):
        if isinstance(v, str):
            return _DECIMAL.sub(r"\1e0", v)
        return type(v)(map(plain, v)) if isinstance(v, (tuple, list)) else v

    @functools.wraps(f)
    def run(*args, **kwargs):
        return plain(f(*args, **kwargs))

    return run


def vec(prefix: str) -> Vec:
    """Columns <prefix>x, <prefix>y, <prefix>z."""
    return (f"{prefix}x", f"{prefix}y", f"{prefix}z")


def dot(a: Vec, b: Vec) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b)) + ")"


def norm2(a: Vec) -> str:
    return dot(a, a)


def dist2(a: Vec, b: Vec) -> str:
    d = sub(a, b)
    return dot(d, d)


def add(a: Vec, b: Vec) -> Vec:
    return tuple(f"({x} + {y})" for x, y in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(f"({x} - {y})" for x, y in zip(a, b))


def mul(a: Vec, s: str) -> Vec:
    return tuple(f"({x} * {s})" for x in a)


def cross(a: Vec, b: Vec) -> Vec:
    return (f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})",
            f"({a[0]} * {b[1]} - {a[1]} * {b[0]})")


def unit(a: Vec) -> Vec:
    """a / |a|; null for the zero vector."""
    return tuple(f"({x} / nullif(sqrt({norm2(a)}), 0))" for x in a)


@_doubles
def signum(x: str) -> str:
    """-1 below zero, else 1."""
    return f"(CASE WHEN {x} < 0 THEN -1.0 ELSE 1.0 END)"


@_doubles
def modulo(a: str, b: str) -> str:
    """The remainder with the sign of a positive b."""
    return f"({a} - floor({a} / {b}) * {b})"


@_doubles
def affine(m: list[float], p: Vec) -> Vec:
    """Row-major 4x4 matrix applied to a point."""
    return tuple(f"({m[4 * r]!r} * {p[0]} + {m[4 * r + 1]!r} * {p[1]} + {m[4 * r + 2]!r} * {p[2]} + {m[4 * r + 3]!r})"
                 for r in range(3))


@_doubles
def linear(m: list[float], n: Vec) -> Vec:
    """The matrix's linear part, for normals."""
    return tuple(f"({m[4 * r]!r} * {n[0]} + {m[4 * r + 1]!r} * {n[1]} + {m[4 * r + 2]!r} * {n[2]})" for r in range(3))


def inverse_affine(m: list[float]) -> list[float]:
    import numpy as np

    return np.linalg.inv(np.array(m).reshape(4, 4)).ravel().tolist()


@_doubles
def tangent_frame(n: Vec) -> tuple[Vec, Vec]:
    """Two vectors orthogonal to a unit normal: the second lies in the coordinate
    plane that n leans away from, the first is their cross product."""
    wide = f"(abs({n[0]}) > abs({n[1]}))"
    a = f"sqrt({n[0]} * {n[0]} + {n[2]} * {n[2]})"
    b = f"sqrt({n[1]} * {n[1]} + {n[2]} * {n[2]})"
    c = (f"(CASE WHEN {wide} THEN {n[2]} / nullif({a}, 0) ELSE 0.0 END)",
         f"(CASE WHEN {wide} THEN 0.0 ELSE {n[2]} / nullif({b}, 0) END)",
         f"(CASE WHEN {wide} THEN -{n[0]} / nullif({a}, 0) ELSE -{n[1]} / nullif({b}, 0) END)")
    return cross(c, n), c


# --- keys -----------------------------------------------------------------

@_doubles
def grid_index(x: str, origin: float, size: float) -> str:
    return f"CAST(floor(({x} - ({origin!r})) / {size!r}) AS BIGINT)"


def morton(ix: str, iy: str, iz: str, bits: int) -> str:
    """Interleaved bits of three non-negative integers, x lowest."""
    terms = []
    for b in range(bits):
        for d, i in enumerate((ix, iy, iz)):
            terms.append(f"((({i} >> {b}) & 1) << {3 * b + d})")
    return "(" + " + ".join(terms) + ")"


def ancestor(code: str, level: int, sub_bits: int = 4) -> str:
    """Cell code at a level: level 1 is the grid, level 0 its sub-cells."""
    return code if level == 0 else f"({code} >> {3 * (sub_bits + level - 1)})"


# --- colours --------------------------------------------------------------
# sRGB matrix, white point in 16 bits, and its inverse.

TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560),
            (0.0556434, -0.2040259, 1.0572252))
WHITE = (62289.0, 65535.0, 71356.0)
DELTA = 6.0 / 29.0


def _row(m, v: Vec) -> str:
    return "(" + " + ".join(f"{k!r} * {x}" for k, x in zip(m, v)) + ")"


def _clamp16(x: str) -> str:
    return f"CAST(floor(greatest(0.0, least(65535.0, {x}))) AS INT)"


def _cube(t: str) -> str:
    return f"(CASE WHEN {t} > {DELTA ** 3!r} THEN pow({t}, {1 / 3!r}) ELSE {t} / {3 * DELTA * DELTA!r} + {4 / 29!r} END)"


def _uncube(t: str) -> str:
    return f"(CASE WHEN {t} > {DELTA!r} THEN {t} * {t} * {t} ELSE {3 * DELTA * DELTA!r} * ({t} - {4 / 29!r}) END)"


@_doubles
def rgb_to_lab(rgb: Vec) -> Vec:
    """16-bit linear RGB to 16-bit CIE Lab, clamped and truncated."""
    fx, fy, fz = (_cube(f"({_row(TO_XYZ[r], rgb)} / {WHITE[r]!r})") for r in range(3))
    return (_clamp16(f"655.35 * (116 * {fy} - 16)"), _clamp16(f"327.67 * (500 * ({fx} - {fy})) + 32768"),
            _clamp16(f"327.67 * (200 * ({fy} - {fz})) + 32768"))


@_doubles
def lab_to_rgb(lab: Vec) -> Vec:
    light = f"(({lab[0]} / 655.35 + 16) / 116.0)"
    a, b = f"(({lab[1]} - 32768) / 327.67 / 500.0)", f"(({lab[2]} - 32768) / 327.67 / 200.0)"
    xyz = tuple(f"({w!r} * {_uncube(t)})" for w, t in zip(WHITE, (f"({light} + {a})", light, f"({light} - {b})")))
    return tuple(_clamp16(_row(FROM_XYZ[r], xyz)) for r in range(3))


@_doubles
def gamma_correct(x: str) -> str:
    """A 0..1 channel to 8 bits with exponent 1/2.2."""
    return f"CAST(floor(pow({x}, {1 / 2.2!r}) * 255.0) AS INT)"


@_doubles
def linear_colour(byte: str) -> str:
    """An 8-bit channel to a linear 16-bit one."""
    return f"CAST(floor(pow({byte} / 255.0, 2.2) * 65535.0) AS INT)"


# --- symmetric direction fields ---------------------------------------------

@_doubles
def rotate(q: Vec, n: Vec, cos: float, sin: float) -> Vec:
    """q turned about the unit normal n."""
    c = cross(n, q)
    return tuple(f"({cos!r} * {x} + {sin!r} * {y})" for x, y in zip(q, c))


SIXTY = (0.5, 3 ** 0.5 / 2)


def directions(q: Vec, n: Vec, rosy: int) -> list[Vec]:
    """Representative directions up to sign: 1, 2 or 3 of them for rosy 2, 4, 6."""
    if rosy == 2:
        return [q]
    if rosy == 4:
        return [q, cross(n, q)]
    if rosy == 6:
        return [rotate(q, n, SIXTY[0], -SIXTY[1]), q, rotate(q, n, *SIXTY)]
    raise ValueError("rosy must be 2, 4 or 6")


def compatible_steps(q0: Vec, n0: Vec, q1: Vec, n1: Vec, rosy: int, keep: list[str], out0: str, out1: str) -> list[list[str]]:
    """Select lists that add the compatible pair of directions as out0x.. and out1x..
    to the columns keep: of all pairs of representatives the first with the largest
    absolute dot product, the second signed so that it isn't negative. rosy 2 keeps
    the first as it is."""
    a, b = directions(q0, n0, rosy), directions(q1, n1, rosy)
    k = range(len(a))
    name = lambda v, p: [f"{t} AS {p}{c}" for t, c in zip(v, "xyz")]
    reps = [f"{p}{i}" for p in ("r", "s") for i in k]
    one = keep + [x for p, side in (("r", a), ("s", b)) for i in k for x in name(side[i], f"{p}{i}")]
    cols = keep + [f"{r}{c}" for r in reps for c in "xyz"]
    pairs = [(i, j) for i in k for j in k]
    two = cols + [f"{dot(vec(f'r{i}'), vec(f's{j}'))} AS d{i}{j}" for i, j in pairs]
    largest = "greatest(" + ", ".join(f"abs(d{i}{j})" for i, j in pairs) + ")" if len(pairs) > 1 else "abs(d00)"
    three = cols + [f"d{i}{j}" for i, j in pairs] + [f"{largest} AS largest"]

    def pick(text) -> str:
        return "(CASE " + " ".join(f"WHEN abs(d{i}{j}) = largest THEN {text(i, j)}" for i, j in pairs) + " END)"

    four = keep + [f"{pick(lambda i, j: f'r{i}{c}')} AS {out0}{c}" for c in "xyz"]
    four += [f"{pick(lambda i, j: f's{j}{c} * {signum(f'd{i}{j}')}')} AS {out1}{c}" for c in "xyz"]
    return [one, two, three, four]


def frame_scores(q0: Vec, n0: Vec, q1: Vec, n1: Vec, rosy: int, keep: list[str]) -> list[list[str]]:
    """Select lists that add (i, j, turn, score): which representative of either side fit
    best, 1 or -1 if the second is turned around, and the cosine between them; of equal
    ones the first."""
    a, b = directions(q0, n0, rosy), directions(q1, n1, rosy)
    pairs = [(i, j) for i in range(len(a)) for j in range(len(b))]
    one = keep + [f"{t} AS {p}{i}{c}" for p, side in (("r", a), ("s", b)) for i, v in enumerate(side) for c, t in zip("xyz", v)]
    two = keep + [f"{dot(vec(f'r{i}'), vec(f's{j}'))} AS d{i}{j}" for i, j in pairs]
    largest = "greatest(" + ", ".join(f"abs(d{i}{j})" for i, j in pairs) + ")" if len(pairs) > 1 else "abs(d00)"
    three = keep + [f"d{i}{j}" for i, j in pairs] + [f"{largest} AS score"]
    pick = lambda text: "CASE " + " ".join(f"WHEN abs(d{i}{j}) = score THEN {text(i, j)}" for i, j in pairs) + " END"
    four = keep + [f"{pick(lambda i, j: i)} AS i", f"{pick(lambda i, j: j)} AS j",
                   f"CAST({pick(lambda i, j: signum(f'd{i}{j}'))} AS INT) AS turn", "score"]
    return [one, two, three, four]


def into_plane(q: Vec, source: Vec, target: Vec) -> Vec:
    """q of the plane of one unit normal turned into that of another, about the line the
    planes share; q itself where the normals are nearly equal."""
    c, axis = dot(source, target), cross(source, target)
    turned = cross(axis, q)
    along = f"({dot(axis, q)} * (1 - {c}) / nullif({norm2(axis)}, 0))"
    return tuple(f"(CASE WHEN {c} < 0.9999e0 THEN {x} * {c} + {t} + {k} * {along} ELSE {x} END)" for x, t, k in zip(q, turned, axis))


def shifted(q: Vec, n: Vec, rosy: int, times: int) -> Vec:
    """q turned by `times` steps of its symmetry about n."""
    import math

    angle = 2 * math.pi * (times % rosy) / rosy
    return rotate(q, n, round(math.cos(angle), 15) + 0.0, round(math.sin(angle), 15) + 0.0)


# --- symmetric position fields ----------------------------------------------

def second_axis(q: Vec, n: Vec, posy: int) -> Vec:
    if posy == 4:
        return cross(n, q)
    if posy == 6:
        return rotate(q, n, *SIXTY)
    raise ValueError("posy must be 4 or 6")


@_doubles
def middle_point(p0: Vec, n0: Vec, p1: Vec, n1: Vec) -> Vec:
    """The point in both tangent planes with the least squared distance to p0 and
    p1, with a small term that keeps parallel planes solvable."""
    c = dot(n0, n1)
    d0, d1 = f"({dot(n0, p1)} - {dot(n0, p0)})", f"({dot(n1, p0)} - {dot(n1, p1)})"
    denom = f"(1.0 / (1.0 - {c} * {c} + 0.0001))"
    l0, l1 = f"(2.0 * ({d0} - {c} * {d1}) * {denom})", f"(2.0 * ({d1} - {c} * {d0}) * {denom})"
    return tuple(f"(0.5 * ({a} + {b}) - 0.25 * ({x} * {l0} + {y} * {l1}))" for a, b, x, y in zip(p0, p1, n0, n1))


@_doubles
def lattice_coordinates(o: Vec, q: Vec, n: Vec, p: Vec, scale: float, posy: int) -> tuple[str, str]:
    """Real lattice coordinates of p relative to o."""
    d, t = sub(p, o), second_axis(q, n, posy)
    u, v = dot(q, d), dot(t, d)
    if posy == 4:
        return f"({u} / {scale!r})", f"({v} / {scale!r})"
    return f"((4 * {u} - 2 * {v}) / 3.0 / {scale!r})", f"((4 * {v} - 2 * {u}) / 3.0 / {scale!r})"


@_doubles
def lattice_point(o: Vec, q: Vec, t: Vec, u: str, v: str, scale: float) -> Vec:
    return tuple(f"({a} + ({b} * {u} + {c} * {v}) * {scale!r})" for a, b, c in zip(o, q, t))


def round_position(o: Vec, q: Vec, n: Vec, p: Vec, scale: float) -> Vec:
    """The point of the square lattice through o nearest to p."""
    u, v = lattice_coordinates(o, q, n, p, scale, 4)
    return lattice_point(o, q, cross(n, q), f"round({u})", f"round({v})", scale)


def round_steps(o: Vec, q: Vec, n: Vec, p: Vec, scale: float, posy: int, keep: list[str]) -> list[list[str]]:
    """Select lists that add rx, ry, rz: the lattice point nearest to p, of the four around
    it for triangles, whose coordinates can't be rounded one by one."""
    t = second_axis(q, n, posy)
    u, v = lattice_coordinates(o, q, n, p, scale, posy)
    one = keep + [f"{e} AS {k}" for e, k in zip((*o, *q, *t, *p), [f"{s}{c}" for s in ("lo", "lq", "lt", "lp") for c in "xyz"])]
    one += [f"floor({u}) AS lu", f"floor({v}) AS lv"]
    corner = lambda i, j: lattice_point(vec("lo"), vec("lq"), vec("lt"), f"(lu + {i})", f"(lv + {j})", scale)
    every = [(i, j) for j in (0, 1) for i in (0, 1)]
    two = keep + [f"{e} AS c{k}{c}" for k, (i, j) in enumerate(every) for c, e in zip("xyz", corner(i, j))] + [f"lp{c}" for c in "xyz"]
    three = keep + [f"c{k}{c}" for k in range(4) for c in "xyz"] + [f"{dist2(vec(f'c{k}'), vec('lp'))} AS far{k}" for k in range(4)]
    least = "least(" + ", ".join(f"far{k}" for k in range(4)) + ")"
    four = keep + [f"CASE {' '.join(f'WHEN far{k} = {least} THEN c{k}{c}' for k in range(4))} END AS r{c}" for c in "xyz"]
    return [one, two, three, four]


def compatible_positions(scale: float, posy: int, keep: list[str]) -> list[list[str]]:
    """Select lists that add the closest pair c0, c1 of lattice points around the middle of
    two points a_ and b_ with fields (x, n, q, o): of the four corners on either side the
    first pair with the least squared distance."""
    a, b = (lambda f: vec(f"a_{f}")), (lambda f: vec(f"b_{f}"))
    ends = [f"{s}_{f}{c}" for s in "ab" for f in ("", "n", "q", "o") for c in "xyz"]
    m = middle_point(a(""), a("n"), b(""), b("n"))
    one = keep + ends + [f"{t} AS m{c}" for c, t in zip("xyz", m)] + [
        f"{t} AS t{k}{c}" for k, s in (("0", a), ("1", b)) for c, t in zip("xyz", second_axis(s("q"), s("n"), posy))]
    at = [lattice_coordinates(s("o"), s("q"), s("n"), vec("m"), scale, posy) for s in (a, b)]
    two = keep + ends + [f"t{k}{c}" for k in "01" for c in "xyz"] + [f"floor({x}) AS {n}{k}" for k, uv in zip("01", at) for n, x in zip("uv", uv)]
    corners = [(i, j) for j in (0, 1) for i in (0, 1)]
    three = keep + [f"{t} AS p{k}{n}{c}" for k, s in (("0", a), ("1", b)) for n, (i, j) in enumerate(corners)
                    for c, t in zip("xyz", lattice_point(s("o"), s("q"), vec(f"t{k}"), f"(u{k} + {i})", f"(v{k} + {j})", scale))]
    points = [f"p{k}{n}{c}" for k in "01" for n in range(4) for c in "xyz"]
    pairs = [(i, j) for i in range(4) for j in range(4)]
    four = keep + points + [f"{dist2(vec(f'p0{i}'), vec(f'p1{j}'))} AS d{i}{j}" for i, j in pairs]
    five = keep + points + [f"d{i}{j}" for i, j in pairs] + ["least(" + ", ".join(f"d{i}{j}" for i, j in pairs) + ") AS d2"]
    pick = lambda text: "CASE " + " ".join(f"WHEN d{i}{j} = d2 THEN {text(i, j)}" for i, j in pairs) + " END"
    six = keep + [f"{pick(lambda i, j: f'p0{i}{c}')} AS c0{c}" for c in "xyz"] + [f"{pick(lambda i, j: f'p1{j}{c}')} AS c1{c}" for c in "xyz"] + ["d2"]
    return [one, two, three, four, five, six]


# --- interpolation ------------------------------------------------------------

@_doubles
def bilinear(a: str, b: str, c: str, d: str, u: str, v: str) -> str:
    """Corners in ring order."""
    return f"((1 - {v}) * ((1 - {u}) * {a} + {u} * {b}) + {v} * ((1 - {u}) * {d} + {u} * {c}))"


@_doubles
def barycentric(a: str, b: str, c: str, u: str, v: str) -> str:
    return f"((1 - {u} - {v}) * {a} + {u} * {b} + {v} * {c})"
