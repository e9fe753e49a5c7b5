"""Queries over meshes, graphs and symmetries whose SQL is stated anew, without the
expressions that the queries use."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import extract as X
from ..operators import hierarchy as H
from ..operators import lattice, normals, register
from ..operators import spatial as S
from ..operators import texels as T
from ..operators.tables import cut, fence, shared_dir
from ..streaming import Session
from . import cloud_queries as C
from . import mesh_queries  # noqa: F401  (registers its queries, some of which get their SQL here)
from .cloud_queries import _GRID_FACES, _faces, query, with_cloud

_D2 = "pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)"


# --- graphs and faces ---------------------------------------------------------------

@query(f"""WITH k AS (SELECT a.pid AS src, b.pid AS dst, row_number() OVER (PARTITION BY a.pid ORDER BY {_D2}, b.pid) AS r
  FROM cloud a, cloud b WHERE a.pid <> b.pid AND {_D2} <= 0.01),
n AS (SELECT src, dst FROM k WHERE r <= 3)
SELECT src, dst FROM n WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.src = n.dst AND m.dst = n.src)""")
def asymmetric_edges(points, spark, sf_dir):
    return X.asymmetric(cut(S.exact_knn(points, points, 3, 0.1), "near"))


@query(f"""WITH {_GRID_FACES}, s AS (SELECT fid, list_sort(verts) AS v FROM f)
SELECT a.fid, b.fid AS other FROM s a JOIN s b USING (v) WHERE a.fid % 4 = 2 AND b.fid % 4 <> 2""")
def backed_faces(points, spark, sf_dir):
    faces = _faces(points)
    return X.backed(faces.where("fid % 4 = 2"), faces.where("fid % 4 <> 2"))


@query(f"""WITH {_GRID_FACES} SELECT min(fid) AS fid FROM f GROUP BY list_sort(verts)""")
def single_faces(points, spark, sf_dir):
    return X.single_faces(_faces(points)).select("fid")


@query(f"""WITH {_GRID_FACES}, e AS (SELECT v0, v1, row_number() OVER (ORDER BY v0, v1) - 1 AS eid FROM et)
SELECT fid, CAST(k - 1 AS INT) AS pos, CASE WHEN verts[k] < verts[k % 3 + 1] THEN eid ELSE -eid - 1 END AS eid
FROM f, unnest([1, 2, 3]) AS t(k) JOIN e ON v0 = least(verts[k], verts[k % 3 + 1]) AND v1 = greatest(verts[k], verts[k % 3 + 1])""")
def signed_edges(points, spark, sf_dir):
    return X.signed_edges(_faces(points))[1]


@query(f"""WITH {_GRID_FACES}, have AS (SELECT fid, least(a, b) AS v0, greatest(a, b) AS v1 FROM fe),
told AS (SELECT fid + CASE WHEN fid % 9 = 0 THEN 4 ELSE 0 END AS fid, v0, v1 FROM have WHERE v0 % 13 <> 0)
SELECT 'lacking' AS problem, fid, v0, v1 FROM have WHERE NOT EXISTS (
  SELECT 1 FROM told WHERE told.fid = have.fid AND told.v0 = have.v0 AND told.v1 = have.v1)
UNION ALL SELECT 'dangling', fid, v0, v1 FROM told WHERE NOT EXISTS (
  SELECT 1 FROM have WHERE told.fid = have.fid AND told.v0 = have.v0 AND told.v1 = have.v1)""")
def inconsistent_incidence(points, spark, sf_dir):
    faces = _faces(points)
    inc = X.face_edges(faces).select("fid", F.least("a", "b").alias("v0"), F.greatest("a", "b").alias("v1"))
    return X.inconsistent(faces, inc.where("v0 % 13 <> 0").withColumn("fid", F.expr("fid + CASE WHEN fid % 9 = 0 THEN 4 ELSE 0 END")))


@query("""SELECT pid AS v0, pid + 11 AS v1, unnest([pid + 1, pid + 10]) AS vertex FROM cloud WHERE pid % 10 < 9""")
def inner_edges(points, spark, sf_dir):
    base = points.where("pid % 10 < 9")
    quads = base.selectExpr("pid AS fid", "array(pid, pid + 1, pid + 11, pid + 10) AS verts")
    halves = base.selectExpr("pid AS fid", "explode(array(array(pid, pid + 1, pid + 11), array(pid, pid + 11, pid + 10))) AS verts")
    return X.inner_edges(quads, halves)


@query("""WITH l AS (SELECT pid AS a, pid + 1 AS b FROM cloud WHERE pid % 6 < 4),
one AS (SELECT a - a % 3 AS a, b - b % 3 AS b FROM l)
SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM one WHERE a <> b""")
def merged_links(points, spark, sf_dir):
    """Every third vertex takes the next two in."""
    links = points.where("pid % 6 < 4").selectExpr("pid AS a", "pid + 1 AS b")
    pairs = points.selectExpr("pid", "pid + 1 AS next").selectExpr(
        "explode(array(struct(pid AS src, pid - pid % 3 AS dst), struct(next AS src, next - next % 3 AS dst))) AS p").selectExpr("p.src", "p.dst")
    return X.merge_vertices(links, pairs)


@query("SELECT DISTINCT unnest([pid, pid + 1]) AS root FROM cloud WHERE pid % 6 < 2 AND pid + 1 IN (SELECT pid FROM cloud)")
def compact_vertices(points, spark, sf_dir):
    links = points.where("pid % 6 < 2").selectExpr("pid AS a", "pid + 1 AS b").join(points.selectExpr("pid AS b"), "b", "left_semi")
    return X.compact(points.selectExpr("pid AS root"), links)


@query()
def face_degrees(points, spark, sf_dir):
    """How many closed walks of each degree the cloud's links have."""
    return X.simple_orbits(cut(C._ring(points)[0], "ring")).groupBy("degree").agg(F.count("*").alias("faces"))


C.ORACLES["face_degrees"] = C.ORACLES["simple_face_orbits"].replace(C._orbit_sql(), f"SELECT degree, count(*) AS faces FROM ({C._orbit_sql()}) GROUP BY degree")


@query("""WITH b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1, count(*) AS n FROM cloud),
g AS (SELECT *, greatest(x1 - x0, y1 - y0, z1 - z0) AS extent FROM b), h AS (SELECT *, 0.8e0 * extent / pow(n, 0.33e0) AS guess FROM g),
k AS (SELECT count(*) AS cells FROM (SELECT DISTINCT floor(x / guess), floor(y / guess), floor(z / guess) FROM cloud, h)),
s AS (SELECT *, guess * pow(15e0 / (CAST(n AS DOUBLE) / cells), 0.33e0) AS cell FROM h, k),
w AS (SELECT *, greatest(0, CAST(ceil(log2(extent / cell)) AS INT)) AS half FROM s)
SELECT round(cell, 6) AS cell, half + 2 AS levels, round((x0 + x1 - pow(2, half) * cell) / 2, 6) + 0e0 AS ox,
  round((y0 + y1 - pow(2, half) * cell) / 2, 6) + 0e0 AS oy, round((z0 + z1 - pow(2, half) * cell) / 2, 6) + 0e0 AS oz FROM w""")
def grid_plan(points, spark, sf_dir):
    p = H.grid_plan(points)
    return spark.createDataFrame([(p["cell"], int(p["levels"]), p["x"], p["y"], p["z"])], "cell double, levels int, ox double, oy double, oz double")


@query(f"""WITH adj AS (SELECT a.pid AS src, b.pid AS dst FROM cloud a, cloud b WHERE a.pid < b.pid AND {_D2} <= 0.01)
SELECT src, dst FROM adj WHERE src % 5 = 0 AND dst % 5 <> 0""")
def set_halo(points, spark, sf_dir):
    return S.outside_neighbours(points.where("pid % 5 = 0"), C._edges(points))


@query(f"""WITH adj AS (SELECT a.pid AS src, b.pid AS dst, {_D2} AS d FROM cloud a, cloud b WHERE a.pid <> b.pid AND {_D2} <= 0.01),
s AS (SELECT src, sum(exp(-d / 0.0128e0) * nx) AS sx, sum(exp(-d / 0.0128e0) * ny) AS sy, sum(exp(-d / 0.0128e0) * nz) AS sz FROM adj JOIN cloud ON dst = pid GROUP BY src),
m AS (SELECT pid, nx + coalesce(sx, 0) AS mx, ny + coalesce(sy, 0) AS my, nz + coalesce(sz, 0) AS mz FROM cloud LEFT JOIN s ON src = pid)
SELECT pid, round(mx / sqrt(mx * mx + my * my + mz * mz), 6) + 0e0 AS nx, round(my / sqrt(mx * mx + my * my + mz * mz), 6) + 0e0 AS ny,
  round(mz / sqrt(mx * mx + my * my + mz * mz), 6) + 0e0 AS nz FROM m""")
def filtered_normals(points, spark, sf_dir):
    adj = S.radius_join(points, points, 0.1).where("src <> dst")
    return normals.filtered(points, adj, C.SCALE, 1, 1.0).select("pid", "nx", "ny", "nz")


# --- texels ----------------------------------------------------------------------------

def _patch(points) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A strip of the grid's quads and triangles, with its numbered texels."""
    base = points.where("pid % 10 < 9")
    quads = base.where("pid % 3 <> 0").selectExpr("2 * pid AS fid", "array(pid, pid + 1, pid + 11, pid + 10) AS verts")
    halves = base.where("pid % 3 = 0").selectExpr(
        "explode(array(named_struct('fid', 2 * pid, 'verts', array(pid, pid + 1, pid + 11)), "
        "named_struct('fid', 2 * pid + 1, 'verts', array(pid, pid + 11, pid + 10)))) AS f").select("f.*")
    faces = cut(quads.union(halves), "patch")
    vertices = faces.select(F.explode("verts").alias("root")).distinct()
    return vertices, faces, cut(T.numbered_mesh(vertices, faces), "grid")


@query("""WITH f AS (SELECT [pid, pid + 1, pid + 11, pid + 10] AS v FROM cloud WHERE pid % 10 < 9 AND pid % 3 <> 0
UNION ALL SELECT [pid, pid + 1, pid + 11] FROM cloud WHERE pid % 10 < 9 AND pid % 3 = 0
UNION ALL SELECT [pid, pid + 11, pid + 10] FROM cloud WHERE pid % 10 < 9 AND pid % 3 = 0),
e AS (SELECT DISTINCT least(v[k], v[k % len(v) + 1]) AS a, greatest(v[k], v[k % len(v) + 1]) AS b FROM f, unnest(range(1, 5)) AS t(k) WHERE k <= len(v)),
n AS (SELECT (SELECT count(DISTINCT x) FROM (SELECT unnest(v) AS x FROM f)) AS verts, (SELECT count(*) FROM e) AS edges,
  (SELECT count(*) FROM f WHERE len(v) = 4) AS quads, (SELECT count(*) FROM f WHERE len(v) = 3) AS tris)
SELECT verts + 9 * edges + 81 * quads + 36 * tris AS texels, 10 * edges + 180 * quads + 135 * tris AS pairs FROM n""")
def texel_pairs(points, spark, sf_dir):
    """Texels of a mesh and pairs of neighbours: an edge has 10 steps along it; a quad 9
    inner lines of 10 steps in two directions, a triangle 9 of 9 + ... + 1 in three."""
    _, faces, grid = _patch(points)
    pairs = T.texel_neighbours(grid, faces).agg(F.count("*").alias("pairs"))
    return grid.agg(F.countDistinct("texel").alias("texels")).crossJoin(pairs)


@query("""SELECT pid AS obs, 4 AS corners, CAST(1 AS DOUBLE) AS total, round(u, 6) AS u, round(v, 6) AS v FROM (
  SELECT pid, 0.05e0 + (pid % 7) / 8e0 AS u, 0.05e0 + (pid % 5) / 6e0 AS v FROM cloud WHERE pid % 10 < 9 AND pid % 3 <> 0)
UNION ALL SELECT pid, 3, 1e0, round(u, 6), round(v, 6) FROM (
  SELECT pid, 0.03e0 + (pid % 7) / 17e0 AS u, 0.04e0 + (pid % 5) / 11e0 AS v FROM cloud WHERE pid % 10 < 9 AND pid % 3 = 0)""")
def texel_weights(points, spark, sf_dir):
    """Points on faces: how many texels hold them, and that their weights give the points back."""
    _, faces, grid = _patch(points)
    at = points.where("pid % 10 < 9").selectExpr("pid AS obs", "2 * pid AS fid",
        "CASE WHEN pid % 3 <> 0 THEN 0.05e0 + (pid % 7) / 8e0 ELSE 0.03e0 + (pid % 7) / 17e0 END AS u",
        "CASE WHEN pid % 3 <> 0 THEN 0.05e0 + (pid % 5) / 6e0 ELSE 0.04e0 + (pid % 5) / 11e0 END AS v")
    w = T.interpolation_weights(at, grid, faces).join(at.select("obs", "fid"), "obs").join(grid, ["fid", "texel"])
    return w.groupBy("obs").agg(F.count("*").cast("int").alias("corners"), F.sum("w").alias("total"),
                                F.sum(F.col("w") * F.col("i") / 10).alias("u"), F.sum(F.col("w") * F.col("j") / 10).alias("v"))


@query("""WITH f AS (SELECT [pid, pid + 1, pid + 11, pid + 10] AS v FROM cloud WHERE pid % 10 < 9 AND pid % 3 <> 0
UNION ALL SELECT [pid, pid + 1, pid + 11] FROM cloud WHERE pid % 10 < 9 AND pid % 3 = 0
UNION ALL SELECT [pid, pid + 11, pid + 10] FROM cloud WHERE pid % 10 < 9 AND pid % 3 = 0)
SELECT 10 * count(*) AS segments FROM (SELECT DISTINCT least(v[k], v[k % len(v) + 1]), greatest(v[k], v[k % len(v) + 1])
  FROM f, unnest(range(1, 5)) AS t(k) WHERE k <= len(v))""")
def wireframe_segments(points, spark, sf_dir):
    _, faces, grid = _patch(points)
    return T.wireframe(faces, grid).agg(F.count("*").alias("segments"))


@query("SELECT pid AS texel, round(least(65535e0, greatest(0e0, x * 90000)), 6) + 0e0 AS l, round(y, 6) + 0e0 AS h FROM cloud")
def clamped_colours(points, spark, sf_dir):
    return T.clamp_colours(points.selectExpr("pid AS texel", "x * 90000 AS l", "y AS h"))


# --- symmetries --------------------------------------------------------------------------

_PAIR = f"""adj AS (SELECT a.pid AS src, b.pid AS dst FROM cloud a, cloud b WHERE a.pid < b.pid AND {_D2} <= 0.01),
two AS (SELECT src, dst, a.qx AS ax, a.qy AS ay, a.qz AS az, a.ny * a.qz - a.nz * a.qy AS ex, a.nz * a.qx - a.nx * a.qz AS ey,
  a.nx * a.qy - a.ny * a.qx AS ez, b.qx AS cx, b.qy AS cy, b.qz AS cz, b.ny * b.qz - b.nz * b.qy AS dx, b.nz * b.qx - b.nx * b.qz AS dy,
  b.nx * b.qy - b.ny * b.qx AS dz FROM adj JOIN cloud a ON a.pid = src JOIN cloud b ON b.pid = dst),
four AS (SELECT *, [ax * cx + ay * cy + az * cz, ax * dx + ay * dy + az * dz, ex * cx + ey * cy + ez * cz, ex * dx + ey * dy + ez * dz] AS s FROM two),
best AS (SELECT *, list_position(list_transform(s, lambda t: abs(t)), list_max(list_transform(s, lambda t: abs(t)))) - 1 AS k FROM four)"""


@query(f"""WITH {_PAIR} SELECT src, dst, CAST(k // 2 AS INT) AS i, CAST(k % 2 AS INT) AS j, CASE WHEN s[k + 1] < 0 THEN -1 ELSE 1 END AS turn,
  round(abs(s[k + 1]), 6) + 0e0 AS score FROM best""")
def rosy4_scores(points, spark, sf_dir):
    out = X.with_fields(C._edges(points), points)
    for step in E.frame_scores(E.vec("a_q"), E.vec("a_n"), E.vec("b_q"), E.vec("b_n"), 4, ["src", "dst"]):
        out = fence(out.selectExpr(*step))
    return out


C.ORACLES["rosy4_compat"] = with_cloud(f"""WITH {_PAIR}, e AS (SELECT *, CASE WHEN s[k + 1] < 0 THEN -1e0 ELSE 1e0 END AS g FROM best)
SELECT src, dst, {', '.join(f"round(CASE WHEN k < 2 THEN a{c} ELSE e{c} END, 6) + 0e0 AS p{c}, "
                            f"round(g * CASE WHEN k % 2 = 0 THEN c{c} ELSE d{c} END, 6) + 0e0 AS q{c}" for c in 'xyz')} FROM e""")

_GRID6 = """g AS (SELECT pid, x, y, z, ox, oy, oz, qx, qy, qz, 0.5e0 * qx + sqrt(0.75e0) * (ny * qz - nz * qy) AS tx,
  0.5e0 * qy + sqrt(0.75e0) * (nz * qx - nx * qz) AS ty, 0.5e0 * qz + sqrt(0.75e0) * (nx * qy - ny * qx) AS tz FROM cloud),
uv AS (SELECT *, qx * (x - ox) + qy * (y - oy) + qz * (z - oz) AS u, tx * (x - ox) + ty * (y - oy) + tz * (z - oz) AS v FROM g),
fl AS (SELECT *, floor((4 * u - 2 * v) / 3 / 0.08e0) AS iu, floor((4 * v - 2 * u) / 3 / 0.08e0) AS iv FROM uv),
c AS (SELECT pid, i, j, x, y, z, ox + 0.08e0 * (qx * (iu + i) + tx * (iv + j)) AS rx, oy + 0.08e0 * (qy * (iu + i) + ty * (iv + j)) AS ry,
  oz + 0.08e0 * (qz * (iu + i) + tz * (iv + j)) AS rz FROM fl, unnest([0, 1]) AS a(i), unnest([0, 1]) AS b(j))"""


@query(f"""WITH {_GRID6} SELECT pid, round(rx, 6) + 0e0 AS rx, round(ry, 6) + 0e0 AS ry, round(rz, 6) + 0e0 AS rz FROM (
  SELECT *, row_number() OVER (PARTITION BY pid ORDER BY pow(rx - x, 2) + pow(ry - y, 2) + pow(rz - z, 2), j, i) AS k FROM c) WHERE k = 1""")
def posy6_round(points, spark, sf_dir):
    out = points
    for step in E.round_steps(E.vec("o"), E.vec("q"), E.vec("n"), E.vec(""), C.SCALE, 6, ["pid"]):
        out = fence(out.selectExpr(*step))
    return out


C.ORACLES["posy4_round"] = with_cloud("""WITH g AS (SELECT *, ny * qz - nz * qy AS tx, nz * qx - nx * qz AS ty, nx * qy - ny * qx AS tz FROM cloud),
u AS (SELECT *, round((qx * (x - ox) + qy * (y - oy) + qz * (z - oz)) / 0.08e0) AS i, round((tx * (x - ox) + ty * (y - oy) + tz * (z - oz)) / 0.08e0) AS j FROM g)
SELECT pid, round(ox + 0.08e0 * (qx * i + tx * j), 6) + 0e0 AS x, round(oy + 0.08e0 * (qy * i + ty * j), 6) + 0e0 AS y,
  round(oz + 0.08e0 * (qz * i + tz * j), 6) + 0e0 AS z FROM u""")


@query(f"""WITH adj AS (SELECT a.pid AS src, b.pid AS dst FROM cloud a, cloud b WHERE a.pid < b.pid AND {_D2} <= 0.01),
e AS (SELECT src, dst, a.qx, a.qy, a.qz, a.nx AS sx, a.ny AS sy, a.nz AS sz, b.nx AS tx, b.ny AS ty, b.nz AS tz
  FROM adj JOIN cloud a ON a.pid = src JOIN cloud b ON b.pid = dst),
k AS (SELECT *, sx * tx + sy * ty + sz * tz AS c, sy * tz - sz * ty AS ex, sz * tx - sx * tz AS ey, sx * ty - sy * tx AS ez FROM e),
r AS (SELECT *, sqrt(ex * ex + ey * ey + ez * ez) AS s FROM k),
u AS (SELECT *, ex / s AS ux, ey / s AS uy, ez / s AS uz FROM r)
SELECT src, dst, round(qx * c + (uy * qz - uz * qy) * s + ux * (ux * qx + uy * qy + uz * qz) * (1 - c), 5) + 0e0 AS px,
  round(qy * c + (uz * qx - ux * qz) * s + uy * (ux * qx + uy * qy + uz * qz) * (1 - c), 5) + 0e0 AS py,
  round(qz * c + (ux * qy - uy * qx) * s + uz * (ux * qx + uy * qy + uz * qz) * (1 - c), 5) + 0e0 AS pz FROM u WHERE c < 0.9999e0""", 5)
def plane_rotations(points, spark, sf_dir):
    """Directions turned into the neighbour's tangent plane, where the planes differ."""
    return lattice.into_plane(X.pairs_with_fields(points, C.RADIUS))


@query("""WITH t AS (SELECT *, ny * qz - nz * qy AS tx, nz * qx - nx * qz AS ty, nx * qy - ny * qx AS tz FROM cloud)
SELECT pid, round(-qx, 6) + 0e0 AS hx, round(-qy, 6) + 0e0 AS hy, round(-qz, 6) + 0e0 AS hz, round(-tx, 6) + 0e0 AS fx, round(-ty, 6) + 0e0 AS fy,
  round(-tz, 6) + 0e0 AS fz, round(0.5e0 * qx + sqrt(0.75e0) * tx, 6) + 0e0 AS sx, round(0.5e0 * qy + sqrt(0.75e0) * ty, 6) + 0e0 AS sy,
  round(0.5e0 * qz + sqrt(0.75e0) * tz, 6) + 0e0 AS sz FROM t""")
def symmetry_steps(points, spark, sf_dir):
    """Half a turn, three quarters of one, and a sixth."""
    q, n = E.vec("q"), E.vec("n")
    out = {"h": E.shifted(q, n, 2, 1), "f": E.shifted(q, n, 4, 3), "s": E.shifted(q, n, 6, 1)}
    return points.selectExpr("pid", *[f"{t} AS {p}{c}" for p, v in out.items() for t, c in zip(v, "xyz")])


_MIDDLE = f"""adj AS (SELECT a.pid AS src, b.pid AS dst FROM cloud a, cloud b WHERE a.pid < b.pid AND {_D2} <= 0.01),
ends AS (SELECT src, dst, a.x AS px, a.y AS py, a.z AS pz, a.nx AS nx, a.ny AS ny, a.nz AS nz, a.qx AS qx, a.qy AS qy, a.qz AS qz, a.ox AS ox, a.oy AS oy,
  a.oz AS oz, b.x AS rx, b.y AS ry, b.z AS rz, b.nx AS mx, b.ny AS my, b.nz AS mz, b.qx AS sx, b.qy AS sy, b.qz AS sz, b.ox AS wx, b.oy AS wy, b.oz AS wz
  FROM adj JOIN cloud a ON a.pid = src JOIN cloud b ON b.pid = dst),
cosine AS (SELECT *, nx * mx + ny * my + nz * mz AS c, nx * (rx - px) + ny * (ry - py) + nz * (rz - pz) AS e,
  mx * (px - rx) + my * (py - ry) + mz * (pz - rz) AS f FROM ends),
weight AS (SELECT *, 2 * (e - c * f) / (1.0001e0 - c * c) AS k, 2 * (f - c * e) / (1.0001e0 - c * c) AS l FROM cosine),
middle AS (SELECT *, (px + rx) / 2 - (nx * k + mx * l) / 4 AS hx, (py + ry) / 2 - (ny * k + my * l) / 4 AS hy, (pz + rz) / 2 - (nz * k + mz * l) / 4 AS hz,
  ny * qz - nz * qy AS tx, nz * qx - nx * qz AS ty, nx * qy - ny * qx AS tz, my * sz - mz * sy AS vx, mz * sx - mx * sz AS vy, mx * sy - my * sx AS vz FROM weight),
low AS (SELECT *, floor((qx * (hx - ox) + qy * (hy - oy) + qz * (hz - oz)) / 0.08e0) AS i0, floor((tx * (hx - ox) + ty * (hy - oy) + tz * (hz - oz)) / 0.08e0) AS j0,
  floor((sx * (hx - wx) + sy * (hy - wy) + sz * (hz - wz)) / 0.08e0) AS i1, floor((vx * (hx - wx) + vy * (hy - wy) + vz * (hz - wz)) / 0.08e0) AS j1 FROM middle),
corner AS (SELECT src, dst, n, m, {', '.join(f"o{c} + 0.08e0 * (q{c} * (i0 + n % 2) + t{c} * (j0 + n // 2)) AS a{c}, w{c} + 0.08e0 * (s{c} * (i1 + m % 2) + v{c} * (j1 + m // 2)) AS d{c}" for c in 'xyz')}
  FROM low, unnest([0, 1, 2, 3]) AS g(n), unnest([0, 1, 2, 3]) AS h(m)),
cost AS (SELECT *, pow(ax - dx, 2) + pow(ay - dy, 2) + pow(az - dz, 2) AS d2 FROM corner)"""


@query(f"""WITH {_MIDDLE} SELECT src, dst, round(d2, 6) + 0e0 AS d2, {', '.join(f"round(a{c}, 6) + 0e0 AS c0{c}, round(d{c}, 6) + 0e0 AS c1{c}" for c in 'xyz')}
FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY d2, n, m) AS r FROM cost) WHERE r = 1""")
def posy4_compat(points, spark, sf_dir):
    out = X.with_fields(C._edges(points), points)
    for step in E.compatible_positions(C.SCALE, 4, ["src", "dst"]):
        out = fence(out.selectExpr(*step))
    return out


@query("""WITH c AS (SELECT DISTINCT CAST(floor((x + 1e0) / 0.08e0) AS BIGINT) AS a, CAST(floor((y + 1e0) / 0.08e0) AS BIGINT) AS b,
  CAST(floor((z + 1e0) / 0.08e0) AS BIGINT) AS c FROM cloud), p AS (SELECT DISTINCT a // 2 AS a, b // 2 AS b, c // 2 AS c FROM c),
o AS (SELECT s.a AS sa, s.b AS sb, s.c AS sc, i, j, k, EXISTS (SELECT 1 FROM c t WHERE t.a = s.a + i AND t.b = s.b + j AND t.c = s.c + k) AS near
  FROM c s, unnest([-1, 0, 1]) AS x(i), unnest([-1, 0, 1]) AS y(j), unnest([-1, 0, 1]) AS z(k) WHERE i <> 0 OR j <> 0 OR k <> 0)
SELECT 0 AS up, count(*) AS links FROM o WHERE near UNION ALL SELECT 1, count(*) FROM o WHERE NOT near AND EXISTS (
  SELECT 1 FROM p WHERE p.a = sa // 2 + i AND p.b = sb // 2 + j AND p.c = sc // 2 + k)""")
def coarser_neighbours(points, spark, sf_dir):
    cells = points.selectExpr(*[f"{E.grid_index(c, C.ORIGIN, C.CELL)} AS {n}" for c, n in zip("xyz", S.CELL)])
    return S.adjacent_or_coarser(cells).groupBy("up").agg(F.count("*").alias("links"))


@query(f"""WITH k AS (SELECT a.x, a.y, a.z, b.x AS tx, b.y AS ty, b.z AS tz, b.nx, b.ny, b.nz, row_number() OVER (PARTITION BY a.pid ORDER BY {_D2}, b.pid) AS r
  FROM cloud a, cloud b WHERE a.scan_id = 1 AND b.scan_id <> 1 AND {_D2} <= 0.01 AND a.nx * b.nx + a.ny * b.ny + a.nz * b.nz >= 0.7e0)
SELECT round(max(abs(nx * (tx - x) + ny * (ty - y) + nz * (tz - z))), 6) AS worst FROM k WHERE r = 1""")
def plane_residual(points, spark, sf_dir):
    pairs = register.nearest_compatible_between(points.where("scan_id = 1"), points.where("scan_id <> 1"), 0.2)
    return spark.createDataFrame([(register.residual_norm(pairs),)], "worst double")


# --- colours and keys, stated step by step -------------------------------------------------

C.ORACLES["rgb_lab"] = with_cloud("""WITH xyz AS (SELECT pid, (0.4124564e0 * c0 + 0.3575761e0 * c1 + 0.1804375e0 * c2) / 62289e0 AS x,
  (0.2126729e0 * c0 + 0.7151522e0 * c1 + 0.0721750e0 * c2) / 65535e0 AS y, (0.0193339e0 * c0 + 0.1191920e0 * c1 + 0.9503041e0 * c2) / 71356e0 AS z FROM cloud),
f AS (SELECT pid, CASE WHEN x > 216e0 / 24389 THEN pow(x, 1e0 / 3) ELSE x * 841 / 108 + 4e0 / 29 END AS x,
  CASE WHEN y > 216e0 / 24389 THEN pow(y, 1e0 / 3) ELSE y * 841 / 108 + 4e0 / 29 END AS y,
  CASE WHEN z > 216e0 / 24389 THEN pow(z, 1e0 / 3) ELSE z * 841 / 108 + 4e0 / 29 END AS z FROM xyz)
SELECT pid, CAST(floor(least(65535, greatest(0, 655.35e0 * (116 * y - 16)))) AS INT) AS l,
  CAST(floor(least(65535, greatest(0, 327.67e0 * (500 * (x - y)) + 32768))) AS INT) AS a,
  CAST(floor(least(65535, greatest(0, 327.67e0 * (200 * (y - z)) + 32768))) AS INT) AS b FROM f""")

_BITS = "CAST(list_sum(list_transform(range(12), lambda k: (((i >> k) & 1) << (3 * k)) + (((j >> k) & 1) << (3 * k + 1)) + (((l >> k) & 1) << (3 * k + 2)))) AS BIGINT)"
C.ORACLES["morton_codes"] = with_cloud(f"""WITH g AS (SELECT pid, CAST(floor((x + 1) / 0.005e0) AS BIGINT) AS i, CAST(floor((y + 1) / 0.005e0) AS BIGINT) AS j,
  CAST(floor((z + 1) / 0.005e0) AS BIGINT) AS l FROM cloud), m AS (SELECT pid, {_BITS} AS code FROM g)
SELECT pid, code, code // 4096 AS level1, code // 32768 AS level2, code // 262144 AS level3 FROM m""")


# --- sessions, files and generators ----------------------------------------------------------

@query("""SELECT pid FROM cloud WHERE pid % 4 <> 1 AND pow(x - 0.1e0, 2) + pow(y, 2) + pow(z + 0.1e0, 2) > 0.01e0""")
def session_edits(points, spark, sf_dir):
    """Four scans, of which one is removed again, then a sphere deleted: the ids left."""
    session = Session(spark, f"{shared_dir(spark)}/session-{uuid.uuid4().hex}", C.ORIGIN, C.CELL, 2, 1e9)
    for k in range(4):
        session.integrate(points.where(f"pid % 4 = {k}"))
    session.remove_scan(2)
    session.delete_sphere((0.1, 0.0, -0.1), 0.1)
    return session.points().select("pid")


C.ORACLES["io_roundtrip"] = with_cloud("""SELECT row_number() OVER (ORDER BY pid) - 1 AS pid, round(x, 6) + 0e0 AS x, round(y, 6) + 0e0 AS y, round(z, 6) + 0e0 AS z,
  round(nx, 6) + 0e0 AS nx, round(ny, 6) + 0e0 AS ny, round(nz, 6) + 0e0 AS nz FROM cloud""")

C.ORACLES["brush_smoothing"] = with_cloud(f"""WITH m AS (SELECT a.pid, sum(w * ex) / sum(w) - any_value(a.x) AS dx, sum(w * ey) / sum(w) - any_value(a.y) AS dy,
  sum(w * ez) / sum(w) - any_value(a.z) AS dz FROM (SELECT a.pid, a.x, a.y, a.z, b.x AS ex, b.y AS ey, b.z AS ez, exp(-9e0 * ({_D2}) / 0.01e0) AS w
  FROM cloud a, cloud b WHERE {_D2} <= 0.01e0) a GROUP BY a.pid)
SELECT pid, {', '.join(f'round({c} + 0.5e0 * (dx * nx + dy * ny + dz * nz) * n{c}, 6) + 0e0 AS {c}' for c in 'xyz')},
  {', '.join(f'round(n{c}, 6) + 0e0 AS n{c}' for c in 'xyz')} FROM cloud JOIN m USING (pid)""")

# The query's session has no capacity: every point of every scan counts.
C.ORACLES["stream_integrate"] = C.ORACLES["level_rollup"]

C.ORACLES["procedural_tube"] = """WITH g AS (SELECT i * 0.04e0 AS x0, (i + 1) * 0.04e0 AS x1, j, k, k / 50e0 AS t, i * 200 + j * 50 + k AS pid
  FROM range(55) AS a(i), range(4) AS b(j), range(50) AS c(k) WHERE i > 0),
r AS (SELECT pid, k, t, x0, x1, cos(x0 / 3 + j * pi() / 2) AS ay, sin(x0 / 3 + j * pi() / 2) AS az, cos(x0 / 3 + (j + 1) * pi() / 2) AS hy,
  sin(x0 / 3 + (j + 1) * pi() / 2) AS hz, cos(x1 / 3 + j * pi() / 2) AS cy, sin(x1 / 3 + j * pi() / 2) AS cz, cos(x1 / 3 + (j + 1) * pi() / 2) AS dy,
  sin(x1 / 3 + (j + 1) * pi() / 2) AS dz, cos(x0 / 3 + (j - 1) * pi() / 2) AS ey, sin(x0 / 3 + (j - 1) * pi() / 2) AS ez FROM g),
p AS (SELECT pid, x0 AS x, (1 - t) * ay + t * hy AS y, (1 - t) * az + t * hz AS z, hy - CASE WHEN k = 0 THEN ey ELSE ay END AS sy,
  hz - CASE WHEN k = 0 THEN ez ELSE az END AS sz, x1 - x0 AS vx, (1 - t) * (cy - ay) + t * (dy - hy) AS vy, (1 - t) * (cz - az) + t * (dz - hz) AS vz FROM r),
n AS (SELECT pid, x, y, z, sy * vz - sz * vy AS mx, sz * vx AS my, -sy * vx AS mz FROM p)
SELECT CAST(pid AS BIGINT) AS pid, round(x, 6) + 0e0 AS x, round(y, 6) + 0e0 AS y, round(z, 6) + 0e0 AS z,
  round(mx / sqrt(mx * mx + my * my + mz * mz), 6) + 0e0 AS nx, round(my / sqrt(mx * mx + my * my + mz * mz), 6) + 0e0 AS ny,
  round(mz / sqrt(mx * mx + my * my + mz * mz), 6) + 0e0 AS nz FROM n
UNION ALL SELECT CAST(1000000000 + i * 51 + j AS BIGINT), 0e0, round((1 - i / 50e0) * (1 - j / 50e0) - (i / 50e0) * (j / 50e0), 6) + 0e0,
  round((1 - i / 50e0) * (j / 50e0) - (i / 50e0) * (1 - j / 50e0), 6) + 0e0, -1e0, 0e0, 0e0 FROM range(51) AS a(i), range(51) AS b(j)"""
