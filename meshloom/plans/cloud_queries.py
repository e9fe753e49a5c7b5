"""Queries over the point-cloud views, each with the SQL of its result.

The oracles state results by brute force (all pairs, all levels) where the queries
use keys, halves and roll-ups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import extract as X
from ..operators import hierarchy as H
from ..operators import lattice
from ..operators import spatial as S
from ..operators.graph import dense_components, without_leaves
from ..operators.tables import cloud, cloud_sql, cut

#: Grid of the cloud: origin, cell, levels; radius of neighbourhoods; lattice scale.
ORIGIN, CELL, LEVELS, RADIUS, SCALE = -1.0, 0.08, 4, 0.1, 0.08
MATRIX = [0.8, -0.6, 0.0, 0.25, 0.6, 0.8, 0.0, -0.5, 0.0, 0.0, 1.0, 1.5, 0.0, 0.0, 0.0, 1.0]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 6):
    """Register a function (points, spark, sf_dir) and its SQL over the view `cloud`."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return H.rounded(f(cloud(spark, sf_dir), spark, sf_dir), digits)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = with_cloud(sql)
        return f

    return register


def with_cloud(sql: str) -> str:
    head = f"cloud AS ({cloud_sql()})"
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {sql[len('WITH RECURSIVE'):]}"
    if sql.upper().startswith("WITH "):
        return f"WITH {head}, {sql[len('WITH '):]}"
    return f"WITH {head} {sql}"


def r6(e: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({e} AS DOUBLE), {digits}) + 0e0 AS {name}"


def _pick(names, prefix="") -> str:
    return ", ".join(r6(f"{prefix}{n}", n) for n in names)


# --- rows ---------------------------------------------------------------------

@query("SELECT " + ", ".join(r6(f"{f}({c})", f"{f}_{c}") for c in "xyz" for f in ("min", "max")) + " FROM cloud")
def cloud_bbox(points, spark, sf_dir):
    return H.bounding_box(points)


_t = dict(zip(("x", "y", "z"), E.affine(MATRIX, E.vec("")))) | dict(zip(("nx", "ny", "nz"), E.linear(MATRIX, E.vec("n"))))


@query("SELECT pid, " + ", ".join(r6(t, n) for n, t in _t.items()) + " FROM cloud")
def cloud_transform(points, spark, sf_dir):
    return H.transformed(points, MATRIX).select("pid", *_t)


@query(f"SELECT pid, {_pick('xyz')} FROM cloud WHERE {_t['y']} >= -0.45")
def height_cutoff(points, spark, sf_dir):
    return H.above(points, -0.45, MATRIX).select("pid", "x", "y", "z")


@query("SELECT pid FROM (SELECT pid, CASE WHEN pid % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE x END AS x, nx FROM cloud) "
       "WHERE NOT isnan(x) AND x IS NOT NULL AND NOT isnan(nx) AND nx IS NOT NULL")
def valid_filter(points, spark, sf_dir):
    holes = points.withColumn("x", F.expr("CASE WHEN pid % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE x END"))
    return H.valid(holes).select("pid")


_d2 = "(" + "+".join(f"(max({c}) - min({c})) * (max({c}) - min({c}))" for c in "xyz") + ")"


@query(f"SELECT {r6(f'6.0 * sqrt({_d2} / count(*))', 'scale')}, {r6(f'18.0 * sqrt({_d2} / count(*))', 'radius')}, "
       f"{r6(f'0.02 * sqrt({_d2})', 'max_error')} FROM cloud")
def auto_scale(points, spark, sf_dir):
    return H.auto_scale(points)


@query("SELECT pid FROM cloud WHERE (pid % 2147483648 * 2654435761) % 4294967296 % 10 < 3")
def hash_subsample(points, spark, sf_dir):
    return H.subsample(points, 3, 10).select("pid")


_lab = E.rgb_to_lab(("c0", "c1", "c2"))


@query("SELECT pid, " + ", ".join(f"{t} AS {n}" for n, t in zip(("l", "a", "b"), _lab)) + " FROM cloud")
def rgb_lab(points, spark, sf_dir):
    return points.select("pid", *[F.expr(t).alias(n) for n, t in zip(("l", "a", "b"), _lab)])


_rgb = E.lab_to_rgb(("l", "a", "b"))


@query("SELECT pid, " + ", ".join(f"{t} AS {n}" for n, t in zip(("r", "g", "bl"), _rgb)) + " FROM (SELECT pid, "
       + ", ".join(f"{t} AS {n}" for n, t in zip(("l", "a", "b"), _lab)) + " FROM cloud)")
def lab_rgb(points, spark, sf_dir):
    lab = points.select("pid", *[F.expr(t).alias(n) for n, t in zip(("l", "a", "b"), _lab)])
    return lab.select("pid", *[F.expr(t).alias(n) for n, t in zip(("r", "g", "bl"), _rgb)])


_g = [(f"{E.gamma_correct(f'(c{k} / 65535.0)')}", f"g{k}") for k in range(3)]
_lin = E.linear_colour("(pid % 256)")


@query(f"SELECT pid, {', '.join(f'{t} AS {n}' for t, n in _g)}, {_lin} AS linear FROM cloud")
def gamma_colours(points, spark, sf_dir):
    return points.selectExpr("pid", *[f"{t} AS {n}" for t, n in _g], f"{_lin} AS linear")


_wave = E.rgb_to_lab(tuple(f"(32767.0 * (1.0 + sin(20.0 * {a})))" for a in "xyz"))


@query("SELECT pid, " + ", ".join(f"{t} AS {n}" for n, t in zip(("l", "a", "b"), _wave)) + " FROM cloud")
def position_colours(points, spark, sf_dir):
    return H.position_colours(points.select("pid", "x", "y", "z")).select("pid", "l", "a", "b")


_frame = E.tangent_frame(E.vec("n"))


@query("SELECT pid, " + ", ".join(r6(t, f"{n}{c}") for n, v in zip("bc", _frame) for c, t in zip("xyz", v))
       + f", {r6(E.modulo('x', '0.07'), 'rest')}, {E.signum('x')} AS sign FROM cloud")
def tangent_frames(points, spark, sf_dir):
    return points.selectExpr("pid", *[f"{t} AS {n}{c}" for n, v in zip("bc", _frame) for c, t in zip("xyz", v)],
                             f"{E.modulo('x', '0.07')} AS rest", f"{E.signum('x')} AS sign")


@query("SELECT CAST(trunc(nx * 10) AS INT) AS bx, CAST(trunc(ny * 10) AS INT) AS by, CAST(trunc(nz * 10) AS INT) AS bz, "
       "count(*) AS points FROM cloud GROUP BY ALL")
def normal_buckets(points, spark, sf_dir):
    return H.normal_buckets(points)


# --- keys and levels ------------------------------------------------------------

_grid = [E.grid_index(c, ORIGIN, CELL) for c in "xyz"]
_fine = [E.grid_index(c, ORIGIN, CELL / 16) for c in "xyz"]
CODE = E.morton(*_fine, 12)
NODES = f"""
WITH p AS (SELECT *, {CODE} AS code FROM cloud),
lv AS (SELECT unnest(range(1, {LEVELS + 1})) AS level)
"""
_SUMS = ", ".join(r6(f"sum({e})", n) for n, e in zip(H.SUMS, ("1.0", "x", "y", "z", "nx", "ny", "nz")))


@query(f"SELECT {', '.join(f'{g} AS {n}' for g, n in zip(_grid, ('cx', 'cy', 'cz')))}, count(*) AS points "
       "FROM cloud GROUP BY ALL")
def voxel_counts(points, spark, sf_dir):
    return points.selectExpr(*[f"{g} AS {n}" for g, n in zip(_grid, ("cx", "cy", "cz"))]).groupBy(
        "cx", "cy", "cz").agg(F.count("*").alias("points"))


@query(f"SELECT pid, {CODE} AS code, {' , '.join(f'{E.ancestor(CODE, k)} AS level{k}' for k in (1, 2, 3))} FROM cloud")
def morton_codes(points, spark, sf_dir):
    return H.codes(points, ORIGIN, CELL).selectExpr("pid", "code", *[f"{E.ancestor('code', k)} AS level{k}" for k in (1, 2, 3)])


@query(f"SELECT count(*) AS cells, CAST(sum(n) AS BIGINT) AS points, {r6(f'{CELL} * pow(15 / (sum(n) / count(*)), 0.33)', 'size')} FROM "
       f"(SELECT count(*) AS n FROM cloud GROUP BY {', '.join(_grid)})")
def grid_tuning(points, spark, sf_dir):
    return H.grid_tuning(points, ORIGIN, CELL)


@query(f"SELECT count(*) AS cells, {r6('sum(n) / count(*)', 'per_cell')}, "
       f"{r6(f'sqrt(count(*) * {CELL} * {CELL} / sum(n))', 'spacing')} FROM "
       f"(SELECT count(*) AS n FROM (SELECT {CODE} AS code FROM cloud) GROUP BY {E.ancestor('code', 1)})")
def occupancy(points, spark, sf_dir):
    return H.occupancy(H.codes(points, ORIGIN, CELL), CELL)


@query(NODES + f"SELECT level, code >> CAST(3 * (level + 3) AS INT) AS cell, {_SUMS} FROM p, lv GROUP BY ALL")
def level_rollup(points, spark, sf_dir):
    return H.deltas(H.codes(points, ORIGIN, CELL), LEVELS).withColumn("level", F.col("level").cast("long"))


_MEAN = ", ".join([r6("count(*)", "weight"), *[r6(f"avg({c})", c) for c in "xyz"],
                   *[r6(f"sum(n{c}) / nullif(sqrt(sum(nx) * sum(nx) + sum(ny) * sum(ny) + sum(nz) * sum(nz)), 0)", f"n{c}")
                     for c in "xyz"]])


@query(NODES + f"SELECT level, code >> CAST(3 * (level + 3) AS INT) AS cell, {_MEAN} FROM p, lv GROUP BY ALL")
def level_means(points, spark, sf_dir):
    return H.means(H.deltas(H.codes(points, ORIGIN, CELL), LEVELS)).withColumn("level", F.col("level").cast("long"))


@query(NODES + f"""SELECT level, code >> CAST(3 * (level + 3) AS INT) AS cell, {_SUMS}
FROM (SELECT pid, {CODE} AS code, x, y, z, nx, ny, nz FROM (
  SELECT pid, CASE WHEN pid % 11 = 1 THEN x + 0.05 ELSE x END AS x, y, z, nx, ny, nz FROM cloud WHERE pid % 5 <> 0)), lv
GROUP BY ALL""")
def incremental_merge(points, spark, sf_dir):
    """Two batches of inserts, moved points, then deletions, against the final state."""
    p = H.codes(points.select("pid", "x", "y", "z", "nx", "ny", "nz"), ORIGIN, CELL)
    nodes = H.deltas(p.where("pid % 2 = 0"), LEVELS)
    state, nodes = H.apply_changes(p.where("pid % 2 = 0"), nodes, LEVELS, inserts=p.where("pid % 2 = 1"))
    moved = H.codes(points.where("pid % 11 = 1").withColumn("x", F.expr("x + 0.05")).select(*points.select(
        "pid", "x", "y", "z", "nx", "ny", "nz").columns), ORIGIN, CELL)
    state, nodes = H.apply_changes(state, nodes, LEVELS, updates=moved)
    state, nodes = H.apply_changes(state, nodes, LEVELS, deletes=points.where("pid % 5 = 0"))
    return nodes.withColumn("level", F.col("level").cast("long"))


@query(f"""WITH p AS (SELECT pid, {E.ancestor(CODE, 1)} AS cell FROM cloud),
full_cells AS (SELECT cell FROM p WHERE pid % 2 = 0 GROUP BY cell HAVING count(*) > 3)
SELECT pid FROM p WHERE pid % 2 = 1 AND cell NOT IN (SELECT cell FROM full_cells)""")
def cell_capacity(points, spark, sf_dir):
    coded = H.codes(points, ORIGIN, CELL)
    nodes = H.deltas(coded.where("pid % 2 = 0"), 1).withColumn("weight", F.expr(f"weight * {H.CAPACITY} / 3"))
    return H.with_capacity(coded.where("pid % 2 = 1"), nodes).select("pid")


# --- joins ----------------------------------------------------------------------

_AB = E.dist2(("a.x", "a.y", "a.z"), ("b.x", "b.y", "b.z"))


@query(f"SELECT a.pid AS src, b.pid AS dst, {r6(_AB, 'd2')} FROM cloud a, cloud b WHERE a.pid < b.pid AND {_AB} <= {RADIUS ** 2!r}")
def radius_pairs(points, spark, sf_dir):
    return S.radius_pairs(points, RADIUS)


@query(f"SELECT a.pid AS src, count(*) AS near FROM cloud a, cloud b WHERE a.scan_id = 0 AND {_AB} <= {RADIUS ** 2!r} GROUP BY 1")
def radius_probe(points, spark, sf_dir):
    return S.radius_join(points.where("scan_id = 0"), points, RADIUS).groupBy("src").agg(F.count("*").alias("near"))


@query(f"""SELECT src, dst, {r6('d2', 'd2')}, rank FROM (
  SELECT a.pid AS src, b.pid AS dst, {_AB} AS d2,
         CAST(row_number() OVER (PARTITION BY a.pid ORDER BY {_AB}, b.pid) AS INT) AS rank
  FROM cloud a, cloud b WHERE a.pid <> b.pid AND {_AB} <= {RADIUS ** 2!r}) WHERE rank <= 5""")
def exact_knn(points, spark, sf_dir):
    return S.exact_knn(points, points, 5, RADIUS)


def _zorder_sql() -> str:
    parts = []
    for s in range(4):
        code = E.morton(*[f"({E.grid_index(c, ORIGIN, 0.01)} + {5 * s})" for c in "xyz"], 12)
        parts.append(f"SELECT pid, x, y, z, row_number() OVER (ORDER BY {code}, pid) AS rk, {s} AS s FROM cloud")
    return f"""WITH o AS ({' UNION ALL '.join(parts)}),
c AS (SELECT DISTINCT a.pid AS src, b.pid AS dst, {_AB} AS d2 FROM o a JOIN o b
      ON a.s = b.s AND a.rk <> b.rk AND abs(a.rk - b.rk) <= 2 WHERE {_AB} <= 0.04),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS INT) AS rank FROM c)
SELECT src, dst, {r6('d2', 'd2')}, rank FROM r WHERE rank <= 8"""


@query(_zorder_sql())
def zorder_knn(points, spark, sf_dir):
    return S.zorder_knn(points, 8, 0.2, ORIGIN, 0.01, bits=12)


_NN = E.dot(("a.nx", "a.ny", "a.nz"), ("b.nx", "b.ny", "b.nz"))


@query(f"""SELECT src, dst, {r6('d2', 'd2')} FROM (SELECT a.pid AS src, b.pid AS dst, {_AB} AS d2,
  row_number() OVER (PARTITION BY a.pid ORDER BY {_AB}, b.pid) AS k
  FROM cloud a, cloud b WHERE a.pid <> b.pid AND {_AB} <= 0.01 AND {_NN} >= 0.7) WHERE k = 1""")
def nearest_compatible(points, spark, sf_dir):
    return S.nearest_compatible(points, points, 0.2)


@query("SELECT pid FROM cloud a WHERE scan_id = 1 AND NOT EXISTS "
       f"(SELECT 1 FROM cloud b WHERE b.scan_id <> 1 AND {_AB} <= 0.0025)")
def overlap_clean(points, spark, sf_dir):
    return S.without_overlap(points.where("scan_id = 1"), points.where("scan_id <> 1"), 0.05).select("pid")


@query(f"SELECT DISTINCT b.pid FROM cloud a, cloud b WHERE a.scan_id = 2 AND {_AB} <= {RADIUS ** 2!r}")
def set_expansion(points, spark, sf_dir):
    return S.expand_set(points.where("scan_id = 2"), points, RADIUS)


@query(f"""WITH c AS (SELECT DISTINCT {', '.join(f'{g} AS {n}' for g, n in zip(_grid, 'abc'))} FROM cloud)
SELECT count(*) AS links FROM c s, c t WHERE greatest(abs(s.a - t.a), abs(s.b - t.b), abs(s.c - t.c)) = 1""")
def adjacent_cells(points, spark, sf_dir):
    cells = points.selectExpr(*[f"{g} AS {n}" for g, n in zip(_grid, S.CELL)])
    return S.adjacent_cells(cells).agg(F.count("*").alias("links"))


@query(f"""WITH m AS (SELECT a.pid AS src, b.x, b.y, b.z FROM cloud a, cloud b WHERE {_AB} <= {RADIUS ** 2!r})
SELECT src, count(*) AS k, {', '.join(r6(f'avg({c})', f'm{c}') for c in 'xyz')},
{', '.join(r6(f'avg({a} * {b}) - avg({a}) * avg({b})', f'c{a}{b}') for i, a in enumerate('xyz') for b in 'xyz'[i:])}
FROM m GROUP BY src""")
def pca_moments(points, spark, sf_dir):
    near = S.radius_join(points, points, RADIUS).select("src", "dst")
    return H.pca_moments(near.join(points.select(F.col("pid").alias("dst"), "x", "y", "z"), "dst"))


# --- fields and extraction --------------------------------------------------------

ADJ = f"SELECT a.pid AS src, b.pid AS dst FROM cloud a, cloud b WHERE a.pid < b.pid AND {_AB} <= {RADIUS ** 2!r}"


def _classified(rosy: int = 4, posy: int = 4) -> str:
    cols = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in X.FIELDS)
    sql = f"SELECT src, dst, {cols} FROM adj JOIN cloud a ON a.pid = src JOIN cloud b ON b.pid = dst"
    for step in X.classify_steps(SCALE, rosy, posy, "duck"):
        sql = f"SELECT {', '.join(step)} FROM ({sql})"
    return f"adj AS ({ADJ}), cl AS MATERIALIZED ({sql})"


def _edges(points):
    return S.radius_pairs(points, RADIUS).select("src", "dst")


def _compat_steps(rosy: int) -> list[list[str]]:
    return E.compatible_steps(E.vec("a_q"), E.vec("a_n"), E.vec("b_q"), E.vec("b_n"), rosy, ["src", "dst"], "p", "q")


def _rosy_oracle(rosy: int) -> str:
    cols = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in X.FIELDS)
    sql = f"SELECT src, dst, {cols} FROM adj JOIN cloud a ON a.pid = src JOIN cloud b ON b.pid = dst"
    for step in _compat_steps(rosy):
        sql = f"SELECT {', '.join(step)} FROM ({sql})"
    return f"WITH adj AS ({ADJ}) SELECT src, dst, {_pick([f'{n}{c}' for n in 'pq' for c in 'xyz'])} FROM ({sql})"


def _rosy(points, rosy: int) -> DataFrame:
    return lattice.compatible_directions(X.pairs_with_fields(points, RADIUS), rosy)


@query(_rosy_oracle(2))
def rosy2_compat(points, spark, sf_dir):
    return _rosy(points, 2)


@query(_rosy_oracle(4))
def rosy4_compat(points, spark, sf_dir):
    return _rosy(points, 4)


@query(_rosy_oracle(6))
def rosy6_compat(points, spark, sf_dir):
    return _rosy(points, 6)


_round = E.round_position(E.vec("o"), E.vec("q"), E.vec("n"), E.vec(""), SCALE)


@query("SELECT pid, " + ", ".join(r6(t, c) for t, c in zip(_round, "xyz")) + " FROM cloud")
def posy4_round(points, spark, sf_dir):
    return points.selectExpr("pid", *[f"{t} AS {c}" for t, c in zip(_round, "xyz")])


@query(f"WITH {_classified()} SELECT src, dst, du, dv, {r6('error', 'error')} FROM cl")
def posy4_index(points, spark, sf_dir):
    return X.classify_within(points, RADIUS, SCALE).select("src", "dst", "du", "dv", "error")


@query(f"WITH {_classified(6, 6)} SELECT src, dst, du, dv, {r6('error', 'error')} FROM cl")
def posy6_index(points, spark, sf_dir):
    return X.classify_within(points, RADIUS, SCALE, 6, 6).select("src", "dst", "du", "dv", "error")


@query(f"WITH {_classified()} SELECT class, count(*) AS edges FROM cl GROUP BY class")
def edge_classes(points, spark, sf_dir):
    return X.classify_within(points, RADIUS, SCALE).groupBy("class").agg(F.count("*").alias("edges"))


@query(f"WITH {_classified()} SELECT {r6('sum(d_dir)', 'direction', 4)}, {r6('sum(error)', 'position', 4)} FROM cl", 4)
def field_energy(points, spark, sf_dir):
    return X.field_energy(X.classify_within(points, RADIUS, SCALE))


@query(f"WITH k AS ({ADJ}) SELECT src, dst FROM k")
def symmetric_edges(points, spark, sf_dir):
    return X.symmetric(S.radius_join(points, points, RADIUS))


_UNDIRECTED = f"""c AS (SELECT src, dst FROM cl WHERE class = 'collapse'),
e AS (SELECT src AS a, dst AS b FROM c UNION SELECT dst, src FROM c),
reach(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)"""


@query(f"WITH RECURSIVE {_classified()}, {_UNDIRECTED} SELECT node, component FROM comp")
def components(points, spark, sf_dir):
    collapse = X.classify_within(points, RADIUS, SCALE).where("class = 'collapse'")
    return dense_components(collapse, "src", "dst")


_W = f"exp(-9.0 * {E.dist2(E.vec('o'), E.vec(''))} / {SCALE * SCALE!r})"
_NLEN = "nullif(sqrt(" + " + ".join(f"sum(w * n{c}) * sum(w * n{c})" for c in "xyz") + "), 0)"
_CENTRES = f"""m AS (SELECT pid, coalesce(component, pid) AS root, *, {_W} AS w FROM cloud LEFT JOIN comp ON node = pid),
vx AS (SELECT root, count(*) AS members, {', '.join(f'sum(w * o{c}) / sum(w) AS {c}' for c in 'xyz')},
       {', '.join(f'sum(w * n{c}) / {_NLEN} AS n{c}' for c in 'xyz')} FROM m GROUP BY root)"""


def _members(points) -> tuple[DataFrame, DataFrame]:
    """Pairs between vertices, and the points' vertices: components of collapse pairs."""
    return X.collapsed_within(points, RADIUS, SCALE)


@query(f"WITH RECURSIVE {_classified()}, {_UNDIRECTED}, {_CENTRES} SELECT root, members, {_pick(('x', 'y', 'z', 'nx', 'ny', 'nz'))} FROM vx")
def cluster_centroids(points, spark, sf_dir):
    return X.centroids(points, _members(points)[1], SCALE)


@query(f"""WITH RECURSIVE {_classified()}, {_UNDIRECTED}, {_CENTRES}
SELECT root FROM vx, (SELECT least(20.0, avg(members - 1) / 10) AS l FROM vx) WHERE members - 1 <= l""")
def spurious_vertices(points, spark, sf_dir):
    return X.spurious(X.centroids(points, _members(points)[1], SCALE))


_LINKS = """ln AS (SELECT DISTINCT least(s.root, t.root) AS a, greatest(s.root, t.root) AS b FROM cl
  JOIN m s ON s.pid = src JOIN m t ON t.pid = dst WHERE class = 'link' AND s.root <> t.root)"""


@query(f"WITH RECURSIVE {_classified()}, {_UNDIRECTED}, {_CENTRES}, {_LINKS} SELECT a, b FROM ln")
def vertex_links(points, spark, sf_dir):
    return X.vertex_links(*_members(points))


_RING_ANGLE = (lambda b, c, d: f"round(atan2({E.dot(c, d)}, {E.dot(b, d)}), 9)")(
    *E.tangent_frame(("s.nx", "s.ny", "s.nz")), E.sub(("t.x", "t.y", "t.z"), ("s.x", "s.y", "s.z")))
_RINGS = f"""lb AS (SELECT a AS v, b AS w FROM ln UNION ALL SELECT b, a FROM ln),
ring AS (SELECT v, w, CAST(row_number() OVER (PARTITION BY v ORDER BY {_RING_ANGLE} DESC, w) AS INT) AS rank FROM lb
  JOIN vx s ON s.root = v JOIN vx t ON t.root = w)"""


def _ring(points) -> tuple[DataFrame, DataFrame]:
    cl, member = _members(points)
    member = cut(member, "members")
    vertices = X.centroids(points, member, SCALE)
    return X.ring_order(X.vertex_links(cl, member), vertices), vertices


@query(f"WITH RECURSIVE {_classified()}, {_UNDIRECTED}, {_CENTRES}, {_LINKS}, {_RINGS} SELECT v, w, rank FROM ring")
def ring_order(points, spark, sf_dir):
    return _ring(points)[0]


_NEXT = """nx AS (SELECT w AS a, v AS b, coalesce(lead(w) OVER o, first_value(w) OVER o) AS c FROM ring
  WINDOW o AS (PARTITION BY v ORDER BY rank))"""


def _orbit_sql() -> str:
    walks, found = [], []
    for k in range(3, 9):
        names = [f"n{i}" for i in range(k)]
        joins = " ".join(f"JOIN nx n{i} ON n{i}.a = n{i - 1}.b AND n{i}.b = n{i - 1}.c" for i in range(1, k))
        verts = [f"n{i}.a" for i in range(k)]
        distinct = " AND ".join(f"{x} <> {y}" for i, x in enumerate(verts) for y in verts[i + 1:]) or "true"
        least = " AND ".join(f"n0.a < {x}" for x in verts[1:])
        walks.append(f"SELECT {k} AS degree, concat_ws('-', {', '.join(verts)}) AS face FROM nx n0 {joins} "
                     f"WHERE n{k - 1}.b = n0.a AND n{k - 1}.c = n0.b AND {distinct} AND {least}")
        found.append(names)
    return " UNION ALL ".join(walks)


@query(f"WITH RECURSIVE {_classified()}, {_UNDIRECTED}, {_CENTRES}, {_LINKS}, {_RINGS}, {_NEXT} {_orbit_sql()}")
def simple_face_orbits(points, spark, sf_dir):
    faces = X.simple_orbits(cut(_ring(points)[0], "ring"))
    return faces.select("degree", F.array_join(F.transform("verts", lambda v: v.cast("string")), "-").alias("face"))


@query(f"""WITH RECURSIVE {_classified()}, {_UNDIRECTED}, {_CENTRES}, {_LINKS},
lb AS (SELECT a AS v, b AS w FROM ln UNION ALL SELECT b, a FROM ln)
SELECT a, b FROM ln JOIN lb s ON s.v = a JOIN lb t ON t.v = b AND t.w = s.w GROUP BY a, b HAVING count(*) = 2""")
def diagonal_links(points, spark, sf_dir):
    return X.diagonals(cut(X.vertex_links(*_members(points)), "links"))


@query(f"""WITH RECURSIVE {_classified()}, {_UNDIRECTED}, {_CENTRES}, {_LINKS},
used AS (SELECT a AS root FROM ln UNION SELECT b FROM ln), v AS (SELECT vx.root AS pid, x, y, z FROM vx JOIN used USING (root))
SELECT a.pid AS src, b.pid AS dst, {r6(_AB, 'd2')} FROM v a, v b WHERE a.pid < b.pid AND {_AB} <= {(SCALE / 4) ** 2!r}""")
def duplicate_vertices(points, spark, sf_dir):
    cl, member = _members(points)
    member = cut(member, "members")
    return X.duplicate_vertices(X.centroids(points, member, SCALE), X.vertex_links(cl, member), SCALE)


# --- meshes: triangles of a grid over the ids -------------------------------------

# Four face ids for each point, so that they stay apart whatever the number of points;
# the last kind are fins on a diagonal, with a vertex that is no point.
_GRID_FACES = """f AS (SELECT 4 * pid AS fid, [pid, pid + 1, pid + 11] AS verts FROM cloud WHERE pid % 10 < 9
UNION ALL SELECT 4 * pid + 1, [pid, pid + 11, pid + 10] FROM cloud WHERE pid % 10 < 9
UNION ALL SELECT 4 * pid + 2, [pid + 1, pid + 11, pid] FROM cloud WHERE pid % 30 = 0
UNION ALL SELECT 4 * pid + 3, [pid, pid + 11, -1 - pid] FROM cloud WHERE pid % 20 = 5),
fe AS (SELECT fid, verts[k] AS a, verts[k % 3 + 1] AS b FROM f, unnest([1, 2, 3]) AS t(k)),
et AS (SELECT least(a, b) AS v0, greatest(a, b) AS v1, count(DISTINCT fid) AS faces FROM fe GROUP BY ALL)"""
_KINDS = (("pid % 10 < 9", "pid, pid + 1, pid + 11"), ("pid % 10 < 9", "pid, pid + 11, pid + 10"),
          ("pid % 30 = 0", "pid + 1, pid + 11, pid"), ("pid % 20 = 5", "pid, pid + 11, -1 - pid"))


def _faces(points) -> DataFrame:
    found = None
    for k, (where, verts) in enumerate(_KINDS):
        part = points.where(where).selectExpr(f"4 * pid + {k} AS fid", f"array({verts}) AS verts")
        found = part if found is None else found.union(part)
    return found


@query(f"WITH {_GRID_FACES} SELECT v0, v1, faces FROM et WHERE faces > 2")
def nonmanifold_edges(points, spark, sf_dir):
    return X.nonmanifold(X.edge_table(_faces(points)))


@query(f"WITH {_GRID_FACES} SELECT v0, v1, faces FROM et WHERE faces = 1")
def boundary_edges(points, spark, sf_dir):
    return X.boundary(X.edge_table(_faces(points)))


@query(f"""WITH {_GRID_FACES}, k AS (SELECT fid, list_position(verts, list_min(verts)) AS p, verts FROM f)
SELECT concat_ws('-', verts[(p - 1) % 3 + 1], verts[p % 3 + 1], verts[(p + 1) % 3 + 1]) AS key, count(*) AS copies
FROM k GROUP BY 1""")
def duplicate_faces(points, spark, sf_dir):
    return X.duplicate_faces(_faces(points))


@query(f"""WITH {_GRID_FACES}, i AS (SELECT fe.fid, faces FROM fe JOIN et ON v0 = least(a, b) AND v1 = greatest(a, b))
SELECT fid FROM i GROUP BY fid HAVING max(faces) > 2 AND count(*) FILTER (faces = 2) = 0""")
def face_artefacts(points, spark, sf_dir):
    return X.artefacts(_faces(points))


@query(f"""WITH {_GRID_FACES}, dead AS (SELECT DISTINCT pid - pid % 2 AS d FROM cloud WHERE scan_id = 3),
ls AS (SELECT v0, v1 FROM et WHERE v0 NOT IN (SELECT d FROM dead) AND v1 NOT IN (SELECT d FROM dead))
SELECT 'edge' AS kind, v0 AS a, v1 AS b FROM ls
UNION ALL SELECT 'face', fid, -1 FROM f WHERE fid NOT IN (
  SELECT fid FROM fe WHERE NOT EXISTS (SELECT 1 FROM ls WHERE v0 = least(a, b) AND v1 = greatest(a, b)))
UNION ALL SELECT 'vertex', root, -1 FROM (SELECT DISTINCT pid - pid % 2 AS root FROM cloud)
WHERE root NOT IN (SELECT d FROM dead)""")
def delete_cascade(points, spark, sf_dir):
    member = points.select("pid", F.expr("pid - pid % 2").alias("root"))
    faces = _faces(points)
    v, e, f = X.delete_cascade(points, points.where("scan_id = 3"), member, X.edge_table(faces), faces)
    none = F.lit(-1).cast("long").alias("b")
    return (e.select(F.lit("edge").alias("kind"), F.col("v0").alias("a"), F.col("v1").alias("b"))
            .union(f.select(F.lit("face"), "fid", none)).union(v.select(F.lit("vertex"), "root", none)))


@query("""WITH RECURSIVE l AS (SELECT pid AS a, pid + 1 + pid % 3 AS b FROM cloud WHERE pid % 4 <> 0
UNION SELECT pid, pid + 7 FROM cloud WHERE pid % 5 = 0),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
n AS (SELECT a AS v, count(*) AS d FROM e GROUP BY a)
SELECT count(*) AS edges, count(DISTINCT a) AS heads FROM l""")
def link_counts(points, spark, sf_dir):
    links = _chain_links(points)
    return links.agg(F.count("*").alias("edges"), F.countDistinct("a").alias("heads"))


def _chain_links(points) -> DataFrame:
    return (points.where("pid % 4 <> 0").select(F.col("pid").alias("a"), F.expr("pid + 1 + pid % 3").alias("b"))
            .union(points.where("pid % 5 = 0").select("pid", F.expr("pid + 7"))).distinct())


@query()
def pruned_links(points, spark, sf_dir):
    """The part of a graph without leaves; checked against a loop in the tests."""
    return without_leaves(_chain_links(points))


@query(f"""WITH {_GRID_FACES}, v AS (SELECT fid, verts FROM f),
j AS (SELECT fid, i, {', '.join(f'p{k}.{c} AS p{k}{c}' for k in range(3) for c in 'xyz')}, t.pid FROM v
  JOIN cloud p0 ON p0.pid = verts[1] JOIN cloud p1 ON p1.pid = verts[2] JOIN cloud p2 ON p2.pid = verts[3],
  unnest(verts) AS t(pid), unnest([1]) AS u(i)),
n AS (SELECT pid, {', '.join(f'sum({t}) AS c{c}' for c, t in zip('xyz', E.cross(E.sub(E.vec('p1'), E.vec('p0')), E.sub(E.vec('p2'), E.vec('p0')))))}
  FROM j GROUP BY pid)
SELECT pid, {', '.join(r6(t, f'n{c}') for c, t in zip('xyz', E.unit(E.vec('c'))))} FROM n""")
def face_normals(points, spark, sf_dir):
    f = _faces(points).select(*[F.expr(f"verts[{i}]").alias(f"v{i}") for i in range(3)])
    return H.face_normals(f, points)
