"""Registered queries against DuckDB, and operators against brute force."""

import os

import duckdb
import pytest

from meshloom.plans import registry
from meshloom.streaming import Session

SF = "/root/testdata/sf0.001"
#: One of each kind; the driver runs them all.
SAMPLE = ("cloud_transform", "rgb_lab", "morton_codes", "level_rollup", "incremental_merge", "radius_pairs", "exact_knn",
          "nearest_compatible", "overlap_clean", "rosy6_compat", "posy4_index", "nonmanifold_edges", "delete_cascade",
          "quad_tessellation", "texel_numbers", "laplacian_rows", "zorder_knn")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def _plain(rows):
    def v(x):
        return None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else x

    return sorted(str(tuple(v(x) for x in r)) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = _plain(map(tuple, df.select(*cols).collect()))
    want = duck.sql(f"SELECT {', '.join(cols)} FROM ({registry.ORACLES[name]})").fetchall()
    assert got == _plain(want)


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0


def test_pruned_links_match_a_loop(spark):
    from meshloom.operators.tables import cloud
    from meshloom.plans import cloud_queries as C

    links = {tuple(r) for r in C._chain_links(cloud(spark, SF)).collect()}
    while True:
        deg = {}
        for a, b in links:
            deg[a] = deg.get(a, 0) + 1
            deg[b] = deg.get(b, 0) + 1
        rest = {(a, b) for a, b in links if deg[a] > 1 and deg[b] > 1}
        if rest == links:
            break
        links = rest
    assert {tuple(r) for r in registry.QUERIES["pruned_links"](spark, SF).collect()} == links


def test_insert_then_delete_restores_nodes(spark, tmp_path):
    from meshloom.operators.tables import cloud

    p = cloud(spark, SF).select("pid", "x", "y", "z", "nx", "ny", "nz")
    s = Session(spark, f"file://{tmp_path}/s", -1.0, 0.08, 3)
    seen = []
    s.listeners.append(lambda event, v: seen.append(event))
    s.integrate(p.where("pid < 300"))
    before = _plain(map(tuple, s.nodes().selectExpr("level", "cell", "round(weight, 6)", "round(sx, 6) + 0.0").collect()))
    s.integrate(p.where("pid >= 300"))
    s.change(deletes=p.where("pid >= 300"))
    after = _plain(map(tuple, s.nodes().selectExpr("level", "cell", "round(weight, 6)", "round(sx, 6) + 0.0").collect()))
    assert before == after and seen == ["scan", "scan", "edit"]
    assert s.undo() == 2 and s.points().count() == p.count()


def test_icp_recovers_a_motion(spark):
    import numpy as np

    row = registry.QUERIES["icp"](spark, SF).first()
    from meshloom.operators import kernels, register

    want = np.linalg.inv(np.array(register.matrix(kernels.small_rotation(np.array([0.01, 0.02, -0.01])), [0.02, -0.01, 0.015])).reshape(4, 4))
    assert np.abs(np.array(row).reshape(4, 4) - want).max() < 0.02


def test_session_replays_removes_and_folds(spark, tmp_path):
    from meshloom.operators.tables import cloud

    p = cloud(spark, SF).select("pid", "x", "y", "z", "nx", "ny", "nz")
    s = Session(spark, f"file://{tmp_path}/s", -1.0, 0.08, 3)
    ids = lambda x: sorted(r.pid for r in x.points().select("pid").collect())
    assert s.integrate(p.where("pid < 5"), batch="a/0") == 1 and s.integrate(p.where("pid < 5"), batch="a/0") == 1
    assert s.integrate(p.where("pid < 9"), batch="a/1") == 2 and ids(s) == list(range(9))  # known ids are left out
    assert [r.new_points for r in s.statistics().orderBy("version").collect()] == [5, 4]
    s.change(updates=p.where("pid = 3").selectExpr("pid", "x + 9 AS x", "y", "z", "nx", "ny", "nz"))
    assert s.points().where("pid = 3").first().version == 3 and ids(s) == list(range(9))
    far = s.points().where("pid = 3").first()
    s.delete_sphere((far.x, far.y, far.z), 0.5)
    assert ids(s) == [0, 1, 2, 4, 5, 6, 7, 8]
    s.remove_scan(2)
    assert ids(s) == [0, 1, 2, 4]
    nodes = lambda x: _plain(map(tuple, x.nodes().selectExpr("level", "cell", "round(weight, 6)", "round(sx, 6) + 0.0").collect()))
    before, v = nodes(s), s.compact()
    assert nodes(s) == before and ids(s) == [0, 1, 2, 4] and s.versions() == [v]
    s.save(f"file://{tmp_path}/t")
    t = Session.load(spark, f"file://{tmp_path}/t")
    assert ids(t) == [0, 1, 2, 4] and (t.origin, t.cell, t.levels) == (-1.0, 0.08, 3) and nodes(t) == before
    s.undo()
    assert s.versions() == [1, 2, 3, 4, 5] and nodes(s) == before


def test_stream_skips_a_batch_that_comes_again(spark, tmp_path):
    from meshloom.operators.tables import cloud
    from meshloom.streaming import integrate_stream

    p = cloud(spark, SF).select("pid", "x", "y", "z", "nx", "ny", "nz").where("pid < 60")
    p.where("pid < 30").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = Session(spark, f"file://{tmp_path}/s", -1.0, 0.08, 3)
    for k in range(2):
        stream = spark.readStream.schema(p.schema).parquet(f"{tmp_path}/in")
        integrate_stream(stream, s, f"{tmp_path}/check{k}").awaitTermination()  # a lost checkpoint delivers batch 0 again
    assert s.points().count() == 30 and s.versions() == [1]


def test_incremental_solve_keeps_what_is_far(spark, tmp_path):
    from meshloom.operators.normals import with_normals
    from meshloom.sources import procedural_scan

    p = with_normals(procedural_scan(spark, 0, 10))
    s = Session(spark, f"file://{tmp_path}/s", -4.0, 0.3, 3)
    s.integrate(p.where("x < 1.2"))
    s.solve(0.3)
    first = {r.pid: r for r in s.fields().collect()}
    s.integrate(p.where("x >= 1.2"))
    s.solve(0.3)
    second = {r.pid: r for r in s.fields().collect()}
    assert set(second) == {r.pid for r in s.points().collect()} and set(first) < set(second)
    kept = [i for i, r in first.items() if r.x < 0.1]
    assert kept and sum(second[i] == first[i] for i in kept) > 0.5 * len(kept)
    for r in second.values():
        assert abs(r.qx * r.nx + r.qy * r.ny + r.qz * r.nz) < 1e-6 and abs(r.qx ** 2 + r.qy ** 2 + r.qz ** 2 - 1) < 1e-6
    last = [f for f in s.facts() if f["event"] == "solved"][-1]
    assert last["solved"] == s.points().where("version = 3").count()


def test_batch_job_writes_a_fine_mesh(spark, tmp_path):
    from meshloom import batch
    from meshloom.sources import load_scan, procedural_scan
    from meshloom.sources.readers import scan_faces

    procedural_scan(spark, 0, 16).selectExpr("concat_ws(' ', x, y, z, nx, ny, nz) AS value").coalesce(1).write.text(f"{tmp_path}/scan.xyz")
    out = f"file://{tmp_path}/out.ply"
    done = batch.run(spark, f"file://{tmp_path}/scan.xyz", out, 4, 2.0, tri=True)
    vertices, faces = load_scan(spark, out), scan_faces(spark, out)
    assert vertices.count() == done["fine_vertices"] > done["vertices"] and faces.count() == done["fine_faces"] > 0
    assert faces.where(f"least(v0, v1, v2) < 0 OR greatest(v0, v1, v2) >= {done['fine_vertices']}").isEmpty()
    worst = vertices.selectExpr("max(greatest(abs(y), abs(z)))", "min(x)", "max(x)").first()
    assert worst[0] < 1.6 and -0.6 < worst[1] and worst[2] < 2.8
    a = batch.arguments(["-i", "a.ply", "-o", "b.ply", "--sym", "6", "--scale", "1.5", "--smooth", "0.5", "--tri"])
    assert (a.i, a.o, a.sym, a.scale, a.smooth, a.tri) == ("a.ply", "b.ply", 6, 1.5, 0.5, True)
    for bad in (["--sym", "5"], ["--scale", "0"], ["--smooth", "1"]):
        with pytest.raises(SystemExit):
            batch.arguments(["-i", "a", "-o", "b", *bad])


def test_readers(spark, tmp_path):
    from meshloom.sources import load_directory, load_scan, procedural_scan
    from meshloom.sources.readers import read_xyz

    (tmp_path / "a.xyz").write_text("0 0 0 0 0 1\n1 0 0 0 0 1 7\nbad line\n")
    (tmp_path / "b.3d").write_text("1 2 3\n")
    (tmp_path / "b.frames").write_text("1 0 0 0 0 1 0 0 0 0 1 0 5 0 0 1")
    (tmp_path / "c.aln").write_text("1\na.xyz\n1 0 0 1 0 1 0 0 0 0 1 0 0 0 0 1\n")
    base = f"file://{tmp_path}"
    points, bad = read_xyz(spark, f"{base}/a.xyz")
    assert points.count() == 2 and bad.count() == 1
    assert load_scan(spark, f"{base}/b.frames").first()["x"] == 6
    assert sorted(r["x"] for r in load_scan(spark, f"{base}/c.aln").collect()) == [1, 2]
    assert [n.rsplit("/")[-1] for n in load_directory(spark, base)] == ["a.xyz", "b.frames", "c.aln"]
    with pytest.raises(ValueError):
        load_scan(spark, f"{base}/d.foo")
    assert procedural_scan(spark, 0).count() == 13401 and procedural_scan(spark, 1).count() == 11000


def test_io_roundtrip_takes_every_point(spark):
    from meshloom.operators.tables import cloud

    want = cloud(spark, SF).count()
    assert want > 100 and registry.QUERIES["io_roundtrip"](spark, SF).count() == want


def _grid_mesh():
    """A quad and a triangle that share an edge: (fid, verts), vertices by id."""
    faces = [(1, [0, 1, 2, 3]), (2, [1, 4, 2])]
    at = {0: (0, 0, 0), 1: (1, 0, 0), 2: (1, 1, 0), 3: (0, 1, 0), 4: (2, 0.5, 0)}
    return faces, [(i, *map(float, p), 0.0, 0.0, 1.0) for i, p in at.items()]


def test_texels_of_a_mesh_are_shared_and_solved(spark):
    import numpy as np

    from meshloom.operators import texels as T
    from meshloom.operators.tables import cut

    f, v = _grid_mesh()
    faces = spark.createDataFrame(f, "fid long, verts array<long>")
    vertices = spark.createDataFrame(v, "root long, x double, y double, z double, nx double, ny double, nz double")
    grid = cut(T.numbered_mesh(vertices, faces), "grid")
    rows = grid.collect()
    assert len(rows) == 121 + 66 and {r.texel for r in rows} == set(range(5 + 9 * 6 + 81 + 36))
    fine, small = T.fine_mesh(vertices, faces, grid)
    at = {r.root: (r.x, r.y) for r in fine.collect()}
    by_place = {}
    for r in rows:  # one texel, one place, from whichever face
        p = (r.i / 10, r.j / 10) if r.fid == 1 else (1 + r.i / 10, r.i / 20 + r.j / 10)
        assert np.allclose(at[r.texel], p) and by_place.setdefault(r.texel, tuple(np.round(p, 9))) == tuple(np.round(p, 9))
    assert small.count() == 100 + 100 and T.fine_mesh(vertices, faces, grid, triangles=True)[1].count() == 200 + 100
    pairs = {(r.t, r.s) for r in T.texel_neighbours(grid, faces).collect()}
    step = lambda a, b: np.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1])
    assert all(step(a, b) < 0.16 for a, b in pairs)
    for a in at:  # every inner texel of the quad has four neighbours, of the triangle six
        if 0.05 < at[a][0] < 0.95 and 0.05 < at[a][1] < 0.95:
            assert sum(a in p for p in pairs) == 4
    # The detail map of a plane z = 0.1 + 0.05 x over it, against a dense solution.
    rng = np.random.default_rng(3)
    pts = [(i, float(x), float(y), 0.1 + 0.05 * float(x), 0.0, 0.0, 1.0) for i, (x, y) in enumerate(rng.random((400, 2)))]
    points = spark.createDataFrame(pts, "pid long, x double, y double, z double, nx double, ny double, nz double")
    member = points.selectExpr("pid", "CAST(pid % 4 AS BIGINT) AS root")
    got = {r.texel: r.h for r in T.map_attributes(points, member, vertices, faces, grid, 1.0, smoothness=0.01, tolerance=1e-5, block=90).collect()}
    inside = [a for a in at if 0.15 < at[a][0] < 0.85 and 0.15 < at[a][1] < 0.85]
    assert max(abs(got[a] - (0.1 + 0.05 * at[a][0])) for a in inside) < 2e-3


def test_solver_keeps_entries_between_blocks_and_boundary_values(spark):
    import numpy as np

    from meshloom.operators import texels as T
    from meshloom.operators.tables import cut

    rng = np.random.default_rng(8)
    n = 60
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, n, (150, 2)) if a != b} | {(i, i + 1) for i in range(n - 1)})
    data = [(k, int(rng.integers(0, n)), 1.0, float(rng.random()), float(rng.random())) for k in range(25)]
    fixed = [(3, 0.5, 1.5), (40, -1.0, 2.0)]
    lap = T.laplacian(spark.createDataFrame(pairs, "t long, s long"))
    obs = spark.createDataFrame(data, "obs long, col long, w double, x double, y double")
    m, rhs = T.normal_equations(lap, obs, ("x", "y"), fixed=spark.createDataFrame(fixed, "row long, x double, y double"))
    blocks = m.select("row").distinct().selectExpr("row", "row div 25 AS block")
    m, rhs = cut(m, "system"), cut(rhs, "right")
    got = {r.row: (r.x, r.y) for r in T.solve(m, rhs, blocks, ("x", "y"), 1e-8).collect()}
    L = np.zeros((n, n))
    for a, b in pairs:
        L[a, b] = L[b, a] = -1
    L = np.eye(n) + L / -L.sum(1, keepdims=True)
    D = np.zeros((len(data), n))
    for k, (_, c, w, *_r) in enumerate(data):
        D[k, c] = w
    A, rhs2 = 0.8 * L.T @ L + 0.2 * D.T @ D, 0.2 * D.T @ np.array([d[3:] for d in data])
    known = np.array([f[0] for f in fixed])
    free = np.setdiff1d(np.arange(n), known)
    want = np.linalg.solve(A[np.ix_(free, free)], rhs2[free] - A[np.ix_(free, known)] @ np.array([f[1:] for f in fixed]))
    assert set(got) == set(free.tolist()) and np.abs(np.array([got[i] for i in free]) - want).max() < 1e-5
    start = {r.row: r.x for r in T.first_guess(m, rhs, ("x",)).collect()}
    assert set(start) == set(got) and sum(v != 0 for v in start.values()) == len(start)


@pytest.mark.parametrize("small", [0, 20_000])
def test_components_of_odd_graphs(spark, monkeypatch, small):
    from meshloom.operators import graph

    monkeypatch.setattr(graph, "SMALL", small)
    chain = [(i, i + 1) for i in range(60)] + [(500, j) for j in range(200, 260)] + [(100, 101), (101, 100), (7, 7), (None, 3), (-5, -9)]
    got = {tuple(r) for r in graph.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == ({(i, 0) for i in range(61)} | {(i, 200) for i in [500, *range(200, 260)]} | {(100, 100), (101, 100), (-5, -9), (-9, -9)})
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("small", [0, 20_000])
def test_colouring_is_greedy_in_its_order(spark, monkeypatch, small):
    from meshloom.operators import graph

    monkeypatch.setattr(graph, "SMALL", small)
    edges = [(i, (i * 7 + 3) % 50) for i in range(50)] + [(0, j) for j in range(1, 40)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.colour for r in graph.colouring(df, spark.range(52).withColumnRenamed("id", "node")).collect()}
    order = [r.id for r in spark.range(52).selectExpr("id", "xxhash64(id) AS h").orderBy("h").collect()]
    near = {i: set() for i in range(52)}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for i in order:
        used = {want[j] for j in near[i] if j in want}
        want[i] = next(c for c in range(60) if c not in used)
    assert got == want
    counts = {r.colour: (r.nodes, r.neighbours) for r in graph.colour_counts(spark.createDataFrame(got.items(), "node long, colour int"),
                                                                             df.where("a <> b")).collect()}
    assert sum(n for n, _ in counts.values()) == 52 and sum(k for _, k in counts.values()) == 2 * sum(a != b for a, b in edges)


def test_artefacts_go_one_by_one(spark):
    from meshloom.operators import extract as X

    # Two triangles on an edge, and three fins on it: each fin goes, as the edge keeps two.
    f = [(1, [0, 1, 2]), (2, [1, 0, 3]), (7, [0, 1, 10]), (8, [0, 1, 11]), (9, [0, 1, 12]), (3, [1, 4, 2]), (4, [0, 3, 5])]
    left = X.without_artefacts(spark.createDataFrame(f, "fid long, verts array<long>"))
    assert {r.fid for r in left.collect()} == {1, 2, 3, 4}
    assert X.nonmanifold(X.edge_table(left)).isEmpty()


def test_normals_policy(spark):
    import numpy as np

    from meshloom.operators.normals import by_neighbourhood, with_normals

    rng = np.random.default_rng(1)
    cols = "pid long, x double, y double, z double, nx double, ny double, nz double"
    flat = [(i, float(a), float(b), 2.0 + 0.1 * float(a), None, None, None) for i, (a, b) in enumerate(rng.random((80, 2)))]
    points = spark.createDataFrame(flat, cols)
    got = with_normals(points).collect()
    want = np.array([0.1, 0, -1]) / np.sqrt(1.01)
    assert len(got) == 80 and all(np.allclose((r.nx, r.ny, r.nz), want, atol=1e-6) for r in got)
    p = np.array([[r[1], r[2], r[3]] for r in flat])
    bent = p + np.column_stack([np.zeros(80), np.zeros(80), 0.3 * p[:, 1] ** 2])
    got = {r.pid: np.array([r.nx, r.ny, r.nz]) for r in by_neighbourhood(spark.createDataFrame(
        [(i, *map(float, q), None, None, None) for i, q in enumerate(bent)], cols)).collect()}
    for i, q in enumerate(bent):
        near = bent[np.argsort(((bent - q) ** 2).sum(1), kind="stable")[:20]]
        n = np.linalg.eigh(np.cov(near.T))[1][:, 0]
        assert np.allclose(got[i], n * (-1 if n @ q > 0 else 1), atol=1e-5)
    faces = spark.createDataFrame([(0, 1, 2)], "v0 long, v1 long, v2 long")
    three = spark.createDataFrame([(0, 0.0, 0.0, 0.0, None, None, None), (1, 1.0, 0.0, 0.0, None, None, None), (2, 0.0, 1.0, 0.0, None, None, None)], cols)
    assert {(r.nx, r.ny, r.nz) for r in with_normals(three, faces).collect()} == {(0, 0, 1)}
    given = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 0.0, 4.0), (1, 1.0, 0.0, 0.0, None, None, None)], cols)
    assert [(r.nx, r.nz) for r in with_normals(given, faces).orderBy("pid").collect()] == [(0, 1), (None, None)]


def test_first_line_decides_the_columns(spark, tmp_path):
    from meshloom.sources.readers import read_xyz

    (tmp_path / "six.xyz").write_text("0 0 0 0 0 1\n1 2 3\n\n4 5 6 0 1 0 9\n")
    (tmp_path / "three.xyz").write_text("0 0 0\n4 5 6 0 1 0\nx y z\n")
    points, bad = read_xyz(spark, f"file://{tmp_path}/six.xyz")
    assert sorted((r.x, r.ny) for r in points.collect()) == [(0, 0), (4, 1)] and [r.line for r in bad.collect()] == ["1 2 3"]
    points, bad = read_xyz(spark, f"file://{tmp_path}/three.xyz")
    assert sorted((r.x, r.ny) for r in points.collect()) == [(0, None), (4, None)] and [r.line for r in bad.collect()] == ["x y z"]


def test_cache_follows_the_file_and_colours_become_lab(spark, tmp_path):
    import os

    from meshloom.sources.readers import cached_scan, read_whole, with_lab

    head = "ply\nformat ascii 1.0\nelement vertex {}\n" + "".join(f"property float {c}\n" for c in "xyz") + "".join(
        f"property uchar {c}\n" for c in ("red", "green", "blue")) + "end_header\n"
    f = tmp_path / "a.ply"
    f.write_text(head.format(2) + "0 0 0 255 255 255\n1 0 0 0 0 0\n")
    path, folder = f"file://{f}", f"file://{tmp_path}/cache"
    assert cached_scan(spark, path, folder).count() == 2 and cached_scan(spark, path, folder).count() == 2
    assert len(os.listdir(tmp_path / "cache")) == 1
    f.write_text(head.format(1) + "5 0 0 255 0 0\n")
    os.utime(f, (1, 1))
    assert [r.x for r in cached_scan(spark, path, folder).collect()] == [5]
    lab = with_lab(read_whole(spark, path)[0]).first()
    assert (lab.r, lab.g, lab.blue) == (65535, 0, 0) and abs(lab.lab_l / 655.35 - 53.2) < 0.2
    assert abs((lab.lab_a - 32768) / 327.67 - 80.1) < 0.5 and abs((lab.lab_b - 32768) / 327.67 - 67.2) < 0.5


def test_obj_round_trip(spark, tmp_path):
    from meshloom.sources import load_scan, write_obj
    from meshloom.sources.readers import scan_faces

    faces, at = _grid_mesh()
    v = spark.createDataFrame([(10 * i, x, y, z + 1e-7 * i, *n) for i, x, y, z, *n in at], "root long, x double, y double, z double, nx double, ny double, nz double")
    f = spark.createDataFrame([(i, [10 * x for x in verts]) for i, verts in faces], "fid long, verts array<long>")
    write_obj(v, f, f"file://{tmp_path}/m.obj")
    assert sorted((r.pid, r.x, r.y, r.z) for r in load_scan(spark, f"file://{tmp_path}/m.obj").collect()) == [
        (k, x, y, z + 1e-7 * i) for k, (i, x, y, z, *_) in enumerate(at)]
    assert sorted(tuple(r) for r in scan_faces(spark, f"file://{tmp_path}/m.obj").collect()) == [(0, 1, 2), (1, 4, 2), (3, 0, 2)]


def test_brush_leaves_what_is_outside(spark):
    from meshloom.operators import texels as T
    from meshloom.operators.tables import cloud

    p = cloud(spark, SF).select("pid", "x", "y", "z", "nx", "ny", "nz")
    whole = {r.pid: (r.x, r.y, r.z) for r in T.smooth_points(p, 0.1, 0.5).collect()}
    part = {r.pid: (r.x, r.y, r.z) for r in T.smooth_points(p, 0.1, 0.5, brush=((0, 0, 0), 0.12)).collect()}
    for r in p.collect():
        inside = r.x ** 2 + r.y ** 2 + r.z ** 2 <= 0.12 ** 2
        assert part[r.pid] == (whole[r.pid] if inside else (r.x, r.y, r.z))


def test_registration_of_picked_and_matched_points(spark):
    import numpy as np

    from meshloom.operators import hierarchy as H
    from meshloom.operators import kernels, register, texels

    rng = np.random.default_rng(2)
    p = rng.random((30, 3))
    m = np.array(register.matrix(kernels.small_rotation(np.array([0.3, -0.2, 0.1])), [1, 2, 3])).reshape(4, 4)
    q = p @ m[:3, :3].T + m[:3, 3]
    assert np.allclose(register.from_pairs(p[:4].tolist(), q[:4].tolist()), m.ravel())
    assert np.allclose(np.array(register.manual(p[0], q[0])).reshape(4, 4)[:3, 3], q[0] - p[0])
    pairs = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(p, q)], "x double, y double, z double, tx double, ty double, tz double")
    assert np.allclose(register.point_step(pairs), m.ravel(), atol=1e-9)
    ring = np.array([[np.cos(a), np.sin(a), 0.1 * np.cos(a)] for a in np.linspace(0, 2 * np.pi, 40, endpoint=False)])
    inner = rng.random((20, 2)) - 0.5
    got, shade = texels.fill_hole(ring, np.column_stack([inner, 0.1 * inner[:, 0]]), np.tile([100.0, 200, 300], (40, 1)))
    assert np.abs(got[:, 2] - 0.1 * got[:, 0]).max() < 1e-6 and np.allclose(shade, [100, 200, 300], atol=1)
    assert H.grid_plan(spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 8.0, 4.0, 2.0)], "pid long, x double, y double, z double"))["levels"] >= 2


def test_faces_of_orbits_are_those_of_the_whole_graph(spark):
    import numpy as np

    from meshloom.operators import extract as X
    from meshloom.operators import kernels

    rng = np.random.default_rng(12)
    p = rng.random((120, 2))
    links = {tuple(sorted((i, int(j)))) for i in range(120) for j in np.argsort(((p - p[i]) ** 2).sum(1))[1:4]}
    near = {i: sorted({b if a == i else a for a, b in links if i in (a, b)},
                      key=lambda w: -np.arctan2(*(p[w] - p[i])[::-1])) for i in range(120)}  # noqa: B023
    ring = spark.createDataFrame([(v, w, k + 1) for v, r in near.items() for k, w in enumerate(r)], "v long, w long, rank int")

    def key(f):
        k = f.index(min(f))
        return tuple(f[k:] + f[:k])

    for quads in (True, False):
        got = [key(list(r.verts)) for r in X.trace_faces(ring, quads).collect()]
        want = [key(f) for f in kernels.trace(near, quads)]
        assert len(got) == len(set(got)) and set(want) <= set(got) and len(got) - len(want) <= 2
        darts = [(a, b) for f in got for a, b in zip(f, f[1:] + f[:1])]
        assert len(darts) == len(set(darts))


def test_constraints_turn_directions_and_the_root_has_no_neighbours(spark):
    import numpy as np

    from meshloom.operators import solver

    rng = np.random.default_rng(5)
    flat = [(i, float(a), float(b), 0.0, 0.0, 0.0, 1.0) for i, (a, b) in enumerate(rng.random((60, 2)))]
    p = solver.start_fields(spark.createDataFrame(flat, "pid long, x double, y double, z double, nx double, ny double, nz double"))
    adj = solver.neighbours(p, 0.3)
    assert adj.count() > 60 and solver.neighbours(p, 0.3, 2, 2).isEmpty()
    angle = np.pi / 6
    wish = spark.createDataFrame([(i, float(np.cos(angle)), float(np.sin(angle)), 0.0) for i in range(60)], "pid long, cx double, cy double, cz double")
    for given, want in ((None, 0.0), (wish, angle)):
        out = solver.smooth_level(p, adj, "'one'", 0.1, constraint=given).collect()
        turns = [(np.arctan2(r.qy, r.qx) - want + np.pi / 4) % (np.pi / 2) - np.pi / 4 for r in out]
        assert np.abs(turns).max() < 1e-6


def test_calibration_and_turntable(spark):
    import numpy as np

    from meshloom.operators import hierarchy as H
    from meshloom.operators import kernels, register
    from meshloom.sources import procedural_scan

    tube = procedural_scan(spark, 0, 12)
    m = register.matrix(kernels.small_rotation(np.array([0.2, 0.1, 0.3])), [0.5, 0.2, -0.4])
    moved = H.transformed(tube, m)
    at = {r.pid: r for r in tube.where("pid in (100, 200, 300, 410)").collect()}
    source = [r for r in moved.where("pid in (100, 200, 300, 410)").orderBy("pid").collect()]
    picked = [[r.x + 0.02 * (-1) ** k, r.y, r.z] for k, r in enumerate(source)]  # clicks are not exact
    got = register.calibrate(moved, tube, picked, [[at[r.pid].x, at[r.pid].y, at[r.pid].z] for r in source], 0.3, rounds=2, steps=4, share=1)
    assert np.abs(np.array(got).reshape(4, 4) @ np.array(m).reshape(4, 4) - np.eye(4)).max() < 0.01
    axis, point = np.array([0.0, 0.6, 0.8]), np.array([1.0, 2.0, 3.0])
    poses = []
    for a in (0.0, 0.4, 1.1, 2.0):
        r = kernels.small_rotation(axis * a)
        poses.append(register.matrix(r, point - r @ point))
    got_axis, got_point = map(np.array, register.turntable(poses))
    assert np.allclose(np.abs(got_axis @ axis), 1) and np.allclose(np.cross(got_point - point, axis), 0, atol=1e-9)


def test_textures_colour_points(spark, tmp_path):
    from meshloom.sources.readers import read_texture_points

    head = "ply\nformat ascii 1.0\nelement vertex 3\n" + "".join(f"property float {c}\n" for c in ("x", "y", "z", "texture_u", "texture_v")) + "end_header\n"
    (tmp_path / "t.ply").write_text(head + "0 0 0 0 0\n1 0 0 0.99 0.99\n2 0 0 1.5 -1\n")
    pixels = spark.createDataFrame([(x, y, 255 * (x == 0), 255 * (y == 0), 0) for x in range(4) for y in range(2)], "px int, py int, r int, g int, b int")
    got = sorted((r.x, r.r, r.g) for r in read_texture_points(spark, f"file://{tmp_path}/t.ply", pixels).collect())
    assert got == [(0, 65535, 0), (1, 0, 65535), (2, 0, 0)]


def test_stages_of_the_extraction_are_seen(spark):
    from meshloom.operators import remesh
    from meshloom.operators.normals import with_normals
    from meshloom.sources import procedural_scan

    solved = remesh.fields(with_normals(procedural_scan(spark, 0, 12)), 0.8)
    seen = {}
    mesh = remesh.extract(solved, 0.8, on_stage=lambda name, table: seen.setdefault(name, table.count()))
    assert list(seen) == ["neighbours", "classified", "members", "collapsed", "polygons", "mesh"] and seen["mesh"] == mesh.faces.count() > 0
    assert seen["neighbours"] == seen["classified"] and seen["members"] == solved.count()
