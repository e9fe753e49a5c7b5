"""Readers: scan files to (points, faces) DataFrames.

points: scan, pid (position in the file), x, y, z, nx, ny, nz and linear 16-bit
colours r, g, b, null where a file has none; faces: scan, v0, v1, v2. Line-based
formats are read by Spark's text source and parsed by expressions; PLY, OBJ and
caches are whole files, one task each, by the binary source. Nothing is read on the
driver but the small ALN and FRAMES lists.
"""

from __future__ import annotations

import hashlib
import math
import posixpath
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators.hierarchy import transformed
from ..operators.tables import fence
from . import formats

POINTS = "scan string, pid long, x double, y double, z double, nx double, ny double, nz double, r int, g int, b int"
FACES = "scan string, v0 long, v1 long, v2 long"
_MIXED = "kind string, scan string, pid long, x double, y double, z double, nx double, ny double, nz double, u double, v double, r int, g int, b int"


def _frame(kind: str, scan: str, n: int, **cols) -> pd.DataFrame:
    names = [c.split()[0] for c in _MIXED.split(", ")]
    data = {"kind": kind, "scan": scan, "pid": np.arange(n)} | cols
    return pd.DataFrame({c: data.get(c, None) for c in names}, index=range(n))


def _whole_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Points and faces (as rows of kind face: x, y, z are corners)."""
    for pdf in frames:
        for path, data in zip(pdf["path"], pdf["content"]):
            data = bytes(data)
            kind = path.rsplit(".", 1)[-1].lower()
            extra: dict = {}
            if kind == "ply":
                v, faces = formats.parse_ply(data)
                p = np.column_stack([v["x"], v["y"], v["z"]])
                if "nx" in v:
                    extra |= {k: v[k] for k in ("nx", "ny", "nz")}
                if "red" in v:
                    extra |= {k: np.floor(65535 * (v[c] / 255) ** 2.2).astype(int)
                              for k, c in zip("rgb", ("red", "green", "blue"))}
                if "texture_u" in v:
                    extra |= {"u": v["texture_u"], "v": v["texture_v"]}
            elif kind == "obj":
                p, faces = formats.parse_obj(data.decode())
            else:
                p, n, c, faces = formats.parse_cache(data)
                if len(n):
                    extra |= dict(zip(("nx", "ny", "nz"), n.astype(float).T))
                if len(c):
                    extra |= dict(zip("rgb", c.astype(int).T))
            yield _frame("point", path, len(p), x=p[:, 0].astype(float), y=p[:, 1].astype(float),
                         z=p[:, 2].astype(float), **extra)
            if len(faces):
                yield _frame("face", path, len(faces), x=faces[:, 0].astype(float), y=faces[:, 1].astype(float),
                             z=faces[:, 2].astype(float))


def read_whole(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = (spark.read.format("binaryFile").load(path).select("path", "content")
            .mapInPandas(_whole_files, _MIXED))
    points = rows.where("kind = 'point'").drop("kind", "u", "v")
    faces = rows.where("kind = 'face'").select(
        "scan", *[F.col(c).cast("long").alias(f"v{i}") for i, c in enumerate("xyz")])
    return points, faces


def read_texture_points(spark: SparkSession, path: str, pixels: DataFrame) -> DataFrame:
    """PLY points with texture coordinates, coloured from a pixel table (px, py, r, g,
    b in 8 bits) of known size: nearest pixel below, clamped, made linear."""
    size = pixels.agg(F.max("px").alias("w"), F.max("py").alias("h"))
    rows = (spark.read.format("binaryFile").load(path).select("path", "content")
            .mapInPandas(_whole_files, _MIXED).where("kind = 'point' AND u IS NOT NULL"))
    at = (rows.drop("r", "g", "b").join(F.broadcast(size))  # one row
          .withColumn("px", F.expr("CAST(greatest(0, least(w, floor(u * (w + 1)))) AS INT)"))
          .withColumn("py", F.expr("CAST(greatest(0, least(h, floor((1 - v) * (h + 1)))) AS INT)")))
    linear = pixels.select("px", "py", *[F.expr(E.linear_colour(c)).alias(c) for c in "rgb"])
    return at.join(linear, ["px", "py"], "left").select(*[c.split()[0] for c in POINTS.split(", ")])


def read_xyz(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Points, and lines that don't have the numbers of the file's first one: three, or six
    with a normal. What follows on a line is ignored. pid is the line's place in a file
    that one task reads, else unique and in order."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("scan"), F.monotonically_increasing_id().alias("pid"),
                                         F.split(F.trim("value"), r"\s+").alias("w")).where("w[0] <> ''")
    num = lambda i: F.expr(f"try_cast(get(w, {i}) AS DOUBLE)")
    names = ("x", "y", "z", "nx", "ny", "nz")
    parsed = lines.select("scan", "pid", "w", *[num(i).alias(n) for i, n in enumerate(names)])
    plain, full = ("".join(f" AND {c} IS NOT NULL" for c in cols)[5:] for cols in (names[:3], names))
    first = parsed.groupBy("scan").agg(F.min_by(F.expr(full), "pid").alias("full"))
    parsed = parsed.join(F.broadcast(first), "scan")  # one row a file
    good = parsed.where(f"CASE WHEN full THEN {full} ELSE {plain} END")
    bad = parsed.where(f"NOT CASE WHEN full THEN {full} ELSE {plain} END").select("scan", F.array_join("w", " ").alias("line"))
    none = [F.lit(None).cast("int").alias(c) for c in "rgb"]
    return good.select("scan", "pid", "x", "y", "z", *[F.when(F.col("full"), F.col(n)).alias(n) for n in names[3:]], *none), bad


def with_lab(points: DataFrame) -> DataFrame:
    """points with l, a, b of their linear 16-bit r, g, b; null where there is no colour."""
    lab = E.rgb_to_lab(("r", "g", "b"))
    known = "r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL"
    named = points.select(*[c for c in points.columns if c not in "rgb"], *[F.expr(f"CASE WHEN {known} THEN {t} END").alias(f"lab_{n}")
                                                                       for t, n in zip(lab, "lab")], "r", "g", F.col("b").alias("blue"))
    return named


def cached_scan(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """load_scan() by way of a Parquet copy in folder, known by the file's path, time and
    length, so that a changed file is read anew."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = fs.getFileStatus(p)
    key = hashlib.sha1(f"{path} {status.getModificationTime()} {status.getLen()}".encode()).hexdigest()
    at = f"{folder.rstrip('/')}/{key}"
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")):
        load_scan(spark, path).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def _text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def load_scan(spark: SparkSession, path: str, matrix: list[float] | None = None,
              ignore_unknown: bool = False) -> DataFrame | None:
    """Points of a scan file by its extension; ALN and FRAMES load what they list."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("ply", "obj", "cache"):
        out = read_whole(spark, path)[0]
    elif kind in ("xyz", "3d"):
        out = read_xyz(spark, path)[0]
    elif kind == "aln":
        out = None
        for name, m in formats.parse_aln(_text(spark, path)):
            part = load_scan(spark, posixpath.join(posixpath.dirname(path), name), m, ignore_unknown)
            if part is not None:
                out = part if out is None else out.union(part)
    elif kind == "frames":
        m = formats.parse_frames(_text(spark, path))
        out = load_scan(spark, path[:-len("frames")] + "3d", m)
    elif ignore_unknown:
        return None
    else:
        raise ValueError(f"unknown scan format: {path}")
    return transformed(out, matrix) if matrix and out is not None else out


def scan_faces(spark: SparkSession, path: str) -> DataFrame | None:
    """Triangles (v0, v1, v2) of a scan file that may have any, else None."""
    return read_whole(spark, path)[1].select("v0", "v1", "v2") if path.rsplit(".", 1)[-1].lower() in ("ply", "obj", "cache") else None


def load_directory(spark: SparkSession, path: str) -> list[str]:
    """Scan files of a folder, by name; a .3d beside a .frames of the same stem is
    left to the latter."""
    names = sorted(r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
                   .select("path").collect())
    frames = {n.rsplit(".", 1)[0] for n in names if n.endswith(".frames")}
    known = (".ply", ".obj", ".xyz", ".3d", ".aln", ".frames")
    return [n for n in names if n.endswith(known) and not (n.endswith(".3d") and n.rsplit(".", 1)[0] in frames)]


def procedural_scan(spark: SparkSession, segment: int, resolution: int = 50) -> DataFrame:
    """A segment of a twisted square tube; the first one has its ring at x = 0
    replaced by a square cap. Points (pid, x, y, z, nx, ny, nz)."""
    rings = math.floor(1.1 * resolution)
    corner = lambda x, k: (x, f"cos({x} / 3 + {k} * pi() / 2)", f"sin({x} / 3 + {k} * pi() / 2)")
    base = (spark.range(rings * 4 * resolution)
            .selectExpr(f"id div {4 * resolution} AS i", f"(id div {resolution}) % 4 AS j", f"id % {resolution} AS k", "id")
            .selectExpr("id", "i", "j", "k", f"{2 * segment} + i * 2.0e0 / {resolution} AS x0",
                        f"{2 * segment} + (i + 1) * 2.0e0 / {resolution} AS x1", f"k / double({resolution}) AS t"))
    mix = lambda a, b: tuple(f"((1 - t) * {p} + t * {q})" for p, q in zip(a, b))
    here, ahead = mix(corner("x0", "j"), corner("x0", "(j + 1)")), mix(corner("x1", "j"), corner("x1", "(j + 1)"))
    start = tuple(f"(CASE WHEN k = 0 THEN {a} ELSE {b} END)" for a, b in zip(corner("x0", "(j - 1)"), corner("x0", "j")))
    side = E.sub(corner("x0", "(j + 1)"), start)
    n = E.cross(side, E.sub(ahead, here))
    tube = fence(base.where("x0 <> 0").selectExpr("id AS pid", *[f"{t} AS {c}" for t, c in zip(here, "xyz")],
                                                   *[f"{t} AS m{c}" for t, c in zip(n, "xyz")]))
    tube = tube.selectExpr("pid", "x", "y", "z", *[f"{t} AS n{c}" for t, c in zip(E.unit(E.vec("m")), "xyz")])
    if segment:
        return tube
    m = resolution + 1
    cap = (spark.range(m * m).selectExpr("id", f"(id div {m}) / double({resolution}) AS a", f"(id % {m}) / double({resolution}) AS b")
           .selectExpr(f"id + {10 ** 9} AS pid", "0.0e0 AS x", "(1 - a) * (1 - b) - a * b AS y", "(1 - a) * b - a * (1 - b) AS z",
                       "-1.0e0 AS nx", "0.0e0 AS ny", "0.0e0 AS nz"))
    return cap.union(tube)
