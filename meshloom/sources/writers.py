"""Writers of meshes: PLY and OBJ files for other programs. Vertices are numbered and lines
made by all tasks, sorted into parts, and the parts are joined to one file by a copy that
holds a few MB at a time."""

from __future__ import annotations

import shutil
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.extract import dense_ids
from ..operators.graph import delete_path
from ..operators.tables import cut, shared_dir


def _lines(vertices: DataFrame, faces: DataFrame, vertex: str, face: str) -> DataFrame:
    """(part, id, line): vertices in order of root, numbered from 0, then faces by fid.
    vertex: an expression over x..nz; face: one over n and ids, the corners' numbers."""
    v = cut(dense_ids(vertices.select("root", "x", "y", "z", "nx", "ny", "nz"), ("root",), "number"), "numbered")
    corner = faces.select("fid", F.posexplode("verts").alias("k", "root")).join(v.select("root", "number"), "root")
    listed = corner.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("k", "number"))).alias("c")).selectExpr(
        "fid AS id", "size(c) AS n", "transform(c, x -> x.number) AS ids")
    return v.selectExpr("0 AS part", "number AS id", f"{vertex} AS line").union(listed.selectExpr("1 AS part", "id", f"{face} AS line"))


def _write(lines: DataFrame, path: str, head) -> None:
    spark = lines.sparkSession
    lines = cut(lines, "lines")
    n = {r["part"]: r["count"] for r in lines.groupBy("part").count().collect()}
    folder = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    lines.repartitionByRange("part", "id").sortWithinPartitions("part", "id").select("line").write.text(folder)
    source, at = pafs.FileSystem.from_uri(folder)
    target, inner = pafs.FileSystem.from_uri(path)
    temp = f"{inner}.{uuid.uuid4().hex}"
    names = sorted(f.path for f in source.get_file_info(pafs.FileSelector(at)) if f.base_name.startswith("part-"))
    with target.open_output_stream(temp) as out:
        out.write(head(n.get(0, 0), n.get(1, 0)).encode())
        for name in names:
            with source.open_input_stream(name) as part:
                shutil.copyfileobj(part, out, 4 << 20)
    target.move(temp, inner)
    delete_path(spark, folder)


def write_ply(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """An ascii PLY file of vertices (root, x...nz) and faces (fid, verts)."""
    def head(v, f):
        props = "".join(f"property float {p}\n" for p in ("x", "y", "z", "nx", "ny", "nz"))
        return (f"ply\nformat ascii 1.0\nelement vertex {v}\n{props}element face {f}\n"
                "property list uchar int vertex_indices\nend_header\n")

    _write(_lines(vertices, faces, "concat_ws(' ', x, y, z, nx, ny, nz)", "concat_ws(' ', n, array_join(transform(ids, x -> string(x)), ' '))"),
           path, head)


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """An OBJ file with normals; it counts from 1."""
    _write(_lines(vertices, faces, "concat('v ', concat_ws(' ', x, y, z), '\\nvn ', concat_ws(' ', nx, ny, nz))",
                  "concat('f ', array_join(transform(ids, x -> concat(x + 1, '//', x + 1)), ' '))"),
           path, lambda v, f: f"# {v} vertices, {f} faces\n")
