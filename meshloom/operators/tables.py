"""Lineage cuts for iterative jobs, and the point-cloud views of plain tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and all runs in
    one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="meshloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back; by, its last column, names folders
    that a filter on it skips."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fence(df: DataFrame) -> DataFrame:
    """df behind a one-row generator: the optimiser neither merges the projections
    on its two sides nor pushes predicates through, either of which would repeat
    the expressions of one step in the next, again and again."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("r")).select("r.*")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as scans: position, unit normal, colour, direction and position field."""
    e = [F.col("embedding")[i].cast("double") for i in range(14)]
    c16 = lambda c: F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)) * 65535.0).cast("int")
    base = read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("pid"), F.col("label").alias("scan_id"), e[0].alias("x"), e[1].alias("y"), e[2].alias("z"),
        e[3].alias("mx"), e[4].alias("my"), e[5].alias("mz"), c16(e[6]).alias("c0"), c16(e[7]).alias("c1"),
        c16(e[8]).alias("c2"), e[9].alias("ux"), e[10].alias("uy"), e[11].alias("uz"), e[12].alias("s"), e[13].alias("t"))
    return base.selectExpr(*FIELD_STEPS[0]).selectExpr(*FIELD_STEPS[1]).selectExpr(*FIELD_STEPS[2]).selectExpr(*FIELD_STEPS[3])


_P = ("pid", "scan_id", "x", "y", "z", "c0", "c1", "c2")
#: Unit normal; direction projected to the tangent plane; unit direction; position field.
FIELD_STEPS = (
    (*_P, "ux", "uy", "uz", "s", "t", "sqrt(mx * mx + my * my + mz * mz) AS len", "mx", "my", "mz"),
    (*_P, "s", "t", "mx / len AS nx", "my / len AS ny", "mz / len AS nz",
     *[f"u{a} - m{a} / len * ((ux * mx + uy * my + uz * mz) / len) AS w{a}" for a in "xyz"]),
    (*_P, "s", "t", "nx", "ny", "nz", *[f"w{a} / sqrt(wx * wx + wy * wy + wz * wz) AS q{a}" for a in "xyz"]),
    (*_P, "nx", "ny", "nz", "qx", "qy", "qz",
     "x + 0.05 * (s * qx + t * (ny * qz - nz * qy)) AS ox", "y + 0.05 * (s * qy + t * (nz * qx - nx * qz)) AS oy",
     "z + 0.05 * (s * qz + t * (nx * qy - ny * qx)) AS oz"),
)


def cloud_sql() -> str:
    """The same view for the oracle engine, whose lists count from one."""
    e = [f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(14)]
    c16 = lambda c: f"CAST(floor(least(1.0, greatest(0.0, {c})) * 65535.0) AS INT)"
    names = ["x", "y", "z", "mx", "my", "mz", None, None, None, "ux", "uy", "uz", "s", "t"]
    cols = ["vec_id AS pid", "label AS scan_id"] + [f"{v} AS {n}" for v, n in zip(e, names) if n]
    cols += [f"{c16(e[6 + k])} AS c{k}" for k in range(3)]
    sql = f"SELECT {', '.join(cols)} FROM embeddings"
    for step in FIELD_STEPS:
        sql = f"SELECT {', '.join(step)} FROM ({sql})"
    return sql
