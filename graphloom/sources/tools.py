"""Tool manifests and rule registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalar

MANIFEST = "tools array<struct<name:string,command:string,min_version:string,required:boolean>>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.explode("tools").alias("t")).select("t.*")


def status(probed: DataFrame) -> DataFrame:
    """tools (with output, NULL where the tool did not run) and available, satisfies_min, is_missing."""
    ok: Column = F.col("output").isNotNull()
    known = scalar.version_parts(F.col("output"))
    meets = F.when(F.col("min_version").isNull(), True).when(known.isNotNull(), scalar.version_satisfies(F.col("output"), F.col("min_version")))
    return probed.withColumns(
        {"available": ok, "satisfies_min": F.when(ok, meets), "is_missing": F.coalesce(F.col("required"), F.lit(False)) & ~ok}
    )


def registry(spark: SparkSession, path: str) -> DataFrame:
    """rule, version of a registry file."""
    schema = "rules array<struct<id:string,version:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("rules").alias("r")).select(F.col("r.id").alias("rule"), "r.version")


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """language, content of <folder>/<language>/porting-template.md; none is an error."""
    found = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="porting-template.md")
    out = found.select(F.regexp_extract(F.input_file_name(), r"/([^/]+)/porting-template\.md$", 1).alias("language"), F.col("value").alias("content"))
    if out.isEmpty():
        raise FileNotFoundError(f"E009: no porting template below {folder}")
    return out
