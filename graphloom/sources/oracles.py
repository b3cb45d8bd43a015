"""Edge lists of other tools, brought to one form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalar


def _edges(rows: DataFrame) -> DataFrame:
    s, t = scalar.canonical_file(F.col("source")), scalar.canonical_file(F.col("target"))
    return rows.select(s.alias("source"), t.alias("target")).where("source <> '' and target <> ''").distinct()


def module_list(spark: SparkSession, path: str) -> DataFrame:
    """JSON with modules of a source and dependencies that are resolved."""
    schema = "modules array<struct<source:string,dependencies:array<struct<resolved:string>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("modules").alias("m"))
    return _edges(rows.select(F.col("m.source").alias("source"), F.explode("m.dependencies.resolved").alias("target")))


def tree(spark: SparkSession, path: str) -> DataFrame:
    """JSON with a map from each file to what it requires."""
    schema = "tree map<string,array<struct<issuer:string,id:string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("tree").alias("file", "d"))
    return _edges(rows.select(F.col("file").alias("source"), F.explode("d.id").alias("target")))


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """JSON with a list of symbol edges: source, target, type."""
    schema = "edges array<struct<source:string,target:string,type:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("edges").alias("e")).select("e.*")
