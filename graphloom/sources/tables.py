"""The graph's tables as Parquet: versions in folders of their own, and a pointer to the current one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.cdc import Store
from graphloom.operators.graph import EDGE_KEY, Graph
from graphloom.schemas import DOMAINS

EXTRA = (
    "is_async boolean, visibility string, is_abstract boolean, decorators array<string>, migration_priority int, rust_kind string, "
    "rust_path string, crate_name string"
)


class UnknownValue(Exception):
    """A value that the schema does not know, where it must."""


def lenient(df: DataFrame, column: str, domain: str) -> tuple[DataFrame, DataFrame]:
    """df with unknown values NULL, and a warning (subject, code, detail) for each."""
    bad = F.col(column).isNotNull() & ~F.col(column).isin(*DOMAINS[domain])
    key = "id" if "id" in df.columns else "source"
    warnings = df.where(bad).select(F.col(key).alias("subject"), F.lit(f"unknown_{column}").alias("code"), F.col(column).alias("detail"))
    return df.withColumn(column, F.when(~bad, F.col(column))), warnings


def strict(df: DataFrame, column: str, domain: str) -> DataFrame:
    """df, or UnknownValue if a value is unknown."""
    bad = df.where(F.col(column).isNull() | ~F.col(column).isin(*DOMAINS[domain])).select(column).limit(1).collect()
    if bad:
        raise UnknownValue(f"E008: {column} {bad[0][0]!r}")
    return df


def parse_extra(nodes: DataFrame, column: str = "extra") -> tuple[DataFrame, DataFrame]:
    """nodes with the sparse attributes of a JSON column; text that is no JSON gives defaults and a warning, and an
    unknown value inside only empties its own field."""
    parsed = nodes.withColumn("__x", F.from_json(column, EXTRA, {"mode": "PERMISSIVE"}))
    broken = F.col(column).isNotNull() & ~F.coalesce(F.col(column).rlike(r"^\s*\{"), F.lit(False)) | (
        F.col(column).isNotNull() & F.expr(f"try_parse_json({column})").isNull()
    )
    warnings = parsed.where(broken).select(F.col("id").alias("subject"), F.lit("bad_extra").alias("code"), F.col(column).alias("detail"))
    field = lambda name: F.when(~broken, F.col(f"__x.{name}"))
    known = lambda name, domain: F.when(field(name).isin(*DOMAINS[domain]), field(name))
    out = parsed.withColumns(
        {
            "is_async": F.coalesce(field("is_async"), F.lit(False)),
            "is_abstract": F.coalesce(field("is_abstract"), F.lit(False)),
            "visibility": known("visibility", "visibility"),
            "rust_kind": known("rust_kind", "rust_kind"),
            "decorators": F.coalesce(field("decorators"), F.array().cast("array<string>")),
            "migration_priority": field("migration_priority"),
            "rust_path": field("rust_path"),
            "crate_name": field("crate_name"),
        }
    )
    return out.drop("__x", column), warnings


def _pointer(root: str) -> str:
    return f"{root.rstrip('/')}/_current"


def _current(spark: SparkSession, root: str) -> Row | None:
    """n, version of the last pointer.  Pointers are only ever added, so one that breaks off leaves the one before it."""
    try:
        pointers = spark.read.schema("n long, version string").json(_pointer(root))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return pointers.orderBy(F.desc_nulls_last("n"), F.desc("version")).first()


def save(spark: SparkSession, root: str, store: Store) -> str:
    """Write a new version, edges apart by type, and then make it the current one."""
    version = uuid.uuid4().hex
    base = f"{root.rstrip('/')}/{version}"
    graph = store.graph.with_integrity()
    graph.nodes.write.parquet(f"{base}/nodes")
    graph.raw_edges.dropDuplicates(EDGE_KEY).write.partitionBy("edge_type").parquet(f"{base}/edges")
    store.fingerprints.write.parquet(f"{base}/fingerprints")
    if store.analyses is not None:
        store.analyses.write.parquet(f"{base}/analyses")
    said = [("graph_integrity", store.integrity), ("analyses", str(store.analyses is not None).lower())]
    meta = spark.createDataFrame(said, "key string, value string")
    meta.coalesce(1).write.parquet(f"{base}/metadata")
    last = _current(spark, root)
    n = (last["n"] or 0) + 1 if last else 1
    spark.createDataFrame([(n, version)], "n long, version string").coalesce(1).write.mode("append").json(_pointer(root))
    return version


def load(spark: SparkSession, root: str) -> Store:
    """The current version; unknown kinds of nodes and edges are an error."""
    current = _current(spark, root)
    if current is None:
        raise FileNotFoundError(f"no version in {root}")
    base = f"{root.rstrip('/')}/{current['version']}"
    nodes = strict(spark.read.parquet(f"{base}/nodes"), "node_type", "node_type")
    edges = strict(spark.read.parquet(f"{base}/edges"), "edge_type", "edge_type")
    metadata = spark.read.parquet(f"{base}/metadata")
    kept = not metadata.where("key = 'analyses' and value = 'true'").isEmpty()
    analyses = spark.read.parquet(f"{base}/analyses") if kept else None
    return Store(Graph(nodes, edges), spark.read.parquet(f"{base}/fingerprints"), integrity(metadata), analyses)


def integrity(metadata: DataFrame) -> str:
    row = metadata.where("key = 'graph_integrity'").first()
    return row["value"] if row else "full"


def checked(df: DataFrame, test: Column, message: Callable[[], str]) -> DataFrame:
    """df, or an error if a row fails the test."""
    if not df.where(~F.coalesce(test, F.lit(False))).isEmpty():
        raise UnknownValue(message())
    return df
