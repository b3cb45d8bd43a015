"""Source trees written from the relational tables: a file for each part, a function for each of its lines, and
imports and calls for consecutive lines of an order.  What a build finds in them is known from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import build
from graphloom.plans import catalogue
from graphloom.plans import lenses as L

GO_MODULE = "example.com/parts"
_USES = f"SELECT DISTINCT source, target, symbol FROM ({L.USAGE})"


def _key(c: str) -> Column:
    return F.split(c, ":")[1]


def _text(language: str, header: Column, uses: Column, defines: Column) -> Column:
    lines = F.concat(F.coalesce(uses, F.array().cast("array<string>")), F.coalesce(defines, F.array().cast("array<string>")))
    return F.concat(header, F.array_join(lines, "\n"), F.lit("\n"))


def tree(spark: SparkSession, d: str, language: str) -> DataFrame:
    """path, language, content."""
    uses = L.view(spark, d, _USES).select(_key("source").alias("k"), _key("target").alias("t"), "symbol")
    symbols = L.view(spark, d, L.SYMBOLS).select(F.col("file_path").alias("k"), "name")
    s, t = F.col("symbol"), F.col("t")
    local = F.concat(F.lit("p"), t, F.lit("_"), s)
    if language == "python":
        use = F.when(s.isNull(), F.concat(F.lit("from .p"), t, F.lit(" import *"))).otherwise(
            F.concat(F.lit("from .p"), t, F.lit(" import "), s, F.lit(" as "), local, F.lit("\n"), local, F.lit("()"))
        )
        define, header, path = F.format_string("def %s(x=0):\n    return x", "name"), F.lit('"""A part."""\n'), "pkg/p%s.py"
    elif language == "typescript":
        use = F.when(s.isNull(), F.concat(F.lit("import './p"), t, F.lit("';"))).otherwise(
            F.concat(F.lit("import { "), s, F.lit(" as "), local, F.lit(" } from './p"), t, F.lit("';\n"), local, F.lit("();"))
        )
        define, header, path = F.format_string("export function %s(x: number): number {\n  return x;\n}", "name"), F.lit("// a part\n"), "pkg/p%s.ts"
    else:
        use = F.concat(F.lit("import p"), t, F.lit(f' "{GO_MODULE}/p'), t, F.lit('"'))
        define = F.format_string("func %s(x int) int {\n\treturn x\n}", F.initcap("name"))
        header, path = F.lit("package part\n\n"), "p%s/part.go"
    used = uses.groupBy("k").agg(F.array_sort(F.collect_set(use)).alias("uses"))
    defined = symbols.groupBy("k").agg(F.array_sort(F.collect_list(define)).alias("defines"))
    both = used.join(defined, "k", "full_outer")
    return both.select(
        F.format_string(path, "k").alias("path"), F.lit(language).alias("language"), _text(language, header, F.col("uses"), F.col("defines")).alias("content")
    )


def _built(spark: SparkSession, d: str, language: str) -> DataFrame:
    return build.build(tree(spark, d, language), GO_MODULE).graph.raw_edges


def _part(c: str, language: str) -> Column:
    pattern = r":p(\d+)/" if language == "go" else r"/p(\d+)\."
    return F.regexp_extract(c, pattern, 1)


_PAIRS = (
    f"SELECT split_part(source, ':', 2) AS source, split_part(target, ':', 2) AS target, {{used}} AS used_symbols FROM ({L.USAGE}) "
    "WHERE source <> target GROUP BY 1, 2"
)
_NAMED = "CASE WHEN count(*) = count(symbol) THEN string_agg(DISTINCT symbol, ',' ORDER BY symbol) END"
_CALLS = f"SELECT DISTINCT split_part(source, ':', 2) AS source, split_part(target, ':', 2) AS target, symbol FROM ({L.USAGE}) WHERE symbol IS NOT NULL"


def _register(language: str, used: str) -> None:
    @catalogue.query(f"build_{language}_imports", _PAIRS.replace("{used}", used))
    def _(spark, d):
        e = _built(spark, d, language).where("edge_type = 'imports'")
        return e.select(_part("source", language).alias("source"), _part("target", language).alias("target"), F.array_join("used_symbols", ",").alias("used_symbols"))

    if language == "go":
        return

    @catalogue.query(f"build_{language}_calls", _CALLS)
    def _(spark, d):
        e = _built(spark, d, language).where("edge_type = 'calls'").select("source", "target").distinct()
        return e.select(_part("source", language).alias("source"), _part("target", language).alias("target"), F.split("target", ":", 3)[2].alias("symbol"))

    @catalogue.query(f"build_{language}_nodes", f"SELECT count(*) AS functions, count(DISTINCT file_path) AS files FROM ({L.SYMBOLS})")
    def _(spark, d):
        nodes = build.build(tree(spark, d, language)).graph.nodes.where("node_type = 'function'")
        return nodes.agg(F.count("*").alias("functions"), F.count_distinct("file_path").alias("files"))


_register("python", _NAMED)
_register("typescript", _NAMED)
_register("go", "CAST(NULL AS VARCHAR)")
