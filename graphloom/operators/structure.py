"""Code lines, functions and nesting of source files against their translations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import quality
from graphloom.session import ship


def measures(files: DataFrame) -> DataFrame:
    """path, functions, nesting of files (path, language, content); NULL where a file cannot be parsed or the
    language has no measure."""
    ship(files.sparkSession)

    def one(language: str, text: str) -> tuple[int | None, int | None]:
        from graphloom.lang import rust
        from graphloom.lang.base import adapter

        if language == "rust":
            return rust.functions(text), rust.depth(text)
        own = adapter(language)
        found: list[int | None] = []
        for f in (own.functions, own.nesting):
            try:
                found.append(f(text))
            except (NotImplementedError, SyntaxError, ValueError):
                found.append(None)
        return found[0], found[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *one(g, c or "")) for p, g, c in zip(frame["path"], frame["language"], frame["content"], strict=True)]
            out = pd.DataFrame(rows, columns=["path", "functions", "nesting"])
            yield out.astype({"functions": "Int64", "nesting": "Int64"})

    return files.select("path", "language", "content").mapInPandas(run, "path string, functions long, nesting long")


def compare(pairs: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """module with code, functions and nesting of both sides, and their ratios.

    pairs: module, source_path, target_path.  Code and functions are summed over
    a module's files, nesting is the deepest.
    """

    def side(files: DataFrame, key: str, name: str) -> DataFrame:
        each = quality.lines_by_file(files).select("path", "code").join(measures(files), "path")
        joined = pairs.select("module", F.col(key).alias("path")).distinct().join(each, "path")
        return joined.groupBy("module").agg(
            F.sum("code").alias(f"{name}_code"), F.sum("functions").alias(f"{name}_functions"), F.max("nesting").alias(f"{name}_nesting")
        )

    both = side(source, "source_path", "source").join(side(target, "target_path", "target"), "module", "full_outer")
    return quality.structure_ratios(both)
