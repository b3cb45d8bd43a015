"""Source trees as a frame of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.lang.go import MACHINES, SYSTEMS

#: Folders that hold no sources of a language.
EXCLUDES = {
    "typescript": ("node_modules", "dist", "build", "coverage", ".git"),
    "python": ("__pycache__", ".venv", "venv", "build", "dist", ".git", ".tox", "site-packages"),
    "go": ("vendor", "testdata", ".git"),
}


def relative(path: Column, root: str) -> Column:
    """The path below the root, with slashes."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.regexp_replace(plain, r"^(?:[a-z0-9]+:)?/*" + _quoted(root.split(":", 1)[-1].strip("/")) + "/", "")


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r".^$*+?()[]{}|\\" else c for c in text)


def handles_typescript(path: Column) -> Column:
    return path.rlike(r"\.tsx?$") & ~path.rlike(r"\.d\.ts$|\.(test|spec)\.[^/]*$")


def handles_python(path: Column) -> Column:
    return path.endswith(".py")


def handles_go(path: Column) -> Column:
    """Not a test, and not for another platform than linux on amd64, by the end of the name."""
    stem = F.regexp_extract(path, r"([^/]+)\.go$", 1)
    parts = F.split(stem, "_")
    last, before, n = F.element_at(parts, -1), F.get(parts, F.size(parts) - 2), F.size(parts)
    led = F.array_join(F.slice(parts, 1, F.greatest(n - 2, F.lit(1))), "_") != ""
    both = (n > 2) & before.isin(*SYSTEMS, "linux") & last.isin(*MACHINES, "amd64") & led
    foreign = before.isin(*SYSTEMS) | last.isin(*MACHINES)
    one = (n > 1) & (F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(1))), "_") != "") & last.isin(*SYSTEMS, *MACHINES)
    return path.endswith(".go") & ~path.endswith("_test.go") & ~F.when(both, foreign).otherwise(one)


HANDLES = {"typescript": handles_typescript, "python": handles_python, "go": handles_go}


def language_of(path: Column, languages: list[str]) -> Column:
    """The first of the languages whose sources the path is among; NULL if none."""
    out = F.lit(None).cast("string")
    for language in reversed(languages):
        out = F.when(HANDLES[language](path), language).otherwise(out)
    return out


def collect(spark: SparkSession, root: str, languages: list[str], extra_excludes: tuple[str, ...] = ()) -> DataFrame:
    """path, language, content of all sources below a folder, on any file system that Spark reads."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = relative(F.col("path"), root)
    own = found.select(path.alias("path"), "content").withColumn("language", language_of(F.col("path"), languages))
    excluded = sorted({x for language in languages for x in EXCLUDES[language]} | set(extra_excludes))
    kept = ~F.exists(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), lambda part: part.isin(*excluded)) if excluded else F.lit(True)
    text = F.decode("content", "UTF-8")
    return own.where(F.col("language").isNotNull() & kept).select("path", "language", text.alias("content"))


def source_root(files: DataFrame, language: str, depth: int = 5) -> str:
    """'src' if sources of the language are there within the depth, else '.'; Go modules are their own root."""
    if language == "go" and not files.where("path = 'go.mod'").isEmpty():
        return "."
    inside = files.where(F.col("path").startswith("src/") & (F.size(F.split("path", "/")) <= depth + 1))
    return "." if inside.where(HANDLES[language](F.col("path"))).isEmpty() else "src"


def go_module(go_mod: str) -> str:
    """The module path of a go.mod."""
    return next((line.split()[1] for line in go_mod.splitlines() if line.startswith("module ")), "")
