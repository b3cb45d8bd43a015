"""From import specifiers and calls to edges.

Tables: files (path); imports (file, seq, specifier, name, alias, symbol_kind,
kind, reexport; a row per symbol, name NULL where there is none); calls (file,
callee, receiver, is_constructor); bindings (file, variable, type); nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.operators.usage import absorbing_union
from graphloom.session import cut

TS_EXTENSIONS = (".ts", ".tsx")


def _pick(candidates: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate of the lowest rank that is a file."""
    there = candidates.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate")
    return there.groupBy(*keys).agg(F.min_by("candidate", "rank").alias("target"))


def _ranked(df: DataFrame, listed: list[Column]) -> DataFrame:
    return df.select("*", F.posexplode(F.array(*listed)).alias("rank", "candidate")).where("candidate is not null")


def resolve_relative(specifiers: DataFrame, files: DataFrame, extensions: tuple[str, ...] = TS_EXTENSIONS) -> DataFrame:
    """file, specifier, target of './' and '../' specifiers: as written, with a script's extension made one of
    the source's, with each extension, and as a folder's index; paths that leave the root resolve to nothing."""
    base = specifiers.select("file", "specifier").distinct().where(F.col("specifier").startswith("."))
    joined = scalar.normalize_path(F.concat_ws("/", scalar.parent_dir(F.col("file")), F.col("specifier")))
    base = base.withColumn("p", joined).where("p is not null")
    stem = F.regexp_extract("p", r"^(.*)\.(js|jsx|mjs|cjs)$", 1)
    listed = [F.col("p")]
    listed += [F.when(stem != "", F.concat(stem, F.lit(e))) for e in extensions]
    listed += [F.concat("p", F.lit(e)) for e in extensions]
    listed += [F.concat("p", F.lit(f"/index{e}")) for e in extensions]
    return _pick(_ranked(base, listed), files, ["file", "specifier"])


def resolve_python(specifiers: DataFrame, files: DataFrame) -> DataFrame:
    """file, specifier, target of dotted names; leading dots climb from the file's package, too many resolve to nothing."""
    base = specifiers.select("file", "specifier").distinct()
    dots = F.length(F.regexp_extract("specifier", r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace("specifier", r"^\.+", ""), F.lit("."), F.lit("/"))
    here = F.filter(F.split(scalar.parent_dir(F.col("file")), "/"), lambda x: x != "")
    up = dots - 1
    kept = F.when(up <= F.size(here), F.slice(here, F.lit(1), F.greatest(F.size(here) - up, F.lit(0))))
    path = F.when(dots == 0, rest).when(kept.isNotNull(), F.array_join(F.filter(F.array_append(kept, rest), lambda x: x != ""), "/"))
    base = base.withColumn("p", path).where("p is not null")
    inside = F.when(F.col("p") == "", "__init__.py").otherwise(F.concat("p", F.lit("/__init__.py")))
    return _pick(_ranked(base, [F.when(F.col("p") != "", F.concat("p", F.lit(".py"))), inside]), files, ["file", "specifier"])


def resolve_go(specifiers: DataFrame, files: DataFrame, module: str) -> DataFrame:
    """file, specifier, target of import paths below the module: the first non-test file of the folder."""
    first = (
        files.where(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go"))
        .groupBy(scalar.parent_dir(F.col("path")).alias("dir"))
        .agg(F.min("path").alias("target"))
    )
    base = specifiers.select("file", "specifier").distinct()
    inside = (F.col("specifier") == module) | F.col("specifier").startswith(module + "/")
    base = base.where(inside).withColumn("dir", F.substring(F.col("specifier"), F.lit(len(module) + 2), F.length("specifier")))
    return base.join(first, "dir").select("file", "specifier", "target")


def links(specifiers: DataFrame, paths: DataFrame, suffixes: tuple[str, ...] = ("", ".html", "/index.html")) -> DataFrame:
    """source, specifier, target of hyperlinks: as written, then with each ending."""
    base = specifiers.select("source", "specifier").distinct()
    listed = [F.concat("specifier", F.lit(s)) for s in suffixes]
    return _pick(_ranked(base, listed), paths, ["source", "specifier"])


# --- re-exports ------------------------------------------------------------


def reexport_origins(exports: DataFrame, named: DataFrame, wildcards: DataFrame, asked: DataFrame) -> DataFrame:
    """file, symbol, origin, original: where an exported symbol of a barrel is really from.

    exports: file, symbol of its own; named: file, symbol, target, original;
    wildcards: file, seq, target; asked: file, symbol.  Own exports beat named
    re-exports, those beat wildcards, and of these the first in order that
    leads anywhere counts.  A file is not entered twice on a way.  A named
    re-export whose way leads nowhere ends at its direct target.
    """
    start = asked.select("file", "symbol").distinct()
    way = start.select(
        "file", "symbol", F.col("file").alias("at"), F.col("symbol").alias("name"), F.array().cast("array<int>").alias("rank"),
        F.array("file").alias("seen"), F.lit(None).cast("string").alias("fall_file"), F.lit(None).cast("string").alias("fall_name"),
        F.array().cast("array<int>").alias("fall_rank"),
    )
    own = exports.select(F.col("file").alias("at"), F.col("symbol").alias("name")).distinct()
    by_name = named.select(F.col("file").alias("at"), F.col("symbol").alias("name"), F.col("target").alias("next"), F.col("original").alias("next_name"))
    stars = wildcards.select(F.col("file").alias("at"), "seq", F.col("target").alias("next"))
    ended = None
    while True:  # it ends, as no way enters a file twice
        here = way.join(own, ["at", "name"], "left_semi")
        done = here.select("file", "symbol", F.array_append("rank", F.lit(0)).alias("rank"), F.col("at").alias("origin"), F.col("name").alias("original"))
        rest = way.join(own, ["at", "name"], "left_anti")
        over = rest.join(by_name, ["at", "name"])
        step = over.where(~F.array_contains("seen", F.col("next"))).select(
            "file", "symbol", F.col("next").alias("at"), F.col("next_name").alias("name"), F.array_append("rank", F.lit(1)).alias("rank"),
            F.array_append("seen", F.col("next")).alias("seen"), F.col("next").alias("fall_file"), F.col("next_name").alias("fall_name"),
            F.array_append("rank", F.lit(1)).alias("fall_rank"),
        )
        falls = over.select(
            "file", "symbol", F.concat("rank", F.array(F.lit(1), F.lit(1_000_000))).alias("rank"), F.col("next").alias("origin"), F.col("next_name").alias("original")
        )
        plain = rest.join(by_name.select("at", "name").distinct(), ["at", "name"], "left_anti")
        spread = plain.join(stars, "at").where(~F.array_contains("seen", F.col("next"))).select(
            "file", "symbol", F.col("next").alias("at"), "name", F.array_append("rank", F.col("seq") + 2).alias("rank"),
            F.array_append("seen", F.col("next")).alias("seen"), "fall_file", "fall_name", "fall_rank",
        )
        found = done.unionByName(falls)
        ended = found if ended is None else ended.unionByName(found)
        way = cut(step.unionByName(spread))
        if way.isEmpty():
            break
    return ended.groupBy("file", "symbol").agg(F.min_by(F.struct("origin", "original"), "rank").alias("o")).select(
        "file", "symbol", "o.origin", "o.original"
    )


# --- edges -----------------------------------------------------------------


def import_usage(imports: DataFrame, resolved: DataFrame, origins: DataFrame) -> DataFrame:
    """source, target, used_symbols (NULL: all) for each pair of files, with barrels passed through.

    A re-export, an import without symbols, a default or namespace import, and
    a symbol that comes from behind a barrel use all of their file.
    """
    hit = imports.join(resolved, ["file", "specifier"])
    o = origins.select(F.col("file").alias("target"), F.col("symbol").alias("name"), "origin")
    hit = hit.join(o, ["target", "name"], "left")
    named = (F.col("symbol_kind") == "named") & ~F.col("reexport")
    dest = F.when(named, F.coalesce("origin", "target")).otherwise(F.col("target"))
    one = named & F.col("name").isNotNull() & (dest == F.col("target"))
    used = hit.select(F.col("file").alias("source"), dest.alias("target"), F.when(one, F.array("name")).alias("used"))
    return used.groupBy("source", "target").agg(absorbing_union("used").alias("used_symbols"))


def import_aliases(imports: DataFrame, resolved: DataFrame, origins: DataFrame) -> DataFrame:
    """file, local, target, original: what a local name of a file means; names with two meanings mean nothing."""
    hit = imports.where(~F.col("reexport") & F.col("name").isNotNull()).join(resolved, ["file", "specifier"])
    o = origins.select(F.col("file").alias("target"), F.col("symbol").alias("name"), "origin", "original")
    hit = hit.join(o, ["target", "name"], "left")
    named = F.col("symbol_kind") == "named"
    rows = hit.select(
        "file",
        F.coalesce("alias", "name").alias("local"),
        F.when(named, F.coalesce("origin", "target")).otherwise(F.col("target")).alias("dest"),
        F.when(named, F.coalesce("original", "name")).alias("source_name"),
        (F.col("symbol_kind") == "namespace").alias("namespace"),
    )
    return rows.groupBy("file", "local").agg(
        F.min("dest").alias("target"), F.count_distinct("dest").alias("n"), F.min("source_name").alias("original"),
        F.count_distinct("source_name").alias("m"), F.bool_or("namespace").alias("namespace"),
    ).where("n = 1").select("file", "local", "target", F.when(F.col("m") == 1, F.col("original")).alias("original"), "namespace")


def unique_names(nodes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """name, id of the symbols of some kinds whose name no other has."""
    own = nodes.where(F.col("node_type").isin(*kinds))
    return own.groupBy("name").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n")).where("n = 1").select("name", "id")


def fix_extends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """extends edges whose target is no node: the class of that name in the same file, the enum there, or the only
    interface, class or enum of the name anywhere."""
    heir = edges.where("edge_type = 'extends'")
    rest = edges.where("edge_type <> 'extends'")
    ids = nodes.select(F.col("id").alias("target"), F.lit(True).alias("there")).distinct()
    local = nodes.where("node_type in ('class', 'enum')").select(
        F.col("file_path").alias("path"), "name", F.col("id").alias("local"), F.when(F.col("node_type") == "class", 0).otherwise(1).alias("r")
    )
    local = local.groupBy("path", "name").agg(F.min_by("local", "r").alias("local"))
    anywhere = unique_names(nodes, ("interface", "class", "enum")).withColumnRenamed("id", "unique")
    keyed = heir.withColumn("path", scalar.node_path(F.col("source"))).withColumn("name", F.coalesce(scalar.node_symbol(F.col("target")), F.col("target")))
    found = keyed.join(ids, "target", "left").join(local, ["path", "name"], "left").join(anywhere, "name", "left")
    target = F.when(F.col("there"), F.col("target")).otherwise(F.coalesce("local", "unique", "target"))
    return rest.unionByName(found.withColumn("target", target).select(*edges.columns))


def _at(df: DataFrame, nodes: DataFrame, kinds: tuple[str, ...], path: str, name: str, out: str) -> DataFrame:
    """df with the id of the symbol of a kind, file and name, if it is there."""
    own = nodes.where(F.col("node_type").isin(*kinds)).select(F.col("file_path").alias("__p"), F.col("name").alias("__n"), F.col("id").alias(out))
    own = own.groupBy("__p", "__n").agg(F.min(out).alias(out))
    return df.join(own, (F.col(path) == F.col("__p")) & (F.col(name) == F.col("__n")), "left").drop("__p", "__n")


def call_edges(calls: DataFrame, nodes: DataFrame, aliases: DataFrame, bindings: DataFrame) -> DataFrame:
    """source (file), callee, target, sub_kind of the calls that can be told.

    The ways are tried in order, and the first whose condition holds decides,
    also when it finds nothing: a local class or function; an imported name; a
    method of a variable that was bound to a type; the only class, or the only
    Type.method, of that name anywhere.
    """
    functions, classes = ("function",), ("class",)
    base = F.regexp_extract("callee", r"^([^.]+)\.", 1)
    last = F.element_at(F.split("callee", r"\."), -1)
    c = calls.withColumn("base", F.when(base != "", base)).withColumn("last", last)
    c = c.withColumn("key", F.coalesce("base", "callee"))
    c = _at(c, nodes, classes, "file", "callee", "local_class")
    c = _at(c, nodes, functions, "file", "callee", "local_function")
    a = aliases.select("file", F.col("local").alias("key"), F.col("target").alias("imported"), "original", "namespace")
    c = c.join(a, ["file", "key"], "left")
    # the name on the other side: what follows a namespace, or the name before its alias
    c = c.withColumn("there", F.when(F.col("base").isNotNull() & F.col("namespace"), F.col("last")).when(F.col("base").isNull(), F.coalesce("original", "callee")))
    c = _at(c, nodes, classes, "imported", "there", "imported_class")
    c = _at(c, nodes, functions, "imported", "there", "imported_function")
    b = bindings.select("file", F.col("variable").alias("base"), F.col("type").alias("bound"))
    b = b.groupBy("file", "base").agg(F.min("bound").alias("bound"), F.count_distinct("bound").alias("k")).where("k = 1").drop("k")
    c = c.join(b, ["file", "base"], "left").withColumn("method", F.concat_ws(".", F.coalesce("bound", F.when(F.col("imported").isNotNull() & ~F.coalesce("namespace", F.lit(False)), F.coalesce("original", "base"))), "last"))
    c = _at(c, nodes, functions, "file", "method", "local_method")
    t = aliases.select("file", F.col("local").alias("bound"), F.col("target").alias("bound_file"), F.col("original").alias("bound_name"))
    c = c.join(t, ["file", "bound"], "left").withColumn("bound_method", F.concat_ws(".", F.coalesce("bound_name", "bound"), "last"))
    c = _at(c, nodes, functions, "bound_file", "bound_method", "imported_method")
    c = _at(c, nodes, functions, "imported", "method", "static_method")
    c = c.join(unique_names(nodes, classes).select(F.col("name").alias("callee"), F.col("id").alias("only_class")), "callee", "left")
    only = unique_names(nodes, functions).where(F.col("name").contains(".")).select(F.col("name").alias("callee"), F.col("id").alias("only_method"))
    c = c.join(only, "callee", "left")
    made = (
        F.when(F.col("local_class").isNotNull(), F.col("local_class"))
        .when(F.col("imported").isNotNull(), F.col("imported_class"))
        .otherwise(F.col("only_class"))
    )
    called = (
        F.when(F.col("local_function").isNotNull(), F.col("local_function"))
        .when(F.col("imported").isNotNull() & (F.col("base").isNull() | F.col("namespace")), F.col("imported_function"))
        .when(F.col("bound").isNotNull(), F.coalesce("local_method", "imported_method"))
        .when(F.col("imported").isNotNull(), F.col("static_method"))
        .otherwise(F.col("only_method"))
    )
    target = F.when(F.col("is_constructor"), made).otherwise(called)
    out = c.withColumn("target", target).where("target is not null")
    return out.select("file", "callee", "target", F.when(F.col("is_constructor"), "constructor").alias("sub_kind"))


