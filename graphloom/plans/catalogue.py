"""Queries over the lenses, one or more for each operator, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.operators import cdc, closure, community, compare, decompose, gate, partitions, quality, resolve, scc, state, usage, validate
from graphloom.operators.graph import Graph, interfaces
from graphloom.plans import lenses as L
from graphloom.schemas import MODULE_TRANSITIONS, PROJECT_TRANSITIONS, TERMINAL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = L.duck_sql(sql)
        return f

    return add


def parts(spark: SparkSession, d: str, like: str, dag: bool = False) -> tuple[DataFrame, DataFrame]:
    return L.view(spark, d, L.PART_FILES), L.view(spark, d, L.imports_sql(like, dag))


def graph(spark: SparkSession, d: str) -> Graph:
    return Graph(L.view(spark, d, L.NODES), L.view(spark, d, L.EDGES))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def joined(df: DataFrame) -> DataFrame:
    """Arrays as comma-separated text."""
    return df.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def quoted(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


_SPARSE, _DENSE, _CYCLIC = (L.imports_sql(like) for like in ("sparse", "dense", "cyclic"))
_DAG = L.imports_sql("dense", dag=True)
_CLOSURE = "WITH RECURSIVE e AS ({edges}), r AS (SELECT source, target FROM e UNION SELECT r.source, e.target FROM r JOIN e ON r.target = e.source) "


def _closure(edges: str) -> str:
    return _CLOSURE.replace("{edges}", edges)


# --- graph -----------------------------------------------------------------


@query("graph_stats_nodes", f"SELECT node_type, count(*) AS n FROM ({L.NODES}) GROUP BY node_type")
def _(spark, d):
    return graph(spark, d).node_counts()


@query(
    "graph_stats_edges",
    f"SELECT edge_type, CAST(sum(n) AS BIGINT) AS built, count(*) AS stored FROM (SELECT source, target, edge_type, count(*) AS n FROM ({L.EDGES}) GROUP BY ALL) GROUP BY edge_type",
)
def _(spark, d):
    return graph(spark, d).edge_counts()


@query("graph_export_nodes", f"SELECT id, split_part(id, ':', 1) AS kind, split_part(id, ':', 2) AS path FROM ({L.NODES})")
def _(spark, d):
    return graph(spark, d).nodes.select("id", scalar.node_kind(F.col("id")).alias("kind"), scalar.node_path(F.col("id")).alias("path"))


@query(
    "neighbors_out",
    f"WITH e AS ({L.EDGES}), n AS ({L.NODES}) SELECT source, count(*) AS n, count(DISTINCT target) AS targets FROM e JOIN n ON target = id GROUP BY source",
)
def _(spark, d):
    return graph(spark, d).outgoing().groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("target").alias("targets"))


@query(
    "neighbors_in",
    f"WITH e AS ({L.EDGES}), n AS ({L.NODES}) SELECT target, count(*) AS n, count(DISTINCT source) AS sources FROM e JOIN n ON source = id WHERE edge_type = 'imports' GROUP BY target",
)
def _(spark, d):
    return graph(spark, d).incoming("imports").groupBy("target").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query(
    "induced_subgraph",
    f"WITH e AS ({L.EDGES}), n AS (SELECT id FROM ({L.NODES}) WHERE node_type = 'file' AND CAST(split_part(id, ':', 2) AS BIGINT) % 2 = 0) "
    "SELECT source, target, edge_type, count(*) AS n FROM e WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n) GROUP BY ALL",
)
def _(spark, d):
    g = graph(spark, d)
    own = g.files().select("id").where(scalar.node_path(F.col("id")).cast("long") % 2 == 0)
    return g.induced(own).raw_edges.groupBy("source", "target", "edge_type").agg(F.count("*").alias("n"))


@query(
    "dangling_edges",
    f"WITH e AS ({L.EDGES}), n AS (SELECT id FROM ({L.NODES}) WHERE id NOT LIKE 'file:%7') "
    "SELECT source, target, count(*) AS n FROM e WHERE source NOT IN (SELECT id FROM n) OR target NOT IN (SELECT id FROM n) GROUP BY ALL",
)
def _(spark, d):
    g = graph(spark, d)
    cutdown = Graph(g.nodes.where("id not like 'file:%7'"), g.raw_edges)
    return cutdown.dangling().groupBy("source", "target").agg(F.count("*").alias("n"))


@query(
    "edge_integrity",
    f"WITH e AS ({L.EDGES}), n AS (SELECT id FROM ({L.NODES}) WHERE id NOT LIKE 'file:%7') "
    "SELECT edge_type, count(*) AS n FROM e WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n) GROUP BY ALL",
)
def _(spark, d):
    g = graph(spark, d)
    kept = Graph(g.nodes.where("id not like 'file:%7'"), g.raw_edges).with_integrity()
    return kept.raw_edges.groupBy("edge_type").agg(F.count("*").alias("n"))


@query(
    "file_removal",
    f"WITH e AS ({_DENSE}) SELECT count(*) AS edges, count(DISTINCT source) AS sources FROM e WHERE source % 5 <> 0 AND target % 5 <> 0",
)
def _(spark, d):
    files, e = parts(spark, d, "dense")
    path = lambda c: F.concat(F.lit("file:"), F.col(c).cast("string"))
    nodes = files.select(path("id").alias("id"), F.lit("file").alias("node_type"), F.col("id").cast("string").alias("file_path"))
    edges = e.select(path("source").alias("source"), path("target").alias("target"), F.lit("imports").alias("edge_type"))
    gone = files.where("id % 5 = 0").select(F.col("id").cast("string").alias("file_path"))
    left = Graph(nodes, edges).without_files(gone)
    return left.raw_edges.agg(F.count("*").alias("edges"), F.count_distinct("source").alias("sources"))


@query(
    "import_graph",
    f"SELECT source, target FROM ({L.EDGES}) WHERE edge_type = 'imports' GROUP BY ALL",
)
def _(spark, d):
    return graph(spark, d).import_graph()


@query(
    "degree_distribution",
    f"WITH e AS ({_DENSE}), o AS (SELECT source AS node, count(*) AS n FROM e GROUP BY 1), i AS (SELECT target AS node, count(*) AS n FROM e GROUP BY 1) "
    "SELECT coalesce(o.node, i.node) AS node, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM o FULL OUTER JOIN i ON o.node = i.node",
)
def _(spark, d):
    return closure.degrees(parts(spark, d, "dense")[1])


# --- closure ---------------------------------------------------------------


@query("rdeps_closure", f"{_closure(_SPARSE)} SELECT target AS start, source AS node FROM r WHERE target <> source")
def rdeps(spark, d):
    files, e = parts(spark, d, "sparse")
    return closure.dependents(e, files)


@query("deps_closure", f"{_closure(_SPARSE)} SELECT source AS start, target AS node FROM r WHERE target <> source")
def _(spark, d):
    files, e = parts(spark, d, "sparse")
    return closure.dependencies(e, files)


@query("closure_all_pairs", f"{_closure(_SPARSE)} SELECT source AS start, target AS node FROM r WHERE target <> source")
def _(spark, d):
    return closure.reachable(parts(spark, d, "sparse")[1])


@query("closure_rounds", f"{_closure(_SPARSE)} SELECT source AS start, target AS node FROM r WHERE target <> source")
def _(spark, d):
    return closure.reachable(parts(spark, d, "sparse")[1], kernel=-1)


@query(
    "impact_depth3",
    f"WITH RECURSIVE e AS ({_DENSE}), r AS (SELECT p_partkey AS node, 0 AS depth FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) UNION SELECT e.source, depth + 1 FROM r JOIN e ON e.target = r.node WHERE depth < 3) "
    "SELECT node, CAST(min(depth) AS INT) AS depth FROM r GROUP BY node HAVING min(depth) > 0",
)
def _(spark, d):
    files, e = parts(spark, d, "dense")
    changed = L.view(spark, d, "SELECT p_partkey AS id FROM {part} WHERE p_brand = (SELECT min(p_brand) FROM {part})")
    return closure.impact(e, changed, fuse=None)[0]


@query(
    "connected_components",
    f"WITH RECURSIVE e AS ({_SPARSE}), u AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), "
    "r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY a",
)
def _(spark, d):
    return closure.connected(parts(spark, d, "sparse")[1])


# --- components and levels --------------------------------------------------

_SCC = (
    _closure(_CYCLIC)
    + ", c AS (SELECT p.p_partkey AS node, least(p.p_partkey, coalesce(min(r.target) FILTER (WHERE b.source IS NOT NULL), p.p_partkey)) AS component "
    "FROM part p LEFT JOIN r ON r.source = p.p_partkey LEFT JOIN r b ON b.source = r.target AND b.target = r.source GROUP BY p.p_partkey) "
)


def _found(spark, d, like="cyclic", dag=False, kernel=scc.KERNEL):
    files, e = parts(spark, d, like, dag)
    return scc.components(files, e, kernel), e


@query("scc_components", f"{_SCC} SELECT node, component FROM c")
def _(spark, d):
    return _found(spark, d)[0].select("node", "component")


@query(
    "cycles",
    f"{_SCC} SELECT string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members FROM c GROUP BY component HAVING count(*) > 1 OR component IN (SELECT source FROM e WHERE source = target)",
)
def _(spark, d):
    return joined(scc.cycles(*_found(spark, d)).select(F.col("members").cast("array<string>").alias("members")))


@query("self_imports", f"SELECT source AS node FROM ({_CYCLIC}) WHERE source = target")
def _(spark, d):
    return parts(spark, d, "cyclic")[1].where("source = target").select(F.col("source").alias("node"))


_LEVEL = (
    f"WITH RECURSIVE e AS ({_DAG}), r AS (SELECT p_partkey AS node, 0 AS level FROM part UNION SELECT e.source, level + 1 FROM r JOIN e ON e.target = r.node), "
    "v AS (SELECT node, max(level) AS level FROM r GROUP BY node) "
)


@query("layers", f"{_LEVEL} SELECT node, CAST(level AS INT) AS level FROM v")
def _(spark, d):
    return _found(spark, d, "dense", True)[0].select("node", "level")


@query("topo_order", f"{_LEVEL} SELECT node, CAST(row_number() OVER (ORDER BY level, node) AS INT) AS place FROM v")
def _(spark, d):
    from pyspark.sql import Window as W

    found, e = _found(spark, d, "dense", True)
    scc.topological_order(found, e)
    sizes = found.groupBy("level").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.expr("b.level < a.level"), "left").groupBy(F.col("a.level").alias("level")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    ranked = found.withColumn("own", F.row_number().over(W.partitionBy("level").orderBy("node")))
    return ranked.join(before, "level").select("node", (F.col("before") + F.col("own")).cast("int").alias("place"))


@query("parallel_groups", f"{_LEVEL} SELECT CAST(level + 1 AS INT) AS sprint, count(*) AS n_groups, count(*) AS n_files FROM v GROUP BY level")
def _(spark, d):
    return scc.parallel_groups(*_found(spark, d, "dense", True)).select("sprint", "n_groups", "n_files")


@query("migration_sequence", f"{_SCC} SELECT component, count(*) AS n FROM c GROUP BY component")
def _(spark, d):
    return scc.migration_sequence(*_found(spark, d))["groups"].select(F.col("members")[0].alias("component"), F.size("members").cast("long").alias("n"))


@query("scc_split", f"{_SCC} SELECT component AS theirs, count(*) AS parts, count(*) AS n FROM c GROUP BY component HAVING count(*) > 1")
def _(spark, d):
    found, _ = _found(spark, d)
    return compare.split_components(found.select("node", F.col("node").alias("component")), found)


# --- usage -----------------------------------------------------------------

_USED = (
    f"WITH u AS ({L.USAGE}), s AS ({L.SYMBOLS}), i AS (SELECT source, target, CASE WHEN count(*) = count(symbol) THEN list_sort(list_distinct(list(symbol))) END AS used FROM u GROUP BY source, target), "
    "x AS (SELECT source, target, name, CAST(ceil(strlen(coalesce(signature, name)) / 4.0) AS BIGINT) AS tokens FROM i JOIN s ON s.file_path = split_part(target, ':', 2) WHERE is_exported AND (used IS NULL OR list_contains(used, name))) "
)


def _imports(spark, d):
    u = L.view(spark, d, L.USAGE)
    return u.select("source", "target", F.when(F.col("symbol").isNotNull(), F.array("symbol")).alias("used_symbols"))


@query("imported_symbols", f"{_USED} SELECT source, target, array_to_string(used, ',') AS used_symbols FROM i")
def _(spark, d):
    return joined(usage.imported_symbols(_imports(spark, d)))


@query("used_interfaces", f"{_USED} SELECT source, target, name, tokens FROM x")
def _(spark, d):
    return usage.used_interfaces(_imports(spark, d), L.view(spark, d, L.SYMBOLS)).select("source", "target", "name", "tokens")


@query("signature_tokens", f"{_USED} SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens FROM x GROUP BY source")
def _(spark, d):
    return usage.dependency_tokens(_imports(spark, d), L.view(spark, d, L.SYMBOLS))


@query("interfaces", f"SELECT file_path, name, CAST(ceil(strlen(coalesce(signature, name)) / 4.0) AS BIGINT) AS tokens FROM ({L.SYMBOLS}) WHERE is_exported")
def _(spark, d):
    return interfaces(L.view(spark, d, L.SYMBOLS)).select("file_path", "name", "tokens")


@query(
    "group_interfaces",
    f"WITH s AS ({L.SYMBOLS}) SELECT p.p_brand AS \"group\", count(s.id) AS symbols, CAST(coalesce(sum(ceil(strlen(coalesce(signature, name)) / 4.0)), 0) AS BIGINT) AS tokens "
    "FROM part p LEFT JOIN s ON s.file_path = CAST(p.p_partkey AS VARCHAR) AND is_exported GROUP BY 1",
)
def _(spark, d):
    members = L.read(spark, d, "part").select(F.col("p_brand").alias("group"), F.concat(F.lit("file:"), F.col("p_partkey").cast("string")).alias("member"))
    found = usage.group_interfaces(members, L.view(spark, d, L.SYMBOLS))
    return found.groupBy("group").agg(F.sum("symbols").alias("symbols"), F.sum("tokens").alias("tokens"))


@query(
    "unique_symbol_names",
    f"SELECT name, min(id) AS id FROM ({L.NAMED}) GROUP BY name HAVING count(*) = 1",
)
def _(spark, d):
    return resolve.unique_names(L.view(spark, d, L.NAMED), ("function",))


# --- snapshots -------------------------------------------------------------

_OLD, _NEW = L.snapshot_sql(False), L.snapshot_sql(True)


@query(
    "change_levels",
    f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN o.file_path IS NULL THEN 'added' WHEN n.file_path IS NULL THEN 'deleted' "
    "WHEN o.content_hash = n.content_hash THEN 'none' WHEN o.structure_hash = n.structure_hash THEN 'cosmetic' ELSE 'structural' END AS change FROM o FULL OUTER JOIN n ON o.file_path = n.file_path",
)
def _(spark, d):
    return cdc.changes(L.view(spark, d, _OLD), L.view(spark, d, _NEW))


@query(
    "update_stats",
    f"WITH o AS ({_OLD}), n AS ({_NEW}), c AS (SELECT CASE WHEN o.file_path IS NULL THEN 'added' WHEN n.file_path IS NULL THEN 'deleted' WHEN o.content_hash = n.content_hash THEN 'none' "
    "WHEN o.structure_hash = n.structure_hash THEN 'cosmetic' ELSE 'structural' END AS change FROM o FULL OUTER JOIN n ON o.file_path = n.file_path) SELECT count(*) AS files, "
    + ", ".join(f"count(*) FILTER (WHERE change = '{k}') AS {k}" for k in ("added", "deleted", "none", "cosmetic", "structural"))
    + " FROM c",
)
def _(spark, d):
    return cdc.update_stats(cdc.changes(L.view(spark, d, _OLD), L.view(spark, d, _NEW)))


@query("deleted_files", f"SELECT file_path FROM ({_OLD}) WHERE file_path NOT IN (SELECT file_path FROM ({_NEW}))")
def _(spark, d):
    return cdc.deleted(L.view(spark, d, _OLD), L.view(spark, d, _NEW))


@query("fingerprint_upsert", f"WITH n AS ({_NEW}) SELECT file_path, content_hash FROM n UNION ALL SELECT file_path, content_hash FROM ({_OLD}) WHERE file_path NOT IN (SELECT file_path FROM n)")
def _(spark, d):
    return cdc.upsert(L.view(spark, d, _OLD), L.view(spark, d, _NEW), ["file_path"]).select("file_path", "content_hash")


@query(
    "upsert_latest",
    "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
)
def _(spark, d):
    return validate.latest(L.read(spark, d, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(spark, d):
    return L.read(spark, d, "documents").select("doc_id", scalar.content_hash(F.col("text")).alias("content_hash"))


@query("token_estimate", "SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def _(spark, d):
    return L.read(spark, d, "documents").select("doc_id", scalar.token_estimate(F.col("text")).alias("tokens"))


# --- lines -----------------------------------------------------------------

_LINES = (
    f"WITH s AS ({L.SOURCES}), l AS (SELECT path, language, unnest(string_split(regexp_replace(content, '\\n$', ''), chr(10))) AS line FROM s WHERE content <> ''), "
    "k AS (SELECT path, language, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^\\s*(//|#)') THEN 'comment' ELSE 'code' END AS kind FROM l) "
)


@query(
    "loc_report",
    f"{_LINES} SELECT language, count(DISTINCT path) AS files, count(*) FILTER (WHERE kind = 'code') AS code, count(*) FILTER (WHERE kind = 'comment') AS comments, count(*) FILTER (WHERE kind = 'blank') AS blanks FROM k GROUP BY ROLLUP (language)",
)
def _(spark, d):
    return quality.loc_report(quality.lines_by_file(L.view(spark, d, L.SOURCES)))


@query("primary_language", f"{_LINES} SELECT language, count(*) AS lines FROM k GROUP BY language ORDER BY lines DESC, language LIMIT 1")
def _(spark, d):
    return quality.primary_language(quality.lines_by_file(L.view(spark, d, L.SOURCES)))


@query("complexity_bucket", f"{_LINES} SELECT language, CASE WHEN count(*) FILTER (WHERE kind = 'code') < 1000 THEN 'simple' WHEN count(*) FILTER (WHERE kind = 'code') <= 5000 THEN 'moderate' ELSE 'complex' END AS complexity FROM k GROUP BY language")
def _(spark, d):
    total = quality.lines_by_file(L.view(spark, d, L.SOURCES)).groupBy("language").agg(F.sum("code").alias("code"))
    return total.select("language", scalar.complexity_bucket(F.col("code")).alias("complexity"))


# --- partitions ------------------------------------------------------------

_CELLS = "WITH t AS (SELECT lang AS a, source AS b, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT a, sum(n) AS na FROM t GROUP BY a), c AS (SELECT b, sum(n) AS nb FROM t GROUP BY b), k AS (SELECT sum(n) AS total FROM t) "


def _table(spark, d):
    return partitions.contingency(L.read(spark, d, "documents"), "lang", "source")


@query("partition_contingency", "SELECT lang AS a, source AS b, count(*) AS n FROM documents GROUP BY ALL")
def _(spark, d):
    return _table(spark, d)


@query(
    "nmi",
    f"{_CELLS}, m AS (SELECT sum(n / total * ln(n * total / (na * nb))) AS mi FROM t JOIN r USING (a) JOIN c USING (b), k), ha AS (SELECT -sum(na / total * ln(na / total)) AS h FROM r, k), "
    "hb AS (SELECT -sum(nb / total * ln(nb / total)) AS h FROM c, k) SELECT round(CASE WHEN ha.h + hb.h < 1e-15 THEN 1.0 ELSE least(greatest(2 * mi / (ha.h + hb.h), 0), 1) END, 6) AS nmi FROM m, ha, hb",
)
def _(spark, d):
    return rounded(partitions.nmi(_table(spark, d)))


@query(
    "ari",
    f"{_CELLS}, x AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM t) AS both_, (SELECT sum(na * (na - 1) / 2.0) FROM r) AS pa, (SELECT sum(nb * (nb - 1) / 2.0) FROM c) AS pb, (SELECT total * (total - 1) / 2.0 FROM k) AS pn) "
    "SELECT round((both_ - pa * pb / pn) / ((pa + pb) / 2 - pa * pb / pn), 6) AS ari FROM x",
)
def _(spark, d):
    return rounded(partitions.ari(_table(spark, d)))


@query(
    "purity",
    'WITH t AS (SELECT label AS "group", vec_id % 10 AS label, count(*) AS n FROM embeddings GROUP BY ALL), b AS (SELECT "group", max(n) AS top, sum(n) AS n FROM t GROUP BY 1) '
    'SELECT b."group", min(t.label) AS "primary", round(any_value(top / b.n), 6) AS purity, CAST(any_value(b.n) AS BIGINT) AS n FROM b JOIN t ON t."group" = b."group" AND t.n = top GROUP BY 1',
)
def _(spark, d):
    e = L.read(spark, d, "embeddings").select("label", (F.col("vec_id") % 10).alias("bucket"))
    return rounded(partitions.purity(e, "label", "bucket"))


# --- comparisons -----------------------------------------------------------

_PRF = "round(CASE WHEN np = 0 AND nt = 0 THEN 1.0 ELSE coalesce(tp / nullif(np, 0), 0) END, 6) AS precision, round(CASE WHEN np = 0 AND nt = 0 THEN 1.0 ELSE coalesce(tp / nullif(nt, 0), 0) END, 6) AS recall"


@query(
    "prf",
    "WITH t AS (SELECT doc_id FROM labels WHERE quality = 1), p AS (SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE n_chars > 800), s AS (SELECT (SELECT count(*) FROM t) AS nt, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM t SEMI JOIN p USING (doc_id)) AS tp) "
    f"SELECT tp, np AS n_predicted, nt AS n_truth, {_PRF}, round(2.0 * tp / (np + nt), 6) AS f1 FROM s",
)
def _(spark, d):
    labels = L.read(spark, d, "labels")
    predicted = L.read(spark, d, "documents").where("n_chars > 800").join(labels, "doc_id", "left_semi").select("doc_id")
    return rounded(compare.precision_recall(predicted, labels.where("quality = 1").select("doc_id")))


@query(
    "pooled_scores",
    "WITH x AS (SELECT lang, quality = 1 AS t, n_chars > 800 AS p FROM labels JOIN documents USING (doc_id)), s AS (SELECT count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE p) AS np, count(*) FILTER (WHERE t) AS nt FROM x) "
    f"SELECT tp, np AS n_predicted, nt AS n_truth, {_PRF}, round(2.0 * tp / (np + nt), 6) AS f1 FROM s",
)
def _(spark, d):
    x = L.read(spark, d, "labels").join(L.read(spark, d, "documents"), "doc_id")
    t, p = F.col("quality") == 1, F.col("n_chars") > 800
    by_lang = x.groupBy("lang").agg(F.count_if(t & p).alias("tp"), F.count_if(p).alias("n_predicted"), F.count_if(t).alias("n_truth"))
    return rounded(compare.pooled(by_lang))


@query(
    "recall_gate",
    f"WITH o AS ({_SPARSE}), a AS ({L.imports_sql("one_tool")}), b AS ({L.imports_sql("other_tool")}), c AS (SELECT * FROM a INTERSECT SELECT * FROM b), "
    "s AS (SELECT (SELECT count(*) FROM c) AS common, (SELECT count(*) FROM (SELECT * FROM c INTERSECT SELECT * FROM o)) AS found, (SELECT count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM a EXCEPT SELECT * FROM b)) AS extra) "
    "SELECT common, found, common - found AS missing, extra, round(coalesce(found / nullif(common, 0), 0), 6) AS recall, common > 0 AND coalesce(found / nullif(common, 0), 0) >= 0.98 AS passed FROM s",
)
def _(spark, d):
    own, a, b = (L.view(spark, d, L.imports_sql(like)) for like in ("sparse", "one_tool", "other_tool"))
    return rounded(compare.two_oracles(own, a, b))


@query(
    "timing_summary",
    "WITH s AS (SELECT event_type, list_sort(list(value)) AS s, avg(value) AS mean, median(value) AS median FROM events GROUP BY 1) "
    "SELECT event_type, CAST(len(s) AS BIGINT) AS n, round(s[1], 6) AS min, round(median, 6) AS median, round(mean, 4) AS mean, round(s[CAST(floor(len(s) * 0.9) AS INT) + 1], 6) AS p90 FROM s",
)
def _(spark, d):
    found = compare.timing_summary(L.read(spark, d, "events"), "event_type", "value")
    return rounded(found.withColumn("mean", F.round("mean", 4)))


@query(
    "timing_regressions",
    "WITH m AS (SELECT n_nationkey, CAST(floor(c_custkey / 1000) AS BIGINT) % 2 AS half, median(c_acctbal) AS median, count(*) AS nodes FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), "
    "x AS (SELECT a.n_nationkey, a.median AS now, b.median AS was, a.nodes AS an, b.nodes AS bn FROM m a JOIN m b ON a.n_nationkey = b.n_nationkey AND a.half = 0 AND b.half = 1) "
    "SELECT CAST(n_nationkey AS VARCHAR) AS name, round(now / nullif(was, 0) - 1, 6) AS change, abs(now / nullif(was, 0) - 1) > 0.1 AND n_nationkey % 2 = 0 AND was >= 5 AS failed, an <> bn AS drifted FROM x",
)
def _(spark, d):
    c = L.read(spark, d, "customer").withColumn("half", F.floor(F.col("c_custkey") / 1000).cast("long") % 2)
    m = c.groupBy("c_nationkey", "half").agg(F.expr("percentile(c_acctbal, 0.5)").alias("median"), F.count("*").alias("nodes"))
    m = m.withColumn("name", F.col("c_nationkey").cast("string")).withColumn("hard", F.col("c_nationkey") % 2 == 0)
    return rounded(compare.regressions(m.where("half = 0"), m.where("half = 1")))


# --- modules ---------------------------------------------------------------

_M = f"WITH m AS ({L.MODULES}), "
_RATE = (
    "rate AS (SELECT module, CASE WHEN v >= 0 AND v <= 1 AND isfinite(v) THEN v END AS rate FROM (SELECT module, CASE WHEN test_pass_rate LIKE '%!%%' ESCAPE '!' THEN try_cast(replace(test_pass_rate, '%', '') AS DOUBLE) / 100 "
    "WHEN test_pass_rate LIKE '%/%' THEN try_cast(split_part(test_pass_rate, '/', 1) AS DOUBLE) / nullif(try_cast(split_part(test_pass_rate, '/', 2) AS DOUBLE), 0) "
    "WHEN try_cast(test_pass_rate AS DOUBLE) > 1 THEN try_cast(test_pass_rate AS DOUBLE) / 100 ELSE try_cast(test_pass_rate AS DOUBLE) END AS v FROM m)) "
)
_TERMINAL = quoted(TERMINAL)


def _modules(spark, d):
    return L.view(spark, d, L.MODULES)


@query(
    "coverage_stats",
    f"{_M} s AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status LIKE 'degrade%') AS degraded, count(*) FILTER (WHERE status = 'pending') AS pending FROM m) "
    "SELECT *, total - done - degraded - pending AS in_progress, round((done + degraded) / total * 100, 6) AS completion FROM s",
)
def _(spark, d):
    return rounded(quality.coverage_stats(_modules(spark, d)))


@query("pass_rate_parse", f"{_M} {_RATE} SELECT module, round(rate, 6) AS rate FROM rate")
def _(spark, d):
    return rounded(_modules(spark, d).select("module", scalar.pass_rate(F.col("test_pass_rate")).alias("rate")))


@query(
    "behavior_coverage",
    f"{_M} {_RATE} SELECT module, round(rate * (1 - known_differences / (known_differences + 10.0)), 6) AS behavior_coverage FROM m JOIN rate USING (module)",
)
def _(spark, d):
    return rounded(quality.score(_modules(spark, d)).select("module", "behavior_coverage"))


_SCORES = (
    f"{_M} {_RATE}, c AS (SELECT module, status, CASE WHEN status IN ('done', 'testing', 'reviewing') THEN 100.0 WHEN status = 'compile_fixing' THEN 0.0 END AS cp, rate * 100 AS rp FROM m JOIN rate USING (module)), "
    "f AS (SELECT module, status, CASE WHEN cp IS NOT NULL AND rp IS NOT NULL THEN (cp + rp) / 2 END AS final_score FROM c) "
)


@query("quality_scores", f"{_SCORES} SELECT module, round(final_score, 6) AS final_score FROM f")
def _(spark, d):
    return rounded(quality.score(_modules(spark, d)).select("module", "final_score"))


@query(
    "quality_report",
    f"{_SCORES} SELECT count(*) AS total_modules, count(*) FILTER (WHERE status = 'done') AS done_modules, count(*) FILTER (WHERE status LIKE 'degrade%') AS degraded_modules, "
    "round(count(*) FILTER (WHERE status LIKE 'degrade%') / count(*), 6) AS degrade_rate, round(avg(final_score), 6) AS avg_final_score, round(count(final_score) / count(*), 6) AS data_completeness, "
    "coalesce(string_agg(module, ',' ORDER BY module) FILTER (WHERE final_score < CASE WHEN status = 'degrade_ffi' THEN 60 ELSE 80 END), '') AS below_threshold FROM f",
)
def _(spark, d):
    return joined(rounded(quality.quality_report(_modules(spark, d))))


@query("status_predicates", f"{_M} z AS (SELECT 1) SELECT module, status IN ({_TERMINAL}) AS terminal, status LIKE 'degrade%' AS degraded, status IN ('done', 'blocked', 'paused') OR status LIKE 'degrade%' AS needs_force, status IN ('pending', 'translating', 'compile_fixing', 'testing', 'reviewing', 'paused') AS blockable, coalesce(substatus = 'agent_done', false) AS agent_done FROM m")
def _(spark, d):
    s = F.col("status")
    return _modules(spark, d).select(
        "module", state.is_terminal(s).alias("terminal"), state.is_degraded(s).alias("degraded"), state.needs_force(s).alias("needs_force"),
        state.is_blockable(s).alias("blockable"), state.is_agent_done(F.col("substatus")).alias("agent_done"),
    )


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in MODULE_TRANSITIONS)


@query(
    "transition_legality",
    f"{_M} p AS (SELECT DISTINCT a.status AS from_status, b.status AS to_status FROM m a, m b) SELECT from_status, to_status, (from_status, to_status) IN ({_PAIRS}) AS legal FROM p",
)
def _(spark, d):
    s = _modules(spark, d).select("status").distinct()  # eleven statuses
    pairs = s.select(F.col("status").alias("from_status"), F.lit(1).alias("k")).join(s.select(F.col("status").alias("to_status"), F.lit(1).alias("k")), "k")
    return pairs.select("from_status", "to_status", state.can_transition(F.col("from_status"), F.col("to_status")).alias("legal"))


@query(
    "mandatory_reasons",
    f"{_M} z AS (SELECT 1) SELECT module, concat_ws(',', CASE WHEN len(danger) > 0 THEN 'danger_non_empty' END, CASE WHEN danger_provenance <> 'classified' THEN 'danger_provenance_untrusted' END, "
    "CASE WHEN known_differences > 0 THEN 'known_differences_present' END, CASE WHEN substatus NOT IN ('agent_done', 'awaiting_final_review') THEN 'substatus_not_clean' END, "
    "CASE WHEN phase_a_audit_passed = false THEN 'phase_a_audit_failed' END, CASE WHEN composite_kind IS NULL AND (coverage IS NULL OR coverage < 80) THEN 'coverage_below_threshold' END) AS mandatory_reasons FROM m",
)
def _(spark, d):
    return joined(_modules(spark, d).select("module", gate.red_lines().alias("mandatory_reasons")))


_GATE = (
    f"{_M} {_RATE}, g AS (SELECT m.*, rate, len(danger) > 0 OR danger_provenance <> 'classified' OR known_differences > 0 OR coalesce(substatus NOT IN ('agent_done', 'awaiting_final_review'), false) OR coalesce(phase_a_audit_passed = false, false) "
    "OR (composite_kind IS NULL AND (coverage IS NULL OR coverage < 80)) AS red, coalesce(substatus = 'awaiting_final_review', false) AS waits FROM m JOIN rate USING (module)), "
    "j AS (SELECT *, NOT waits AND composite_kind IS NOT NULL AS batch_ok, NOT waits AND coalesce(rate >= 1, false) AND coalesce(phase_a_audit_passed, false) AS headless_ok FROM g) "
)


@query("gate_decision", f"{_GATE} SELECT module, CASE WHEN red THEN 'mandatory_manual' WHEN batch_ok OR headless_ok THEN 'policy_eligible' ELSE 'manual_required' END AS decision FROM j")
def _(spark, d):
    return gate.judge(_modules(spark, d), ["batch_mechanical", "headless_default"]).select("module", "decision")


@query("policy_refusal", f"{_GATE} SELECT module, CASE WHEN red THEN 'mandatory_manual' WHEN NOT headless_ok THEN 'policy_conditions_unmet' ELSE 'missing_attestations' END AS refusal FROM j")
def _(spark, d):
    judged = gate.judge(_modules(spark, d), ["headless_default"])
    return judged.select("module", gate.policy_refusal("headless_default", ["tests_passed"], ["headless_default"]).alias("refusal"))


_KEYS = (
    "names AS (SELECT module AS name FROM m UNION SELECT unnest(member_files) FROM m UNION SELECT 'nobody'), hosts AS (SELECT file, min(module) AS host, count(*) AS n FROM (SELECT DISTINCT unnest(member_files) AS file, module FROM m) GROUP BY file), "
    "k AS (SELECT name, CASE WHEN m.module IS NOT NULL OR h.n = 1 THEN 'ok' WHEN h.n > 1 THEN 'ambiguous' ELSE 'not_found' END AS code, CASE WHEN m.module IS NOT NULL THEN m.module WHEN h.n = 1 THEN h.host END AS module FROM names LEFT JOIN m ON m.module = name LEFT JOIN hosts h ON h.file = name) "
)


@query("canonical_key", f"{_M} {_KEYS} SELECT name, code, module FROM k")
def _(spark, d):
    m = _modules(spark, d)
    names = m.select(F.col("module").alias("name")).unionByName(m.select(F.explode("member_files").alias("name"))).unionByName(spark.sql("SELECT 'nobody' AS name")).distinct()
    return state.canonical(m, names).select("name", "code", "module")


_REFS = (
    f"{_M} hosts AS (SELECT file, min(module) AS host, count(*) AS n FROM (SELECT DISTINCT unnest(member_files) AS file, module FROM m) GROUP BY file), b AS (SELECT module, unnest(blocked_by) AS ref FROM m), "
    "r AS (SELECT b.module, ref, CASE WHEN k.module IS NOT NULL OR h.n = 1 THEN 'resolved' WHEN h.n > 1 THEN 'ambiguous' ELSE 'missing' END AS resolution, coalesce(k.module, CASE WHEN h.n = 1 THEN h.host END) AS target FROM b LEFT JOIN m k ON k.module = ref LEFT JOIN hosts h ON h.file = ref) "
)


@query("blocked_references", f"{_REFS} SELECT module, ref, resolution, target FROM r")
def _(spark, d):
    return state.references(_modules(spark, d)).select("module", "ref", "resolution", "target")


@query(
    "blocked_check",
    f"{_REFS}, t AS (SELECT r.module, ref, coalesce(m.status IN ({_TERMINAL}), false) AS ok FROM r LEFT JOIN m ON m.module = r.target) SELECT m.module, coalesce(string_agg(DISTINCT ref, ',' ORDER BY ref) FILTER (WHERE ok), '') AS resolved, "
    "coalesce(string_agg(DISTINCT ref, ',' ORDER BY ref) FILTER (WHERE NOT ok), '') AS unresolved, count(*) FILTER (WHERE NOT ok) = 0 AS ready FROM m LEFT JOIN t ON t.module = m.module WHERE status = 'blocked' GROUP BY m.module",
)
def _(spark, d):
    return joined(state.blocked_check(_modules(spark, d)))


@query("ghost_refs", f"{_REFS} SELECT DISTINCT module, ref FROM r WHERE resolution = 'missing'")
def _(spark, d):
    return state.ghosts(_modules(spark, d))


@query("ghost_repair", f"{_REFS} SELECT m.module, string_agg(ref, ',' ORDER BY ref) FILTER (WHERE resolution <> 'missing') AS blocked_by FROM m LEFT JOIN r ON r.module = m.module GROUP BY m.module")
def _(spark, d):
    fixed = state.repair_ghosts(_modules(spark, d)).modules
    return joined(fixed.select("module", F.array_sort("blocked_by").alias("blocked_by")))


@query("auto_unblock")
def _(spark, d):
    return state.auto_unblock(_modules(spark, d)).modules.select("module", "status")


@query("resume_buckets", f"{_M} b AS (SELECT module, CASE WHEN status = 'reviewing' AND substatus = 'awaiting_final_review' THEN 'awaiting_approval' WHEN status IN ('translating', 'compile_fixing', 'testing', 'reviewing') THEN 'interrupted' WHEN status = 'paused' THEN 'awaiting_decision' WHEN status = 'pending' THEN 'next' WHEN status IN ('blocked', 'done') THEN status ELSE 'degraded' END AS bucket FROM m) SELECT bucket, count(*) AS n, string_agg(module, ',' ORDER BY module) AS modules FROM b GROUP BY bucket")
def _(spark, d):
    return joined(state.resume_plan(_modules(spark, d)))


@query("sprint_advance", f"{_M} s AS (SELECT count(*) FILTER (WHERE sprint = 2) AS own, count(*) FILTER (WHERE sprint = 2 AND status IN ({_TERMINAL})) AS closed, count(*) FILTER (WHERE sprint = 3) AS nxt FROM m) SELECT CASE WHEN closed < own THEN 'not_ready' WHEN nxt = 0 THEN 'all_completed' ELSE 'advanced' END AS outcome, CAST(CASE WHEN closed = own AND nxt > 0 THEN 3 ELSE 2 END AS INT) AS sprint FROM s")
def _(spark, d):
    return state.advance_sprint(_modules(spark, d), 2).select("outcome", "sprint")


@query("graduate_report", f"{_M} z AS (SELECT 1) SELECT count(*) FILTER (WHERE status NOT IN ({_TERMINAL})) = 0 AS ready, count(*) AS total, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status LIKE 'degrade%') AS degraded, array_to_string(list_sort(list(module) FILTER (WHERE status NOT IN ({_TERMINAL})))[1:5], ',') AS open FROM m")
def _(spark, d):
    return joined(state.graduate_report(_modules(spark, d)))


_TO = "CASE WHEN status IN ('pending', 'paused') OR status LIKE 'degrade%' THEN 'translating' WHEN status = 'blocked' THEN 'testing' ELSE 'reviewing' END"


@query(
    "module_transitions",
    f"{_M} c AS (SELECT *, {_TO} AS to_ FROM m), x AS (SELECT *, CASE WHEN (status, to_) NOT IN ({_PAIRS}) THEN 'invalid_transition' WHEN status LIKE 'degrade%' THEN 'force_required' WHEN status = 'blocked' AND pre_blocked_status <> to_ THEN 'invalid_transition' ELSE 'ok' END AS code FROM c) "
    "SELECT module, code, CASE WHEN code = 'ok' THEN to_ ELSE status END AS status FROM x",
)
def _(spark, d):
    m = _modules(spark, d)
    commands = m.select(
        F.col("module").alias("name"), F.expr(_TO).alias("to_status"), F.lit(None).cast("string").alias("substatus"),
        F.lit("r").alias("reason"), F.lit(False).alias("force"),
    )
    change = state.transition(m, commands)
    return change.outcomes.select("module", "code").join(change.modules.select("module", "status"), "module")


@query(
    "metrics_recorded",
    f"{_M} z AS (SELECT 1) SELECT module, CASE WHEN status IN ('translating', 'compile_fixing', 'testing', 'reviewing') THEN 'ok' ELSE 'not_running' END AS code, CASE WHEN status IN ('translating', 'compile_fixing', 'testing', 'reviewing') THEN '90%' ELSE test_pass_rate END AS test_pass_rate, coverage FROM m",
)
def _(spark, d):
    m = _modules(spark, d)
    commands = m.select(
        F.col("module").alias("name"), F.lit("90%").alias("test_pass_rate"), F.lit(None).cast("int").alias("known_differences"),
        F.lit(None).cast("int").alias("coverage"), F.lit(None).cast("boolean").alias("phase_a_audit_passed"),
    )
    change = state.record_metrics(m, commands)
    return change.outcomes.select("module", "code").join(change.modules.select("module", "test_pass_rate", "coverage"), "module")


@query(
    "module_reset",
    f"{_M} x AS (SELECT *, CASE WHEN status IN ('done', 'blocked', 'paused') OR status LIKE 'degrade%' THEN 'force_required' WHEN status IN ('translating', 'pending') AND known_differences = 0 AND substatus IS NULL AND phase_a_audit_passed IS NULL AND test_pass_rate IS NULL AND coverage IS NULL AND blocked_by IS NULL AND pre_blocked_status IS NULL THEN 'noop' ELSE 'ok' END AS code FROM m) "
    "SELECT module, code, CASE WHEN code <> 'ok' OR status = 'pending' THEN status ELSE 'translating' END AS status, CASE WHEN code = 'ok' THEN NULL ELSE coverage END AS coverage FROM x",
)
def _(spark, d):
    m = _modules(spark, d)
    change = state.reset(m, m.select(F.col("module").alias("name"), F.lit(False).alias("force")))
    return change.outcomes.select("module", "code").join(change.modules.select("module", "status", "coverage"), "module")


@query("module_recover", f"{_M} z AS (SELECT 1) SELECT module, CASE WHEN status = 'paused' THEN 'noop' WHEN status IN ('translating', 'compile_fixing', 'testing', 'reviewing') THEN 'ok' ELSE 'not_stalled' END AS code, CASE WHEN status IN ('translating', 'compile_fixing', 'testing', 'reviewing') THEN 'paused' ELSE status END AS status FROM m")
def _(spark, d):
    m = _modules(spark, d)
    commands = m.select(F.col("module").alias("name"), F.lit("skip").alias("policy"), F.lit(None).cast("string").alias("reason"))
    change = state.recover(m, commands)
    return change.outcomes.select("module", "code").join(change.modules.select("module", "status"), "module")


@query("human_approval", f"{_GATE} SELECT module, CASE WHEN status <> 'reviewing' THEN 'not_reviewing' WHEN NOT waits THEN 'not_awaiting_final_review' WHEN red THEN 'mandatory_override_requires_reason' ELSE 'ok' END AS code FROM j")
def _(spark, d):
    m = _modules(spark, d)
    return state.approve(m, m.select(F.col("module").alias("name"), F.lit(None).cast("string").alias("reason")), []).outcomes.select("module", "code")


@query("batch_done", f"{_GATE} SELECT module, CASE WHEN waits THEN 'awaiting_final_review' WHEN coalesce(substatus <> 'agent_done', true) THEN 'not_agent_done' WHEN status <> 'reviewing' THEN 'not_reviewing' WHEN red THEN 'mandatory_manual' WHEN NOT batch_ok THEN 'policy_conditions_unmet' ELSE 'ok' END AS code FROM j")
def _(spark, d):
    m = _modules(spark, d)
    attested = gate.required_attestations("batch_mechanical")
    change = state.batch_done(m, m.select(F.col("module").alias("name")), ["batch_mechanical"], "batch_mechanical", attested)
    return change.outcomes.select("module", "code")


@query("double_members", f"{_M} f AS (SELECT DISTINCT module, unnest(member_files) AS file FROM m) SELECT file, string_agg(module, ',' ORDER BY module) AS modules FROM f GROUP BY file HAVING count(*) > 1")
def _(spark, d):
    return joined(validate.double_members(_modules(spark, d)))


@query("roll_up", f"{_M} f AS (SELECT module, unnest(member_files) AS file FROM m), a AS (SELECT f.file, max(CASE tier WHEN 'full' THEN 3 WHEN 'standard' THEN 2 ELSE 1 END) AS r FROM f JOIN m USING (module) GROUP BY f.file) SELECT f.module, max(r) AS rank FROM f JOIN a USING (file) GROUP BY f.module")
def _(spark, d):
    m = _modules(spark, d)
    own = m.select("module", F.explode("member_files").alias("file"))
    rank = {"full": 3, "standard": 2, "trivial": 1}
    best = F.max(F.when(F.col("tier") == "full", 3).when(F.col("tier") == "standard", 2).otherwise(1))
    named = F.when(F.col("r") == 3, "full").when(F.col("r") == 2, "standard").otherwise("trivial")
    files = own.join(m.select("module", "tier"), "module").groupBy("file").agg(best.alias("r")).select(
        "file", named.alias("tier"), F.array().cast("array<string>").alias("danger"), F.lit(True).alias("classified")
    )
    out = quality.roll_up(files, own)
    return out.select("module", F.coalesce(*[F.when(F.col("tier") == k, F.lit(v)) for k, v in rank.items()]).alias("rank"))


@query("validation_findings")
def _(spark, d):
    m = _modules(spark, d)
    attempts = spark.createDataFrame([("m5", 0, "approved:human")], "module string, seq int, result string")
    history = spark.sql("SELECT 0 AS seq, 'init' AS state, timestamp'2024-01-01' AS entered_at, timestamp'2024-01-02' AS exited_at UNION ALL SELECT 1, 'plan', timestamp'2024-01-02', NULL")
    return validate.validate_state(m, attempts, history, "plan")


# --- histories -------------------------------------------------------------

_PROJECT = ", ".join(f"('{a}', '{b}')" for a, b in PROJECT_TRANSITIONS)
_H = f"WITH h AS ({L.HISTORY}), "


@query(
    "history_violations",
    f"{_H} s AS (SELECT user_id, event_id, state, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM h) SELECT user_id, event_id, before, state FROM s WHERE before IS NOT NULL AND (before, state) NOT IN ({_PROJECT})",
)
def _(spark, d):
    steps = validate.history_steps(L.view(spark, d, L.HISTORY), ["user_id"], ["ts", "event_id"], "state")
    return steps.where("not legal").select("user_id", "event_id", "before", "state")


@query("history_exits", f"{_H} z AS (SELECT 1) SELECT user_id, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS exited_at FROM h")
def _(spark, d):
    return validate.history_exits(L.view(spark, d, L.HISTORY), ["user_id"], ["ts", "event_id"], "ts").select("user_id", "event_id", "exited_at")


@query("history_ends", f"{_H} z AS (SELECT 1) SELECT user_id, min_by(state, (ts, event_id)) AS first, max_by(state, (ts, event_id)) AS last, count(*) AS n FROM h GROUP BY user_id")
def _(spark, d):
    return validate.history_ends(L.view(spark, d, L.HISTORY), ["user_id"], ["ts", "event_id"], "state")


@query("first_occurrences", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS duplicate FROM events")
def _(spark, d):
    e = L.read(spark, d, "events").withColumn("key", F.concat_ws("|", "user_id", "event_type"))
    return validate.first_occurrences(e, "key", "event_id").select("event_id", "duplicate")


@query("turn_audit", "SELECT conv_id AS module FROM conversations WHERE starts_with(text, 'T') GROUP BY conv_id")
def _(spark, d):
    log = L.read(spark, d, "conversations").select(
        F.col("conv_id").alias("module"), F.when(F.col("text").startswith("T"), "approved:human").otherwise("note").alias("result")
    )
    return validate.approved(log)


@query(
    "rule_consistency",
    "WITH reg AS (SELECT DISTINCT p_type AS rule, length(p_type) AS version FROM part), t AS (SELECT p_brand AS language, p_type AS rule, min(length(p_type) + p_size % 2) AS version FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL "
    "UNION ALL SELECT DISTINCT p_brand, 'EXTRA', 1 FROM part WHERE p_brand = 'Brand#1'), w AS (SELECT * FROM (SELECT DISTINCT language FROM t), reg) "
    "SELECT coalesce(w.language, t.language) AS language, coalesce(w.rule, t.rule) AS rule, CASE WHEN t.version IS NULL THEN 'missing' WHEN w.version IS NULL THEN 'unknown' ELSE 'mismatch' END AS issue FROM w FULL OUTER JOIN t ON w.language = t.language AND w.rule = t.rule "
    "WHERE t.version IS NULL OR w.version IS NULL OR t.version <> w.version",
)
def _(spark, d):
    p = L.read(spark, d, "part")
    registry = p.select(F.col("p_type").alias("rule"), F.length("p_type").alias("version")).distinct()
    t = p.where("p_partkey % 3 = 0").groupBy(F.col("p_brand").alias("language"), F.col("p_type").alias("rule")).agg(F.min(F.length("p_type") + F.col("p_size") % 2).alias("version"))
    t = t.unionByName(p.where("p_brand = 'Brand#1'").select(F.col("p_brand").alias("language"), F.lit("EXTRA").alias("rule"), F.lit(1).alias("version")).distinct())
    return validate.rule_versions(registry, t).select("language", "rule", "issue")


# --- resolution and export -------------------------------------------------

_HREF = 'href="/([^"#?]*)"'


@query(
    "link_resolution",
    f"WITH s AS (SELECT page_id AS source, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS specifier FROM pages), p AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1) AS path FROM pages UNION SELECT DISTINCT lang || '.html' FROM documents UNION SELECT DISTINCT split_part(text, ' ', 1) || '/index.html' FROM documents), "
    "c AS (SELECT DISTINCT source, specifier, k AS rank, specifier || ['', '.html', '/index.html'][k] AS candidate FROM s, (SELECT unnest([1, 2, 3]) AS k)) "
    "SELECT source, specifier, min_by(candidate, rank) AS target FROM c WHERE candidate IN (SELECT path FROM p) GROUP BY source, specifier",
)
def _(spark, d):
    pages, docs = L.read(spark, d, "pages"), L.read(spark, d, "documents")
    s = pages.select(F.col("page_id").alias("source"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("specifier"))
    paths = pages.select(F.regexp_extract("url", "^https?://[^/]*/([^?#]*)", 1).alias("path"))
    paths = paths.unionByName(docs.select(F.concat("lang", F.lit(".html")).alias("path")).distinct())
    paths = paths.unionByName(docs.select(F.concat(F.split("text", " ")[0], F.lit("/index.html")).alias("path")).distinct())
    return resolve.links(s, paths)


@query(
    "export_edges_dot",
    f"SELECT format('  \"{{}}\" -> \"{{}}\" [label=\"{{}}\"];', source, target, edge_type) AS line FROM ({L.EDGES}) GROUP BY source, target, edge_type",
)
def _(spark, d):
    from graphloom.sources import export

    return export.dot_edges(graph(spark, d).edges)


@query("export_mermaid", f"SELECT DISTINCT concat('  ', regexp_replace(source, '[^A-Za-z0-9_]', '_', 'g'), ' -->|', edge_type, '| ', regexp_replace(target, '[^A-Za-z0-9_]', '_', 'g')) AS line FROM ({L.EDGES})")
def _(spark, d):
    from graphloom.sources import export

    return export.mermaid_edges(graph(spark, d).edges).distinct()


@query(
    "weighted_mq",
    f"WITH e AS ({L.imports_sql("dense", distinct=False)}), x AS (SELECT a.p_size % 4 AS a, b.p_size % 4 AS b FROM e JOIN part a ON source = a.p_partkey JOIN part b ON target = b.p_partkey), y AS (SELECT CASE WHEN a < 3 THEN a END AS a, CASE WHEN b < 3 THEN b END AS b FROM x), "
    "s AS (SELECT CAST(count(*) FILTER (WHERE a = b) AS BIGINT) AS i, CAST(sum(CASE WHEN a = b THEN 1 ELSE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT END) AS BIGINT) AS edges FROM y) SELECT round(i / edges, 6) AS mq, edges FROM s",
)
def _(spark, d):
    e = L.view(spark, d, L.imports_sql("dense", distinct=False)).withColumn("edge_type", F.lit("imports"))
    assigned = L.read(spark, d, "part").where("p_size % 4 < 3").select(F.lit(0).alias("sample"), F.col("p_partkey").alias("file"), (F.col("p_size") % 4).cast("long").alias("batch"))
    return rounded(decompose.weighted_cohesion(decompose.numbered_imports(e), assigned).select("mq", "edges"))


# --- sequential kernels ----------------------------------------------------


def _decomposed(spark, d):
    from graphloom.session import cut

    files, e = parts(spark, d, "sparse")
    name = lambda c: F.concat(F.lit("file:b"), (F.col(c) % 20).cast("string"), F.lit("/p"), F.col(c).cast("string"))
    nodes = cut(files.select(name("id").alias("id")))
    edges = cut(e.select(name("source").alias("source"), name("target").alias("target"), F.lit("imports").alias("edge_type")))
    found = cut(scc.components(nodes, edges))
    sizes = files.select(name("id").alias("id"), (F.col("id") % 3000).alias("self_size"), (F.col("id") % 500).alias("footprint"))
    return cut(decompose.plan_rows(scc.groups(found, edges), edges, sizes)), edges


@query("decompose_plan")
def _(spark, d):
    return _decomposed(spark, d)[0]


@query("cohesion")
def _(spark, d):
    plan, edges = _decomposed(spark, d)
    return spark.createDataFrame([decompose.cohesion_rows(plan, edges)])


@query("louvain")
def _(spark, d):
    files, e = parts(spark, d, "sparse")
    text = e.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
    return community.communities(files.select(F.col("id").cast("string").alias("id")), text)
