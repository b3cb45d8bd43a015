"""Views that present the relational tables as graphs, snapshots, modules and histories.

Each lens is one SQL text, used by Spark and by DuckDB alike; ``{table}`` names
a table and ``{array}`` the function that makes an array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


#: When parts of consecutive lines of an order import each other.  All grow with the lines: about
#: half an import a part, one and a half (with cycles of many parts), and two and a half.
LIKE = {
    "sparse": "a.l_discount = b.l_discount AND a.l_returnflag = b.l_returnflag",
    "cyclic": "a.l_discount = b.l_discount",
    "dense": "a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus",
    # what two other tools take for imports
    "one_tool": "a.l_discount = b.l_discount AND (a.l_returnflag = b.l_returnflag OR a.l_tax = b.l_tax)",
    "other_tool": "a.l_discount = b.l_discount AND (a.l_returnflag = b.l_returnflag OR a.l_linestatus = b.l_linestatus)",
}


def imports_sql(like: str, dag: bool = False, distinct: bool = True) -> str:
    """Parts of consecutive lines of an order, as files that import each other, if the lines are alike."""
    s, t = ("greatest(a.l_partkey, b.l_partkey)", "least(a.l_partkey, b.l_partkey)") if dag else ("a.l_partkey", "b.l_partkey")
    loop = " WHERE a.l_partkey <> b.l_partkey" if dag else ""
    return (
        f"SELECT {'DISTINCT ' if distinct else ''}{s} AS source, {t} AS target FROM {{lineitem}} a JOIN {{lineitem}} b "
        f"ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND {LIKE[like]}{loop}"
    )


PART_FILES = "SELECT p_partkey AS id FROM {part}"

#: A typed graph: the geography contains its customers' orders, and parts import parts.
NODES = (
    "SELECT concat('package:', r_name) AS id, 'package' AS node_type FROM {region} "
    "UNION ALL SELECT concat('module:', n_name), 'module' FROM {nation} "
    "UNION ALL SELECT concat('class:', CAST(c_custkey AS STRING)), 'class' FROM {customer} "
    "UNION ALL SELECT concat('file:', CAST(p_partkey AS STRING)), 'file' FROM {part}"
)
EDGES = (
    "SELECT concat('package:', r_name) AS source, concat('module:', n_name) AS target, 'contains' AS edge_type "
    "FROM {nation} JOIN {region} ON n_regionkey = r_regionkey "
    "UNION ALL SELECT concat('module:', n_name), concat('class:', CAST(c_custkey AS STRING)), 'contains' "
    "FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey "
    "UNION ALL SELECT concat('file:', CAST(source AS STRING)), concat('file:', CAST(target AS STRING)), 'imports' "
    f"FROM ({imports_sql('dense', distinct=False)}) i"
)

SYMBOLS = (
    "SELECT concat('function:', CAST(l_partkey AS STRING), ':f', CAST(l_linenumber AS STRING)) AS id, 'function' AS node_type, "
    "CAST(l_partkey AS STRING) AS file_path, concat('f', CAST(l_linenumber AS STRING)) AS name, "
    "max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 AS is_exported, "
    "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE concat('fn f', CAST(l_linenumber AS STRING), '(part: ', CAST(l_partkey AS STRING), ') é') END AS signature "
    "FROM {lineitem} GROUP BY l_partkey, l_linenumber"
)
#: Functions named by customers, one an order: a customer with a single order names it alone.
NAMED = (
    "SELECT concat('function:', CAST(o_orderkey AS STRING), ':f', CAST(o_custkey AS STRING)) AS id, 'function' AS node_type, "
    "concat('f', CAST(o_custkey AS STRING)) AS name FROM {orders}"
)
USAGE = (
    "SELECT concat('file:', CAST(a.l_partkey AS STRING)) AS source, concat('file:', CAST(b.l_partkey AS STRING)) AS target, "
    "CASE WHEN b.l_linestatus = 'O' AND b.l_quantity > 45 THEN NULL ELSE concat('f', CAST(b.l_linenumber AS STRING)) END AS symbol "
    "FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 "
    f"AND {LIKE['dense']}"
)

_DOC = "concat('doc', CAST(doc_id AS STRING))"
_STRUCTURE = "sha256h(concat(split_part({t}, chr(10), 1), coalesce(lang, '')))"
_NEW = "CASE WHEN doc_id % 10 = 0 THEN concat(text, ' appended') WHEN doc_id % 10 = 5 THEN concat('changed ', text) ELSE text END"


def snapshot_sql(new: bool) -> str:
    text = _NEW if new else "text"
    keep = "doc_id % 17 <> 0" if new else "doc_id % 19 <> 0"
    return (
        f"SELECT {_DOC} AS file_path, sha256h({text}) AS content_hash, {_STRUCTURE.replace('{t}', text)} AS structure_hash "
        f"FROM {{documents}} WHERE {keep}"
    )


_STATUS = (
    "pending", "translating", "compile_fixing", "testing", "reviewing", "done", "paused", "blocked", "degrade_ffi", "degrade_manual",
    "degrade_skip",
)
_CASE = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STATUS))
MODULES = (
    "SELECT concat('m', CAST(k AS STRING)) AS module, "
    f"CASE k % 11 {_CASE} END AS status, "
    "CASE k % 5 WHEN 1 THEN 'agent_done' WHEN 2 THEN 'awaiting_final_review' WHEN 3 THEN 'phase_b_optimization_in_progress' END AS substatus, "
    "CAST(k % 4 + 1 AS INT) AS sprint, "
    "CASE k % 9 WHEN 1 THEN '85%' WHEN 2 THEN '0.85' WHEN 3 THEN '85' WHEN 4 THEN '85/100' WHEN 5 THEN '100%' WHEN 6 THEN '1/0' "
    "WHEN 7 THEN 'NaN' WHEN 8 THEN '150%' END AS test_pass_rate, "
    "CAST(CASE WHEN k % 6 = 0 THEN NULL ELSE 60 + k % 40 END AS INT) AS coverage, "
    "CAST(k % 3 AS INT) AS known_differences, "
    "CASE k % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'standard' ELSE 'trivial' END AS tier, "
    "CAST(NULL AS STRING) AS phase_a_version, "
    "CASE k % 4 WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true END AS phase_a_audit_passed, "
    "CASE WHEN k % 11 = 7 THEN {array}(concat('m', CAST((k * 7 + 3) % 100 AS STRING)), concat('f', CAST((k * 5) % 100 AS STRING)), "
    "CASE WHEN k % 2 = 0 THEN concat('ghost', CAST(k AS STRING)) ELSE concat('g', CAST(k % 40 AS STRING)) END) END AS blocked_by, "
    "CASE WHEN k % 11 = 7 AND k % 3 > 0 THEN 'testing' END AS pre_blocked_status, "
    "{array}(concat('f', CAST(k AS STRING)), concat('g', CAST(CAST(floor(k / 2) AS INT) AS STRING))) AS member_files, "
    "CASE WHEN k % 3 = 0 THEN 'batch' END AS composite_kind, "
    "CASE WHEN k % 4 = 0 THEN {array}('concurrency') ELSE {empty} END AS danger, "
    "CASE k % 5 WHEN 0 THEN 'unclassified' WHEN 1 THEN 'partially_classified' ELSE 'classified' END AS danger_provenance "
    "FROM (SELECT CAST(s_suppkey AS INT) AS k FROM {supplier}) s"
)
HISTORY = (
    "SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'init' WHEN 'view' THEN 'profile' WHEN 'click' THEN 'plan' "
    "WHEN 'purchase' THEN 'scaffold' ELSE 'sprint_loop' END AS state FROM {events}"
)

#: Lines of documents as source lines of a language.
SOURCES = "SELECT concat('doc', CAST(doc_id AS STRING)) AS path, coalesce(lang, 'none') AS language, text AS content FROM {documents}"


def spark_sql(sql: str) -> str:
    return (
        sql.replace("{array}", "array")
        .replace("{empty}", "CAST(array() AS ARRAY<STRING>)")
        .replace("sha256h(", "sha2_256(")
        .replace("chr(10)", "char(10)")
    )


def duck_sql(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    return sql.replace("{array}", "list_value").replace("{empty}", "CAST([] AS VARCHAR[])").replace("sha256h(", "sha256(").replace("STRING", "VARCHAR")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The lens over the tables of a folder."""
    used = {t: read(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql}
    text = _sha(spark_sql(sql))
    return spark.sql(text, **used)


def _sha(sql: str) -> str:
    """sha2_256(x) as sha2(x, 256), with x up to its closing bracket."""
    mark = "sha2_256("
    while mark in sql:
        at = sql.index(mark)
        depth, end = 1, at + len(mark)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}sha2({sql[at + len(mark) : end - 1]}, 256){sql[end:]}"
    return sql
