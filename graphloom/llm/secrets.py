"""Secret scans over an incremental ledger of blobs, in DataFrame expressions only.

Every version of a text is addressed by its SHA-256.  A ledger holds, for each
(blob, rule version) that was scanned, the spans found; a scan looks only at
pairs the ledger does not have, once per blob however many paths carry it, and
joins the findings back to all paths.

Places of matches come from the text split by the same pattern: the running
sums of the lengths of pieces and matches are the ends in code points.

Edge cases: a null text is an empty blob, without findings.  Rows that repeat
a doc_id are returned each; a null doc_id is returned.  An empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import documents, id_text, table

RULE_VERSION = "2"
ASSIGN = (
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
    r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
)
#: kind, pattern, what a match must be to count; the first three are the base, in the order of the contract
RULES = (
    ("assign", ASSIGN, r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}$"""),
    # runs are maximal, so asking for their length in the pattern gives the same spans as dropping short ones
    ("access", r"AKIA[A-Z0-9]{14,}", ""),
    ("hex", r"[0-9a-f]{16,}", ""),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", ""),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ""),
    ("hosting_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})", ""),
    ("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", ""),
    ("url_password", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:@/]+:[^\s:@/]+@", ""),
)
BASE = ("assign", "access", "hex")
SPAN = "struct<start:int,rank:int,kind:string,stop:int>"


STEP = "array<struct<rank:int,at:int,piece:int,size:int,good:boolean>>"


def _steps(rank: int, pattern: str, test: str):
    """For each match of one rule in the column text: its place among them, the length of the piece before it, and its own."""
    pieces = F.split("text", pattern, -1)
    matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    good = (lambda m: m.rlike(test)) if test else (lambda m: F.lit(True))
    steps = F.transform(
        F.arrays_zip(pieces.alias("p"), matches.alias("m")),
        lambda x, i: F.struct(
            F.lit(rank).alias("rank"), i.alias("at"), F.length(x["p"]).alias("piece"), F.length(x["m"]).alias("size"), good(x["m"]).alias("good")
        ),
    )
    steps = F.filter(steps, lambda x: x["size"].isNotNull())  # the piece after the last match
    return F.when(F.col("text").rlike(pattern), steps).otherwise(F.array().cast(STEP))


def scan(blobs: DataFrame) -> DataFrame:
    """blob, rules, found: all spans in each blob's whole text, by start, then kind as listed.

    The running sums that give the places are a window over the matches of a
    blob and rule, linear in their number; it needs no shuffle of its own where
    blobs are dealt out by their address.
    """
    kinds = F.array(*[F.lit(kind) for kind, *_ in RULES])
    steps = F.concat(*[_steps(k, pattern, test) for k, (_, pattern, test) in enumerate(RULES)])
    rows = blobs.select("blob", F.explode_outer(steps).alias("x")).select("blob", "x.*")
    until = Window.partitionBy("blob", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("stop", F.sum(F.col("piece") + F.col("size")).over(until).cast("int"))
    span = F.struct(
        (F.col("stop") - F.col("size")).alias("start"), "rank", F.get(kinds, F.col("rank")).alias("kind"), "stop"
    )
    found = placed.groupBy("blob").agg(F.array_sort(F.collect_list(F.when(F.col("good"), span))).alias("found"))
    return found.select("blob", F.lit(RULE_VERSION).alias("rules"), F.col("found").cast(f"array<{SPAN}>").alias("found"))


def versions(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return id_text(docs).select("doc_id", F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))


def update(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger with every blob of docs under the current rules; blobs it has are not scanned again."""
    seen = versions(docs)
    if ledger is not None:
        known = ledger.where(F.col("rules") == RULE_VERSION).select("blob")
        seen = seen.join(known, "blob", "left_anti")
    unseen = seen.groupBy("blob").agg(F.any_value("text").alias("text"))  # copies meet before the shuffle
    fresh = scan(unseen)
    return fresh if ledger is None else ledger.unionByName(fresh)


def findings(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """doc_id, found: the spans of the current rules for every path, none if there are none."""
    own = ledger.where((F.col("rules") == RULE_VERSION) & (F.size("found") > 0)).select("blob", "found")
    return (
        versions(docs)
        .select("doc_id", "blob")
        .join(own, "blob", "left")
        .select("doc_id", F.coalesce("found", F.array().cast(f"array<{SPAN}>")).alias("found"))
    )


def _joined(found):
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def _of_rank(k: int):
    return lambda x: x["rank"] == k


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = findings(docs, table(update(docs)))
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    return out.select(
        "doc_id",
        *[
            F.size(F.filter("found", _of_rank(k))).cast("long").alias(f"n_{kind}")
            for k, kind in enumerate(BASE)
        ],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )
