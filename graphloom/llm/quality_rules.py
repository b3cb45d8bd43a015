"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule votes good (1), bad (-1) or abstains (0) on the statistics of a whole
text.  Expectation-maximisation over the counts of vote patterns (at most
3**rules rows, whatever the corpus) estimates how reliable each rule is, and a
document is kept when its posterior probability of being good is at least one
half, instead of when every rule passes.

Edge cases: a null text is an empty one, with no words, and fails.  Rows that
repeat a doc_id are judged each; a null doc_id is returned.  An empty table
gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import documents, id_text, table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
#: letters with one closing mark at most
PLAIN = r"^\p{L}+[.,;:!?]?$"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50



def _rate(part: str, whole: str) -> Column:
    return F.col(part) / F.nullif(F.col(whole).cast("double"), F.lit(0.0))


#: name, value, bad from or below, good test; neither (or no value): the rule abstains
RULES = (
    ("length", lambda: F.col("n_words").cast("double"), lambda r: r < 20, lambda r: r >= 50),
    ("symbols", lambda: _rate("n_symbols", "n_words"), lambda r: r > 0.25, lambda r: r < 0.02),
    ("marks", lambda: _rate("n_marks", "n_words"), lambda r: r > 0.5, lambda r: r < 0.25),
    ("capitals", lambda: _rate("n_capitals", "n_letters"), lambda r: r > 0.5, lambda r: r < 0.2),
    ("repeats", lambda: _rate("n_repeat_words", "n_words"), lambda r: r > 0.4, lambda r: r < 0.1),
    ("lines", lambda: _rate("n_dup_lines", "n_lines"), lambda r: r > 0.6, lambda r: r < 0.1),
    ("word_size", lambda: _rate("word_chars", "n_words"), lambda r: (r < 2) | (r > 20), lambda r: r.between(2.5, 12)),
    ("letters", lambda: _rate("n_letters", "word_chars"), lambda r: r < 0.8, lambda r: r > 0.93),
    ("plain", lambda: _rate("n_plain", "n_words"), lambda r: r < 0.6, lambda r: r > 0.85),
    ("variety", lambda: _rate("n_distinct_words", "n_words"), lambda r: r < 0.1, lambda r: r > 0.3),
)
ROUNDS = 50
SMOOTH = 1.0
PRIOR = 0.1
BAD_RIGHT = 0.98


def _long(c: Column) -> Column:
    return c.cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """Counts over each whole text: one row per row of docs.

    Repeated 3-word windows are found within the row: the hashes of the windows
    are sorted with their places, equal neighbours are repeats, and the words
    that the repeats cover are summed over their sorted places.
    """
    text = F.coalesce("text", F.lit(""))
    d = id_text(docs).select("doc_id", text.alias("text"))
    d = d.select(
        "doc_id",
        F.array_remove(F.split("text", SPACE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^!?.]+", "")).alias("n_marks"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).alias("n_capitals"),
        F.length(F.regexp_replace("text", r"\P{L}+", "")).alias("n_letters"),
    )
    d = d.select(
        "*",
        F.size("words").alias("n"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    window = lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2))
    d = d.select(
        "*",
        F.when(
            F.col("n") > 3,
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), F.greatest(F.col("n") - 3, F.lit(0))),
                    lambda i: F.struct(window(i).alias("w"), i.alias("i")),
                )
            ),
        ).alias("ranked"),
    )
    same = lambda x, i: (x["w"] == F.get("ranked", i - 1)["w"]) | (x["w"] == F.get("ranked", i + 1)["w"])
    d = d.select("*", F.filter("ranked", lambda x, i: F.coalesce(same(x, i), F.lit(False)))["i"].alias("again"))
    d = d.withColumn("again", F.sort_array("again"))
    covered = F.aggregate(
        "again",
        F.struct(F.lit(0).alias("c"), F.lit(-3).alias("p")),
        lambda s, i: F.struct((s["c"] + F.least(F.lit(3), i - s["p"])).alias("c"), i.alias("p")),
        lambda s: s["c"],
    )
    return d.select(
        "doc_id",
        _long(F.col("n")).alias("n_words"),
        _long(F.length(F.array_join("words", ""))).alias("word_chars"),
        _long(F.col("n_symbols")).alias("n_symbols"),
        _long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _long(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"),
        _long(F.size("lines")).alias("n_lines"),
        _long(F.col("n_marks")).alias("n_marks"),
        _long(F.col("n_capitals")).alias("n_capitals"),
        _long(F.col("n_letters")).alias("n_letters"),
        _long(F.size(F.filter("words", lambda w: w.rlike(PLAIN)))).alias("n_plain"),
        _long(F.size(F.array_distinct("h"))).alias("n_distinct_words"),
    )


def votes(stats: DataFrame) -> DataFrame:
    """stats with a column v_<rule> of 1, 0 or -1 for each rule."""
    return stats.select(
        "*",
        *[
            F.when(bad(value()), -1).when(good(value()), 1).otherwise(0).cast("byte").alias(f"v_{name}")
            for name, value, bad, good in RULES
        ],
    )


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """Log prior odds of good, and for each rule the log likelihood ratio of each vote.

    Dawid and Skene's model for two classes over vote patterns, of which there
    are at most 3**rules.  It starts from all-must-pass.  The prior of a rule,
    PRIOR times as heavy as its votes, holds that a bad vote is right BAD_RIGHT
    of the time and that a good vote says little, as junk of another kind
    passes too; votes of the other rules move it from there.  A good vote may
    never count against a document, nor a bad one for it.
    """
    n = len(patterns[0][0]) if patterns else len(RULES)
    total = sum(c for _, c in patterns)
    cast = [{v: sum(c for p, c in patterns if p[j] == v) for v in (-1, 0, 1)} for j in range(n)]
    posterior = [0.02 if -1 in p else 0.98 if 1 in p else 0.5 for p, _ in patterns]
    prior, ratio = 0.0, [dict.fromkeys((-1, 0, 1), 0.0) for _ in range(n)]
    for _ in range(rounds if patterns else 0):
        good = sum(c * p for (_, c), p in zip(patterns, posterior, strict=True))
        prior = math.log((good + SMOOTH) / (total - good + SMOOTH))
        share = {-1: 1 - BAD_RIGHT, 0: good / total, 1: good / total}
        for j in range(n):
            on_good, on_bad = {}, {}
            for v in (-1, 0, 1):
                own = sum(c * p for (x, c), p in zip(patterns, posterior, strict=True) if x[j] == v)
                on_good[v] = own + PRIOR * share[v] * cast[j][v] + SMOOTH
                on_bad[v] = cast[j][v] - own + PRIOR * (1 - share[v]) * cast[j][v] + SMOOTH
            all_good, all_bad = sum(on_good.values()), sum(on_bad.values())
            x = {v: math.log(on_good[v] / all_good * all_bad / on_bad[v]) for v in (-1, 0, 1)}
            ratio[j] = {-1: min(x[-1], 0.0), 0: 0.0, 1: max(x[1], 0.0)}
        posterior = [
            1 / (1 + math.exp(-max(-500.0, min(500.0, prior + sum(r[v] for r, v in zip(ratio, p, strict=True))))))
            for p, _ in patterns
        ]
    return prior, ratio


def judge(docs: DataFrame) -> DataFrame:
    """The statistics of each row, its posterior probability of being good, and whether it is kept."""
    voted = table(votes(statistics(docs)))
    columns = [f"v_{name}" for name, *_ in RULES]
    found = voted.groupBy(*columns).count().collect()  # at most 3**rules rows
    patterns = sorted((tuple(r[c] for c in columns), r["count"]) for r in found)
    prior, ratio = estimate(patterns)
    odds = F.lit(prior)
    for column, weight in zip(columns, ratio, strict=True):
        odds = odds + F.when(F.col(column) == 1, F.lit(weight[1])).when(F.col(column) == -1, F.lit(weight[-1])).otherwise(
            F.lit(weight[0])
        )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        voted.withColumn("posterior", 1 / (1 + F.exp(-odds)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
    )


def query(spark, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )
