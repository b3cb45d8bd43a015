"""Scalar functions as column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hexadecimal."""
    return F.sha2(text.cast("binary"), 256)


def change_level(old_content: Column, old_structure: Column, content: Column, structure: Column) -> Column:
    """none, cosmetic or structural; a side that is missing is structural."""
    return (
        F.when(old_content.isNull() | content.isNull(), "structural")
        .when(old_content == content, "none")
        .when(old_structure == structure, "cosmetic")
        .otherwise("structural")
    )


def token_estimate(text: Column) -> Column:
    """Bytes over four, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def node_kind(node_id: Column) -> Column:
    return F.split(node_id, ":", 3)[0]


def node_path(node_id: Column) -> Column:
    return F.get(F.split(node_id, ":", 3), 1)


def node_symbol(node_id: Column) -> Column:
    """The part after the second colon, whatever colons it has; NULL for a file."""
    return F.get(F.split(node_id, ":", 3), 2)


def parent_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def _number(text: Column) -> Column:
    """A plain decimal number, NULL for anything else (words such as NaN too)."""
    return F.when(F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(text).try_cast("double"))


def pass_rate(text: Column) -> Column:
    """'85%', '0.85', '85' or '85/100' as a share; NULL unless it is between 0 and 1."""
    t = F.trim(text)
    parts = F.split(t, "/", 2)
    top, bottom = _number(F.get(parts, 0)), _number(F.get(parts, 1))
    bare = _number(t)
    found = F.when(t.endswith("%"), _number(F.regexp_replace(t, "%$", "")) / 100)
    found = found.when(t.contains("/"), F.when(bottom != 0, top / F.nullif(bottom, F.lit(0.0)))).otherwise(
        F.when(bare > 1, bare / 100).otherwise(bare)
    )
    return F.when((found >= 0) & (found <= 1), found)


def behavior_coverage(rate: Column, known_differences: Column) -> Column:
    """The pass rate less what known differences take away; NULL stays NULL."""
    d = known_differences.cast("double")
    return F.greatest(rate * (1 - d / (d + 10)), F.lit(0.0)) + rate * 0


def normalize_share(rate: Column) -> Column:
    return F.when(rate.isNotNull(), F.least(F.greatest(rate * 100, F.lit(0.0)), F.lit(100.0)))


def normalize_pass(passed: Column) -> Column:
    return F.when(passed, 100.0).when(~passed, 0.0)


def normalize_ratio(value: Column, healthy: float, alert: float) -> Column:
    return (
        F.when(value <= healthy, 100.0)
        .when(value >= alert, 0.0)
        .when(value.isNotNull(), (alert - value) / (alert - healthy) * 100)
    )


def normalize_count(count: Column, penalty: float) -> Column:
    return F.when(count.isNotNull(), F.greatest(100.0 - count * penalty, F.lit(0.0)))


def deterministic_average(*scores: Column) -> Column:
    """Mean of the scores that are there, if at least two are."""
    there = F.filter(F.array(*scores), lambda x: x.isNotNull())
    total = F.aggregate(there, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(there) >= 2, total / F.size(there))


def rating_average(*ratings: Column) -> Column:
    """0.34 of the least, 0.33 of the middle and of the largest of three ratings."""
    s = F.array_sort(F.array(*ratings))
    return s[0] * 0.34 + s[1] * 0.33 + s[2] * 0.33


def final_score(deterministic: Column, rated: Column) -> Column:
    return F.when(rated.isNull(), deterministic).otherwise(deterministic * 0.7 + rated * 0.3)


def compile_pass(status: Column) -> Column:
    return F.when(status.isin("done", "testing", "reviewing"), True).when(status == "compile_fixing", False)


def ratio(part: Column, whole: Column) -> Column:
    """NULL where there is nothing to divide by."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def display_name(key: Column) -> Column:
    """A module key for people: no kind, no src/, no last extension; dotfiles keep theirs.  Not unique."""
    bare = F.replace(F.regexp_replace(key, r"^[^:/\\]*:", ""), F.lit("\\"), F.lit("/"))
    bare = F.regexp_replace(bare, r"^src/", "")
    return F.regexp_replace(bare, r"([^/])\.[^./]*$", "$1")


def normalize_path(path: Column) -> Column:
    """'.' and '..' resolved; NULL if the path leaves the root."""
    gone = F.array(F.lit(None).cast("string"))
    walked = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(F.exists(done, lambda x: x.isNull()), done)
        .when(part.isin("", "."), done)
        .when(part == "..", F.when(F.size(done) == 0, gone).otherwise(F.slice(done, 1, F.size(done) - 1)))
        .otherwise(F.array_append(done, part)),
    )
    return F.when(~F.exists(walked, lambda x: x.isNull()), F.array_join(walked, "/"))


def canonical_file(path: Column) -> Column:
    """A file name as other tools print it: no ./, no extension, no /index."""
    bare = F.regexp_replace(path, r"^(\./)+", "")
    bare = F.regexp_replace(bare, r"(\.d\.ts|\.tsx?|\.jsx?|\.mjs|\.cjs)$", "")
    return F.regexp_replace(bare, r"/index$", "")


def symbol_without_base(callee: Column, base: Column) -> Column:
    prefix = F.concat(base, F.lit("."))
    return F.when(callee.startswith(prefix), F.substring(callee, F.length(prefix) + 1, F.length(callee))).otherwise(callee)


def quote_dot(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def mermaid_id(text: Column) -> Column:
    """Only letters, digits and underscores; different ids may meet."""
    return F.regexp_replace(text, r"[^A-Za-z0-9_]", "_")


def version_parts(text: Column) -> Column:
    """major, minor, patch of the first version in a text; what is missing is 0."""
    found = F.regexp_extract(text, r"(\d+(?:\.\d+){0,2})", 1)
    parts = F.split(found, r"\.")
    number = lambda i: F.coalesce(F.get(parts, i).try_cast("long"), F.lit(0))
    return F.when(
        found != "", F.struct(number(0).alias("major"), number(1).alias("minor"), number(2).alias("patch"))
    )


def version_satisfies(found: Column, least: Column) -> Column:
    return version_parts(found) >= version_parts(least)


def same_major(a: Column, b: Column) -> Column:
    return F.split(a, r"\.")[0] == F.split(b, r"\.")[0]


def timestamp_valid(text: Column) -> Column:
    """RFC 3339, with a zone."""
    form = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
    return text.rlike(form) & F.try_to_timestamp(F.upper(text)).isNotNull()


#: Words of failure messages, in the order in which the kinds are tried.
FAILURES = (
    ("compilation_error", ("lifetime", "borrow", "type mismatch", "expected", "mismatched types")),
    ("type_complexity", ("trait bound", "generic", "where clause")),
    ("dependency_resolution", ("could not find", "unresolved", "dependency")),
)


def failure_kind(messages: Column) -> Column:
    """The kind of the first message that has words of one; semantic_gap if none has."""

    def kind(message: Column) -> Column:
        low = F.lower(message)
        out = F.lit(None).cast("string")
        for name, listed in reversed(FAILURES):
            out = F.when(low.rlike("|".join(listed)), name).otherwise(out)
        return out

    kinds = F.filter(F.transform(messages, kind), lambda x: x.isNotNull())
    return F.coalesce(F.get(kinds, 0), F.lit("semantic_gap"))


def effort(count: Column, low: int, medium: int) -> Column:
    return F.when(count <= low, "low").when(count <= medium, "medium").otherwise("high")


def ffi_effort(exports: Column) -> Column:
    return effort(exports, 3, 10)


def skip_effort(dependents: Column) -> Column:
    return effort(dependents, 0, 3)


#: The rest of an artefact's name after its module's, and what it is.
EVIDENCE = {
    "intent.md": "intent", "review.md": "review", "selection.md": "selection", "contract.md": "contract",
    "degrade-report.json": "degrade_report", "source-hashes.json": "source_hashes", "progress.json": "progress",
}


def evidence_kind(rest: Column) -> Column:
    """What an artefact is; NULL for what is not on the list."""
    out = (
        F.when(rest.startswith("phase-a"), "phase_a_attempt")
        .when(rest.startswith("phase-b"), "phase_b_attempt")
        .when(rest.endswith("manifest.json"), "porting_manifest")
    )
    for name, kind in EVIDENCE.items():
        out = F.when(rest == name, kind).otherwise(out)
    return out


def complexity_bucket(code_lines: Column) -> Column:
    return F.when(code_lines < 1000, "simple").when(code_lines <= 5000, "moderate").otherwise("complex")


#: The naming patterns of test files.
TEST_FILE = r"(^|/)([^/]*_test\.(go|py|c)|[^/]*\.test\.(tsx?|js)|[^/]*\.spec\.(tsx?|js)|test_[^/]*\.(py|c)|conftest\.py)$"


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_FILE)
