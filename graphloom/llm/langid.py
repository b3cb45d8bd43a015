"""Language by compression: the language whose dictionary leaves the text smallest.

For each language SHARDS raw-content zstandard dictionaries are filled with
texts of that language, no text in two of them.  A text's size under a language
is the median over its shards, so a passage that a text happens to share with
one shard does not decide.  The margin is how much smaller the best size is
than the second; narrow margins are flagged as rejected.

Learning takes only rows whose crc32(doc_id as text) mod 4 is not 2, with text
and language.  The dictionaries are a bounded sample of at most SAMPLE distinct
texts of every language, those of the least hash in each of SAMPLE slots, so
copies do not crowd out other texts and a language with any text is learned.
Of a longer text a stretch of LONGEST characters is taken, and a shard has
DICTIONARY bytes at most; beyond FULL_LANGUAGES languages both shrink, so that
memory stays bounded.  Prediction reads the whole text and nothing else.

Edge cases: a null text, and one without a letter, is ``und`` with score 0; so
is every text if no language was learned.  Equal sizes go to the language first
by name, with score 0.  Rows that repeat a doc_id are predicted each; a null
doc_id is returned, and counts as learnable.  An empty table gives an empty
result.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import crc_mod, cut, documents, id_text, side, spread, texts

SHARDS = 3
DICTIONARY = 1 << 16
LEVEL = 5
FULL_LANGUAGES = 64  # more than these share the memory of as many
SMALLEST = 2048
SAMPLE = 400
LONGEST = 8192
SHORTEST = 200
NARROW = 0.02
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-cased words of letters, which is what is compressed."""
    found = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return found.encode() if any(map(str.isalpha, found)) else b""


def learn(docs: DataFrame) -> dict[str, list[bytes]]:
    """The dictionaries of each language, of which none is left out."""
    train = id_text(docs, F.col("lang").cast("string").alias("lang")).where(
        F.coalesce(crc_mod("doc_id", FOLDS) != HELD_OUT, F.lit(True)) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    # the text of the least hash of each slot; copies are one text, and texts that are too short come last
    hashed = F.xxhash64("text")
    rank = hashed.bitwiseAND(F.lit((1 << 62) - 1)) + F.when(F.length("text") < SHORTEST, F.lit(1 << 62)).otherwise(F.lit(0).cast("long"))
    ranked = train.select("lang", "text", rank.alias("rank"), F.pmod(F.xxhash64(hashed), F.lit(SAMPLE)).alias("slot"))
    least = cut(ranked.groupBy("lang", "slot").agg(F.min("rank").alias("rank")))
    languages = least.select("lang").distinct().count()
    # the memory of the dictionaries is bounded: many languages have smaller ones
    part = min(1.0, FULL_LANGUAGES / max(1, languages))
    slots, size = max(SHARDS, int(SAMPLE * part)), max(SMALLEST, int(DICTIONARY * part))
    chosen = least
    if part < 1:
        few = least.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list("rank")), 1, slots).alias("rank"))
        chosen = few.select("lang", F.explode("rank").alias("rank"))
    at = F.pmod(hashed, F.greatest(F.length("text") - LONGEST + 1, F.lit(1))).cast("int") + 1
    rows = (
        ranked.join(side(chosen.select("lang", "rank")), ["lang", "rank"], "left_semi")
        .select("lang", "rank", F.substring("text", at, F.lit(LONGEST)).alias("text"))
        .dropDuplicates(["lang", "rank"])
        .collect()
    )
    sample: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["rank"], r["text"])):
        sample.setdefault(r["lang"], []).append(letters(r["text"]))
    out = {}
    for lang, found in sorted(sample.items()):
        if not any(found):  # the stretch of a long text may miss its few letters
            found = [b"\0"]
        shards = [b"\n".join(found[k::SHARDS])[:size] for k in range(min(SHARDS, len(found)))]
        out[lang] = [s for s in shards if len(s) >= 8] or [max(shards, key=len) * 8]
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, list[bytes]], level: int = LEVEL):
        self.languages = []
        for lang, shards in sorted(dictionaries.items()):
            compressors = []
            for shard in shards:
                size = zstandard.ZstdCompressionParameters.from_level(
                    level, write_content_size=0, write_dict_id=0, write_checksum=0
                )
                d = zstandard.ZstdCompressionDict(shard, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=size)
                compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=size).compress)
            self.languages.append((lang, compressors))

    def predict(self, text: str) -> tuple[str, float]:
        """Language and margin."""
        found = letters(text)
        if not found or not self.languages:
            return UNKNOWN, 0.0
        sizes = []
        for lang, compressors in self.languages:
            own = sorted(len(c(found)) for c in compressors)
            sizes.append((own[len(own) // 2], lang))
        sizes.sort()
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def predict(docs: DataFrame, dictionaries: dict[str, list[bytes]]) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every whole text; score is one half at the narrowest accepted margin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries)
        for batch in batches:
            t = texts(batch.column(1))
            found = [classifier.predict(t.row(i).decode()) for i in range(len(t))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([1 - 0.5 ** (x[1] / NARROW) for x in found], pa.float64()),
                    pa.array([x[1] < NARROW for x in found], pa.bool_()),
                ],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return spread(id_text(docs)).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return predict(docs, learn(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
