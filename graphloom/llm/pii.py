"""Personal data: detected entities get keyed surrogates of the same kind.

A surrogate keeps what its kind promises: digits stay digits in the same
places, a card number that satisfies the Luhn test still does, an IBAN keeps
its country and its checksum, an address block stays public or private, a name
keeps gender, script and capitals.  The same entity has the same surrogate
everywhere under a key, so coreference holds in and across documents.

Surrogates of a format are a keyed permutation of that format (a Feistel
network that walks until it is inside), so they are distinct among themselves.
Across formats, and against the entities that are really in the corpus, a
collision check makes sure: a surrogate that equals any entity or an earlier
surrogate is drawn anew, round by round, in joins over the distinct entities.
Only the few entities that needed another draw travel back to the documents.
Where real values fill a format, so that MAX_DRAWS draws found nothing free, a
surrogate may be a real value, of another entity; after as many draws again,
when a format is all but full, two entities may share one.  No surrogate ever
leaves its format.

Kinds: email, card, iban, ssn, ip, phone, and person names after a form of
address or of a listed given name and a capitalised word; their words are then
replaced wherever they stand in the document.

The key is the setting spark.graphloom.pii.key.  Without it a public one is
used, with a warning: anyone can undo those surrogates.

Edge cases: a null or empty text stays as it is.  Texts without entities are
returned unchanged, byte for byte.  Rows that repeat a doc_id are treated each;
no id is used.  An empty table gives an empty result.  All other columns pass
through, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import LETTERS, cut, documents, hash_bytes, lean, spread, table, texts, words
from graphloom.session import ship

KEY = b"graphloom: replace this key in production"
KEY_SETTING = "spark.graphloom.pii.key"
MAX_DRAWS = 32
SMALLEST_FORMAT = 10_000  # formats with fewer strings than this get a longer surrogate

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = (
    ("email", regex.compile(r"(?<![\w.%+-])[\w%+-][\w.%+-]*+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])")),
    ("iban", regex.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("card", regex.compile(r"(?<![A-Za-z0-9])(?<!\d[.-])\d(?:[ -]?\d){12,18}(?![A-Za-z0-9])")),
    ("ssn", regex.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("ip", regex.compile(rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\w)")),
    (
        "phone",
        regex.compile(
            r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)"
            r"|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)"
            r"|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
        ),
    ),
)

#: Forms of address and the gender they tell.
ADDRESS = {
    "mr": "m", "mister": "m", "sir": "m", "herr": "m", "herrn": "m", "señor": "m", "sr": "m", "monsieur": "m", "господин": "m",
    "mrs": "f", "ms": "f", "miss": "f", "madam": "f", "frau": "f", "señora": "f", "señorita": "f", "sra": "f", "madame": "f",
    "mme": "f", "mademoiselle": "f", "mlle": "f", "госпожа": "f", "dr": "", "doctor": "", "prof": "", "professor": "", "доктор": "",
}
#: Given names by script and gender.
GIVEN = {
    ("latin", "m"): (
        "Adam", "Bruno", "Carl", "Daniel", "David", "Emil", "Felix", "George", "Henry", "Hugo", "Jacques", "James", "John",
        "José", "Juan", "Karl", "Louis", "Luis", "Mark", "Martin", "Michael", "Oscar", "Paul", "Peter", "Pierre", "Robert",
        "Simon", "Thomas", "Victor", "Walter", "William",
    ),
    ("latin", "f"): (
        "Alice", "Anna", "Barbara", "Carmen", "Claire", "Clara", "Diana", "Elena", "Elizabeth", "Emma", "Eva", "Hannah", "Helen",
        "Ingrid", "Isabel", "Jane", "Julia", "Laura", "Linda", "Lucy", "Maria", "Marie", "Mary", "Monika", "Nora", "Olivia",
        "Patricia", "Sarah", "Sofia", "Susan", "Teresa",
    ),
    ("cyrillic", "m"): (
        "Александр", "Андрей", "Борис", "Виктор", "Владимир", "Дмитрий", "Иван", "Игорь", "Михаил", "Николай", "Олег", "Павел",
        "Пётр", "Сергей", "Юрий",
    ),
    ("cyrillic", "f"): (
        "Анна", "Вера", "Галина", "Дарья", "Екатерина", "Елена", "Ирина", "Ксения", "Мария", "Надежда", "Наталья", "Ольга",
        "Светлана", "Татьяна", "Юлия",
    ),
}
_SYLLABLES = {
    "latin": [c + v for c in "bdfgklmnprstvz" for v in "aeiou"],
    "cyrillic": [c + v for c in "бвгдзклмнпрст" for v in "аеиоу"],
}
_NAME = regex.compile(
    r"(?<!\w)(" + "|".join(sorted({x.capitalize() for x in ADDRESS}, key=len, reverse=True)) + r")\b\.?\s+"
    r"(\p{Lu}[\p{L}'’-]+(?:\s+\p{Lu}[\p{L}'’-]+){0,2})"
)
#: Given names that are words as well, so alone they name nobody.
_WORDS = {"Mark", "Eva"}
_GIVEN_NAMES = sorted({n for names in GIVEN.values() for n in names} - _WORDS, key=lambda n: (-len(n), n))
_PAIR = regex.compile(r"(?<!\w)(" + "|".join(map(regex.escape, _GIVEN_NAMES)) + r")\s+(\p{Lu}[\p{L}'’-]+)")
_GENDER_OF = {name.lower(): gender for (_, gender), names in GIVEN.items() for name in names}


# --- keyed permutations ----------------------------------------------------


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size)."""
    half = max(1, (size.bit_length() + 1) // 2)
    mask, n = (1 << half) - 1, (half + 7) // 8
    seed = key + b"\0" + tweak.encode() + b"\0" + str(size).encode()
    while True:
        left, right = x >> half, x & mask
        for turn in range(8):
            f = hashlib.shake_256(seed + bytes([turn]) + right.to_bytes(n, "big")).digest(n)
            left, right = right, left ^ (int.from_bytes(f, "big") & mask)
        x = left << half | right
        if x < size:
            return x


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _class_of(c: str) -> str:
    return next((k for k in _CLASSES if c in k), "")


def permute_text(value: str, key: bytes, tweak: str, free=None, like=None) -> str:
    """Another string of the same format: each free ASCII letter or digit stays of its class.

    like: what of the string must stay as it is; the permutation walks until it
    does, which keeps it a permutation of the strings that agree on it.
    """
    classes = [_class_of(c) if free is None or free[i] else "" for i, c in enumerate(value)]
    size = math.prod(len(k) for k in classes if k)
    if size < 2:
        return value
    form = "".join(c if not k else k[0] for c, k in zip(value, classes, strict=True))
    x = 0
    for c, k in zip(value, classes, strict=True):
        if k:
            x = x * len(k) + k.index(c)
    while True:
        x = permute(x, size, key, f"{tweak}\0{form}")
        rest, out = x, []
        for c, k in zip(reversed(value), reversed(classes), strict=True):
            if k:
                rest, digit = divmod(rest, len(k))
                c = k[digit]
            out.append(c)
        found = "".join(reversed(out))
        if like is None or like(found) == like(value):
            return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_rest(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


#: Address blocks of their own, which a surrogate does not leave; first address and size.
_BLOCKS = (
    (0, 1 << 24), (10 << 24, 1 << 24), (127 << 24, 1 << 24), (0xA9FE0000, 1 << 16), (0xAC100000, 1 << 20), (0xC0A80000, 1 << 16),
    (224 << 24, 1 << 29),
)


def _network(value: str) -> str:
    a, b = map(int, value.split(".")[:2])
    if a in (0, 10, 127):
        return str(a)
    if (a, b) in ((192, 168), (169, 254)) or a == 172 and 16 <= b < 32:
        return "local"
    return "public" if a < 224 else "other"


def _script(word: str) -> str:
    return "cyrillic" if regex.search(r"\p{Cyrillic}", word) else "latin"


def _syllables(x: int, script: str) -> str:
    own, out = _SYLLABLES[script], []
    while x or len(out) < 3:
        x, k = divmod(x, len(own))
        out.append(own[k])
    return "".join(out)


def _name(role: str, value: str, key: bytes, draw: int) -> str:
    """A name word of the same script; given names keep their gender, and listed ones stay on the list while it has free names."""
    script = _script(value)
    # late draws are longer, so that there are always enough
    number = int.from_bytes(hashlib.blake2b(value.encode(), digest_size=5 if draw <= MAX_DRAWS else 10, key=key[:64], salt=f"{role[:8]}{draw}".encode()).digest(), "big")
    if role in ("given_m", "given_f"):
        pool = GIVEN[script, role[-1]]
        lower = [n.lower() for n in pool]
        if value in lower and draw <= MAX_DRAWS // 2:  # then the list is taken to be used up
            return pool[permute(lower.index(value), len(pool), key, f"{role}\0{draw}")]
        ends = {("latin", "f"): "na", ("latin", "m"): "n", ("cyrillic", "f"): "на", ("cyrillic", "m"): "н"}
        return _syllables(number, script).capitalize() + ends[script, role[-1]]
    return _syllables(number, script).capitalize()


def surrogate(kind: str, value: str, draw: int = 1, key: bytes = KEY) -> str:
    """The draw-th candidate for an entity in canonical form."""
    tweak = f"{kind}\0{draw}"
    if kind in ("given_m", "given_f", "family"):
        return _name(kind, value, key, draw)
    if kind == "ip":
        x = int.from_bytes(bytes(int(o) for o in value.split(".")), "big")
        base, size = next(((at, n) for at, n in _BLOCKS if at <= x < at + n), (0, 1 << 32))
        while True:
            x = base + permute(x - base, size, key, f"{tweak}\0{base}")
            found = ".".join(map(str, x.to_bytes(4, "big")))
            if _network(found) == _network(value):
                return found
    if kind == "card" and luhn(value):
        body = permute_text(value[:-1], key, tweak, like=lambda s: s[0])
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind == "card":
        return permute_text(value, key, tweak, like=lambda s: (s[0], luhn(s)))
    if kind == "iban":
        body = permute_text(value[4:], key, f"{tweak}\0{value[:2]}")
        return f"{value[:2]}{98 - _iban_rest(value[:2] + '00' + body):02d}{body}"
    if kind == "email":
        last = value.rindex(".")
        free = [i < last for i in range(len(value))]
        found = permute_text(value, key, tweak, free)
        if math.prod(len(_class_of(c)) or 1 for c, f in zip(value, free, strict=True) if f) < SMALLEST_FORMAT:
            found = _syllables(int.from_bytes(hashlib.blake2b(value.encode(), digest_size=6, key=key[:64], salt=str(draw).encode()).digest(), "big"), "latin") + found
        return found
    # phone and ssn: a country code stays, and a leading digit stays zero, one or more
    country = len(value) - len(regex.sub(r"^\+\d{1,3}(?=[ .(-])|^\+\d", "", value))
    free = [i >= country for i in range(len(value))]
    first = next((i for i, c in enumerate(value) if c.isdigit() and i >= country), 0)
    return permute_text(value, key, tweak, free, like=lambda s: min(int(s[first]), 2))


# --- detection -------------------------------------------------------------


def canonical(kind: str, found: str) -> str:
    if kind == "email":
        return found.lower()
    if kind in ("card", "iban"):
        return found.replace(" ", "").replace("-", "")
    return found


def _dress(kind: str, found: str, value: str) -> str:
    """The surrogate of the canonical form in the spelling of the place."""
    if kind in ("card", "iban") and len(value) == len(canonical(kind, found)):
        rest = iter(value)
        return "".join(next(rest) if c not in " -" else c for c in found)
    if kind == "email" and len(found) == len(value):
        return "".join(v.upper() if f.isupper() else v for f, v in zip(found, value, strict=True))
    if kind == "email" and found.isupper():
        return value.upper()
    if kind in ("given_m", "given_f", "family") and found.isupper() and len(found) > 1:
        return value.upper()
    return value


def _real(kind: str, value: str) -> bool:
    if kind == "card":
        return luhn(value)
    if kind == "iban":
        return 15 <= len(value) <= 34 and _iban_rest(value) == 1
    return True


def _gender(name: str) -> str:
    """Of a lower-cased given name: as listed, else by its ending."""
    return _GENDER_OF.get(name) or ("f" if name[-1] in "aая" else "m")


def name_roles(text: str) -> dict[str, str]:
    """Lower-cased name words that follow a form of address or are a listed given name and its family name, and their roles."""
    roles: dict[str, str] = {}
    for m in _NAME.finditer(text):
        gender = ADDRESS[m[1].lower()]
        parts = [p.lower() for p in m[2].split()]
        for i, part in enumerate(parts):
            if len(part) < 2:
                continue
            if i + 1 < len(parts):
                roles.setdefault(part, f"given_{gender or _gender(part)}")
            else:
                roles.setdefault(part, "family")
    for m in _PAIR.finditer(text):
        roles.setdefault(m[1].lower(), f"given_{_gender(m[1].lower())}")
        roles.setdefault(m[2].lower(), "family")
    return roles


def detect(text: str, digits: bool = True, names: bool = True) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities of a text, in order and without overlap."""
    found: list[tuple[int, int, str, str]] = []
    taken = np.zeros(len(text), bool)
    for kind, pattern in PATTERNS:
        if not digits and kind != "email" or kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            value = canonical(kind, m[0])
            if not taken[m.start() : m.end()].any() and _real(kind, value):
                found.append((m.start(), m.end(), kind, value))
        for start, end, own, _ in found:
            if own == kind:
                taken[start:end] = True
    roles = name_roles(text) if names else {}
    if roles:
        for m in _CAPITALISED.finditer(text):
            # a name may hold hyphens and the like: the longest stretch of parts that is a name
            parts = [(m.start() + p.start(), m.start() + p.end()) for p in _PART.finditer(m[0])]
            i = 0
            while i < len(parts):
                start, step = parts[i][0], 1
                for j in range(len(parts) - 1, i - 1, -1):
                    end = parts[j][1]
                    name = text[start:end].lower()
                    if name in roles:
                        if text[start].isupper() and not taken[start:end].any():
                            found.append((start, end, roles[name], name))
                        step = j - i + 1
                        break
                i += step
    return sorted(found)


_CAPITALISED = regex.compile(r"(?<!\w)\p{Lu}[\w'’-]*")
_PART = regex.compile(r"\w+")


# words are lower-cased in ASCII only, so a capital of another script is its own spelling
_ADDRESS_HASHES = np.sort(
    np.array(
        [
            hash_bytes(x.encode())
            for x in {
                *ADDRESS, *(x.capitalize() for x in ADDRESS if not x[0].isascii()),
                *("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in n) for n in _GIVEN_NAMES),
            }
        ],
        np.uint64,
    )
)


def _candidates(column: pa.Array) -> Iterator[tuple[int, str, bool, bool]]:
    """Rows that may hold entities: place, text, whether it has a digit, whether a form of address."""
    t = texts(column)
    for a, b in t.chunks():
        raw = t.data[t.offsets[a] : t.offsets[b]]
        base = t.offsets[a : b + 1] - t.offsets[a]
        w = words(t, a, b, LETTERS)
        at = np.minimum(np.searchsorted(_ADDRESS_HASHES, w.hash), len(_ADDRESS_HASHES) - 1)
        name = np.zeros(b - a, bool)
        name[w.row_of()[_ADDRESS_HASHES[at] == w.hash]] = True
        some = []
        for flags in ((raw >= 48) & (raw < 58), raw == 64):
            has = np.zeros(b - a, bool)
            has[np.searchsorted(base, np.flatnonzero(flags), side="right") - 1] = True
            some.append(has)
        for i in np.flatnonzero(name | some[0] | some[1]):
            yield a + int(i), t.row(a + int(i)).decode(), bool(some[0][i]), bool(name[i])


_TEXT, _HASH, _DRAWN = "__graphloom_text", "__graphloom_hash", "__graphloom_drawn"


def entities(docs: DataFrame) -> DataFrame:
    """h (hash of the text), kind, value: the distinct entities of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            h = batch.column(0)
            for i, text, digits, names in _candidates(batch.column(1)):
                rows |= {(h[i].as_py(), kind, value) for _, _, kind, value in detect(text, digits, names)}
            found = sorted(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in found], pa.int64()), *(pa.array([r[k] for r in found], pa.string()) for k in (1, 2))],
                ["h", "kind", "value"],
            )

    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    return spread(docs.select(F.xxhash64(text).alias("h"), text.alias("text"))).mapInArrow(lean(run), "h long, kind string, value string")


def redrawn(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, value, draw of the distinct entities whose first surrogate would collide.

    A draw is taken if it equals no entity of the corpus, no surrogate taken
    before, and is the first of its round; the others draw again, from
    MAX_DRAWS on without the first condition, and from twice as many on without any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                canonical(kind, surrogate(kind, value, draw, key)).lower()
                for kind, value, draw in zip(*(c.to_pylist() for c in batch.columns), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["kind", "value", "draw", "made"])

    real = found.select(F.lower("value").alias("made")).distinct()
    pending, draw = found.withColumn("draw", F.lit(1)), 1
    taken = late = None
    while True:
        made = cut(pending.mapInArrow(lean(run), "kind string, value string, draw int, made string"))
        first = made.groupBy("made").agg(F.min(F.struct("kind", "value")).alias("first"))
        good = made.join(first, "made").where((F.struct("kind", "value") == F.col("first"))).drop("first")
        if draw <= MAX_DRAWS:
            good = good.join(real, "made", "left_anti")
        if taken is not None and draw <= 2 * MAX_DRAWS:
            good = good.join(taken, "made", "left_anti")
        if draw > 2 * MAX_DRAWS:
            good = made
        good = cut(good)
        pending = cut(made.join(good.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value"))
        new = good.select("made")
        taken = new if taken is None else taken.unionByName(new)
        if draw > 1:
            again = good.select("kind", "value", "draw")
            late = again if late is None else late.unionByName(again)
        draw += 1
        if pending.isEmpty():
            break
        pending = pending.withColumn("draw", F.lit(draw))
    return late if late is not None else good.select("kind", "value", "draw").limit(0)


def replace(text: str, drawn: dict[tuple[str, str], int], key: bytes, digits: bool, names: bool) -> tuple[str, int]:
    """The text with surrogates, and how many entities it had."""
    out, at = [], 0
    found = detect(text, digits, names)
    for start, end, kind, value in found:
        made = surrogate(kind, value, drawn.get((kind, value), 1), key)
        out += [text[at:start], _dress(kind, text[start:end], made)]
        at = end
    return "".join(out) + text[at:], len(found)


def key_of(spark) -> bytes:
    """The key of the session's settings, else the public one."""
    own = spark.conf.get(KEY_SETTING, "")
    if own:
        return own.encode()
    warnings.warn(f"{KEY_SETTING} is not set: surrogates are made with a public key and can be undone", stacklevel=3)
    return KEY


def pseudonymise(docs: DataFrame, key: bytes | None = None, count: str | None = None) -> DataFrame:
    """docs with surrogates in the column text; count names a column for the number of entities."""
    key = key or key_of(docs.sparkSession)
    found = table(entities(docs))
    late = redrawn(cut(found.select("kind", "value").distinct()), key)
    kind = "array<struct<kind:string,value:string,draw:int>>"
    given = spread(docs.select("*"))
    if late.isEmpty():
        given = given.withColumn(_DRAWN, F.array().cast(kind))
    else:
        by_text = found.join(late, ["kind", "value"]).groupBy(F.col("h").alias(_HASH)).agg(
            F.collect_set(F.struct("kind", "value", "draw")).alias(_DRAWN)
        )
        own = F.xxhash64(F.col("text").cast("string"))
        given = given.join(cut(by_text), own == F.col(_HASH), "left").drop(_HASH)
    names = docs.columns
    place = next(i for i, name in enumerate(names) if name.lower() == "text")
    fields = list(docs.schema.fields)
    fields[place] = T.StructField(names[place], T.StringType())
    if count:
        fields.append(T.StructField(count, T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:-1]
            changed: dict[int, str] = {}
            n = np.zeros(batch.num_rows, np.int64)
            for i, text, digits, named in _candidates(columns[place]):
                drawn = {(x["kind"], x["value"]): x["draw"] for x in batch.columns[-1][i].as_py() or []}
                changed[i], n[i] = replace(text, drawn, key, digits, named)
            if changed:
                values = columns[place].to_pylist()
                for i, text in changed.items():
                    values[i] = text
                columns[place] = pa.array(values, columns[place].type)
            if count:
                columns.append(pa.array(n))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return given.mapInArrow(lean(run), T.StructType(fields))


def query(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), count="n_entities")
