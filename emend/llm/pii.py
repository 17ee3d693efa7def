"""Personal data replaced by surrogates.

Entities are found by type: mail addresses, telephone numbers, payment cards (Luhn), IBANs (mod 97), social security numbers, IPv4 and IPv6
addresses, and names after titles or an introduction; a name that was found so is found again wherever it stands in the text, also with a genitive s. Telephone
numbers are international, in brackets, of three groups, or begin with a trunk 0; short local ones (555-1234) look like ranges and stay. A surrogate is drawn by a
keyed digest of the entity's normal form, so one entity has one surrogate wherever and however it is written; it keeps type, script, length, case and
punctuation. A name that most of its titles in the corpus call a man's or a woman's gets such an ending. Over the whole corpus no two entities of a type
share a surrogate and no surrogate is an entity: the distinct entities are drawn for, those that collide get a further draw, until none
is left. Where nearly all values of a length are taken, a name or number becomes longer.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, durable, small_batches

#: The most entities of which executors hold gender and further draws in memory; beyond it each text is joined with its own. Draws at most, and those after which a value grows.
MOST_KNOWN, MOST_DRAWS, GROWS = 100_000, 90, 20

#: Titles and the gender that they tell (m, f, or none).
TITLES = {"Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Señorita": "f", "Sra": "f", "Srta": "f", "Doña": "f", "Dr": "", "Prof": "", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
#: Phrases before a name.
INTRODUCTIONS = ("my name is", "mein name ist", "ich heiße", "je m'appelle", "mon nom est", "me llamo", "mi nombre es")
#: Letters of which surrogates of a script are made: consonants, vowels, last letters of male and female given names.
SCRIPTS = {
    "Latin": ("bdfglmnprstvk", "aeiou", "nrsdl", "a"),
    "Cyrillic": ("бвгдзклмнпрст", "аеиоу", "нрймл", "а"),
    "Greek": ("βγδζκλμνπρστφ", "αεηιου", "ς", "αη"),
}
#: Second-level domains set aside for examples.
SAFE = {"com": "example.com", "org": "example.org", "net": "example.net"}

_MAIL = regex.compile(r"(?<![\w.%+-])[\p{L}\p{N}_%+-]+(?:\.[\p{L}\p{N}_%+-]+)*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_IP = regex.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![\w]|\.[0-9])")
_CARD = regex.compile(r"(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])")
_PHONE = regex.compile(r"(?<![\w.(])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\w]|[.-][0-9])")
#: National numbers: a trunk 0, up to six groups parted by a space, a stroke or a hyphen; neither a date nor an SSN nor a longer row of numbers.
_NATIONAL = regex.compile(r"(?<![\w.,+/(-])(?![0-9]{2}[-/][0-9]{2}[-/][0-9]{4}(?![0-9]))(?![0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]))0[1-9][0-9]{0,4}[ /-][0-9]{2,9}(?:[ -][0-9]{2,9}){0,4}(?![\w]|[./-][0-9]|[ ][0-9]{2})")
#: Country calling codes of one and of two digits; all others have three.
CODES = ("1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_NAME = r"((?:\p{Lu}[\p{L}'’]*(?:-\p{Lu}\p{L}+)?)(?:[ \u00a0]\p{Lu}[\p{L}'’]+(?:-\p{Lu}\p{L}+)?){0,2})"
_TITLES = r"(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")"
_TITLE = regex.compile(rf"\b(?<!\b{_TITLES}\.?[ \u00a0])((?:{_TITLES}\.?[ \u00a0]+)++)" + _NAME)  # a run of titles is read from its start only
_INTRODUCED = regex.compile(r"\b(?i:" + "|".join(INTRODUCTIONS) + r")[ \u00a0]+(?!(?:" + "|".join(TITLES) + r")\b)" + _NAME)
_WORD = regex.compile(r"\p{Lu}[\p{L}'’]*(?:-\p{Lu}\p{L}+)?")
_IBAN = regex.compile(r"(?<![\w])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![\w])")
_SSN = regex.compile(r"(?<![\w.-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])")
_IPV6 = regex.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{0,4}:){4,7}[0-9A-Fa-f]{0,4}|[0-9A-Fa-f]{4}:(?:[0-9A-Fa-f]{0,4}:){1,2}[0-9A-Fa-f]{0,4})(?![\w:])")
_DIGIT = regex.compile(r"[0-9]")


@dataclass(frozen=True)
class Entity:
    """Code points start to end of a text; type, normal form, and the gender that a title tells of a given name."""

    start: int
    end: int
    kind: str
    normal: str
    gender: str = ""


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_card(digits: str) -> bool:
    """A number of a card network's range and length whose check digit is right."""
    n, two, four = len(digits), int(digits[:2]), int(digits[:4])
    known = (n in (13, 16, 19) and digits[0] == "4") or (n == 16 and (51 <= two <= 55 or 2221 <= four <= 2720)) or (n == 15 and two in (34, 37)) or (16 <= n <= 19 and (four == 6011 or two == 65 or 644 <= int(digits[:3]) <= 649)) or (n == 14 and two in (36, 38, 39))
    return known and luhn(digits)


def iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def national(phone: str) -> str:
    """The digits of a number without its country's code and without a trunk 0: one number has one form, however it is dialled."""
    digits = regex.sub(r"\D", "", phone)
    if phone.startswith("+"):
        digits = digits[next((n for n in (1, 2) if digits[:n] in CODES), 3) :]
    return digits[1:] if digits.startswith("0") else digits


def _gender_of(titles: str) -> str:
    """What the first of several titles that tells a gender says."""
    return next((g for t in regex.findall(r"\p{L}+", titles) if (g := TITLES.get(t, ""))), "")


def _normal_name(name: str) -> str:
    return name.lower().replace("’", "'")


def _names(m: regex.Match, group: int, gender: str, alone: bool) -> Iterator[Entity]:
    """The parts of a name, possessive endings apart; alone: a single part is a given name."""
    parts = list(regex.finditer(r"[^ \u00a0]+", m[group]))
    for i, x in enumerate(parts):
        bare = regex.sub(r"['’]s?$", "", x[0])
        given = i < len(parts) - 1 or (alone and len(parts) == 1)
        yield Entity(m.start(group) + x.start(), m.start(group) + x.start() + len(bare), "name", _normal_name(bare), gender if given else "")


def _apart(found: list[Entity]) -> list[Entity]:
    """In order, without overlaps: of two that overlap the one that begins first, then the longer."""
    out: list[Entity] = []
    for e in sorted(found, key=lambda e: (e.start, -e.end, e.kind)):
        if not out or e.start >= out[-1].end:
            out.append(e)
    return out


def entities(text: str) -> list[Entity]:
    """In order, without overlaps."""
    found = []
    if "@" in text:
        found += [Entity(m.start(), m.end(), "mail", m[0].casefold()) for m in _MAIL.finditer(text)]
    if _DIGIT.search(text):
        found += [Entity(m.start(), m.end(), "ip", m[0]) for m in _IP.finditer(text)]
        for m in _CARD.finditer(text):
            digits = regex.sub(r"\D", "", m[0])
            if is_card(digits):
                found.append(Entity(m.start(), m.end(), "card", digits))
            elif " " in m[0]:  # several numbers in a row
                found += [Entity(m.start() + x.start(), m.start() + x.end(), "card", x[0]) for x in regex.finditer(r"(?<![0-9])[0-9]{13,19}(?![0-9])", m[0]) if is_card(x[0])]
        found += [Entity(m.start(), m.end(), "iban", m[0].replace(" ", "")) for m in _IBAN.finditer(text) if iban_rest(m[0].replace(" ", "")) == 1]
        found += [Entity(m.start(), m.end(), "ssn", m[0].replace("-", "")) for m in _SSN.finditer(text)]
        found += [Entity(m.start(), m.end(), "phone", national(m[0])) for m in _PHONE.finditer(text) if 7 <= sum(c.isdigit() for c in m[0]) <= 15]
        for m in _NATIONAL.finditer(text):
            own = m[0]
            while sum(c.isdigit() for c in own) > 12 and regex.search(r"[ -][0-9]+$", own):  # a number that follows isn't part of it
                own = regex.sub(r"[ -][0-9]+$", "", own)
            if 9 <= sum(c.isdigit() for c in own) <= 12:
                found.append(Entity(m.start(), m.start() + len(own), "phone", national(own)))
    if ":" in text:
        for m in _IPV6.finditer(text):
            try:
                found.append(Entity(m.start(), m.end(), "ipv6", ipaddress.IPv6Address(m[0]).exploded))
            except ValueError:
                continue
    names = [e for m in _TITLE.finditer(text) for e in _names(m, 2, _gender_of(m[1]), False)]
    names += [e for m in _INTRODUCED.finditer(text) for e in _names(m, 1, "", True)]
    out = _apart(found + names)
    known = {e.normal for e in out if e.kind == "name"}
    if known:
        again = []
        for m in _WORD.finditer(text):
            bare = regex.sub(r"['’]s?$", "", m[0])
            if _normal_name(bare) not in known and bare.endswith("s"):  # a genitive without a sign
                bare = bare[:-1]
            if _normal_name(bare) in known:
                again.append(Entity(m.start(), m.start() + len(bare), "name", _normal_name(bare)))
        taken = iter(out)
        here = next(taken, None)
        for e in again:  # both are in order: those that meet none of the others
            while here is not None and here.end <= e.start:
                here = next(taken, None)
            if here is None or e.end <= here.start:
                found.append(e)
        out = _apart(found + names)
    return out


class _Stream:
    """Numbers from a keyed digest."""

    def __init__(self, key: bytes, *what: object):
        self.seed, self.n, self.pool = hmac.new(key, "\0".join(map(str, what)).encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), 0, 0

    def below(self, n: int) -> int:
        if self.pool < 1 << 32:
            self.pool = (self.pool << 256) | int.from_bytes(hashlib.sha256(self.seed + bytes([self.n & 255, self.n >> 8])).digest(), "big")
            self.n += 1
        self.pool, out = divmod(self.pool, n)
        return out

    def pick(self, options):
        return options[self.below(len(options))]


@lru_cache(4096)
def _letters_near(c: str) -> str:
    """Letters like this one for scripts without a list: of its block, script and case."""
    script = regex.match(r"\p{Script=Common}|\p{Script=Inherited}", c) is None
    block = ord(c) & ~63
    alike = [x for x in map(chr, range(block, block + 64)) if x.isalpha() and x.islower() == c.islower() and x.isupper() == c.isupper()]
    return "".join(alike) if script and alike else c


def script_of(text: str) -> str | None:
    return next((k for k in SCRIPTS if regex.search(rf"\p{{{k}}}", text)), None)


def _alike(c: str, s: _Stream) -> str:
    """A sign of the same class: digit, or letter of the script and case."""
    if c.isdigit():
        return str(s.below(10))
    if not c.isalpha():
        return c
    script = script_of(c)
    if script is None:
        return s.pick(_letters_near(c))
    out = s.pick(SCRIPTS[script][0] + SCRIPTS[script][1])
    return out.upper() if c.isupper() else out


def _name(normal: str, s: _Stream, gender: str, more: int) -> str:
    """Consonants and vowels in turn, signs where they were; the last letter tells the gender."""
    letters = [i for i, c in enumerate(normal) if c.isalpha()]
    turn, out = s.below(2), list(normal)
    for k, i in enumerate(letters):
        script = script_of(normal[i])
        if script is None:
            out[i] = s.pick(_letters_near(normal[i]))
            continue
        consonants, vowels, male, female = SCRIPTS[script]
        last = i == letters[-1] and not more
        out[i] = s.pick({"m": male, "f": female}[gender] if last and gender else (consonants, vowels)[(k + turn) % 2])
    script = script_of(normal) or "Latin"
    consonants, vowels, male, female = SCRIPTS[script]
    for k in range(more):
        ending = {"m": male, "f": female}.get(gender) if k == more - 1 else None
        out.append(s.pick(ending or (consonants, vowels)[(len(letters) + k + turn) % 2]))
    return "".join(out)


def draw(kind: str, normal: str, key: bytes, attempt: int = 0, gender: str = "") -> str:
    """The surrogate's normal form. A late attempt may be longer where a type has few values of a length."""
    s, more = _Stream(key, kind, normal, attempt), attempt // GROWS
    if kind == "mail":
        local, _, domain = normal.rpartition("@")
        host, end = domain.rsplit(".", 1) if "." in domain else (domain, "")
        name = "".join(_alike(c, s) for c in local) + "".join(_alike("a", s) for _ in range(more))
        label = "".join(_alike(c, s) for c in host.split(".")[0])
        return f"{name}@{label}.{SAFE.get(end, f'example.{end}')}"
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "ipv6":
        return ipaddress.IPv6Address((0x20010DB8 << 96) + s.below(1 << 96)).exploded  # the prefix that is set aside for examples
    if kind == "iban":
        body = "".join(str(s.below(10)) if c.isdigit() else s.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in normal[4:])
        return f"{normal[:2]}{98 - iban_rest(normal[:2] + '00' + body):02}{body}"
    if kind == "ssn":
        area = 1 + s.below(898)
        return f"{area + (area >= 666):03}{1 + s.below(99):02}{1 + s.below(9999):04}"
    if kind == "card":
        body = normal[0] + ("" if normal[0] == "4" else normal[1:4]) + "".join(str(s.below(10)) for _ in range(len(normal)))
        body = body[: len(normal) - 1]
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "phone":
        return "".join(str(s.below(9) + (i == 0)) for i in range(len(normal) + more))
    return _name(normal, s, gender, more)


def written(surrogate: str, kind: str, place: str) -> str:
    """The surrogate in the form of the place: digits between its punctuation, letters in its case."""
    if kind in ("card", "phone", "ssn", "iban"):
        digits = regex.sub(r"\D", "", place)
        signs = iter((digits[: len(digits) - len(national(place))] if kind == "phone" else "") + surrogate)  # the country's code and a trunk 0 stay
        return "".join(next(signs) if c.isalnum() else c for c in place) + "".join(signs)
    if kind == "ip":
        return surrogate
    if kind == "ipv6":
        out = surrogate if "::" not in place and len(place) == 39 else ipaddress.IPv6Address(surrogate).compressed
        return out.upper() if any(c.isupper() for c in place) else out
    if place.isupper() and len(place) > 1:
        return surrogate.upper()
    if kind == "mail":
        local = place.rpartition("@")[0]
        return surrogate[0].upper() + surrogate[1:] if local[:1].isupper() else surrogate
    return "".join(place[i] if i < len(place) and not place[i].isalpha() else c.upper() if i < len(place) and place[i].isupper() else c for i, c in enumerate(surrogate))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column("text").to_pylist()]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct (kind, normal) of each batch, and how often a title calls them a man's or a woman's."""
    for batch in batches:
        own: dict[tuple[str, str], Counter] = {}
        for t in _texts(batch):
            for e in entities(t):
                own.setdefault((e.kind, e.normal), Counter())[e.gender] += 1
        keys = sorted(own)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)), *(pa.array([own[k][g] for k in keys], pa.int64()) for g in "mf")], ["kind", "normal", "m", "f"])


_DRAWN = ("kind", "normal", "gender", "attempt")


def _drawn(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c) for c in _DRAWN]
        made = [draw(k, n, key, a, g) for k, n, g, a in zip(*(c.to_pylist() for c in columns), strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.string())], [*_DRAWN, "surrogate"])


def special(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, normal, gender, attempt) of the entities that have a gender, or whose first draw collides: with another's surrogate, or with an entity of the corpus."""
    votes = docs.select("text").mapInArrow(_found, "kind string, normal string, m bigint, f bigint").groupBy("kind", "normal").agg(F.sum("m").alias("m"), F.sum("f").alias("f"))
    gender = F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("")
    every = durable(votes.select("kind", "normal", gender.alias("gender")), "entities")
    schema = "kind string, normal string, gender string, attempt int, surrogate string"
    drawn = durable(every.withColumn("attempt", F.lit(0)).mapInArrow(lambda it: _drawn(it, key), schema), "drawn")
    taken = every.select("kind", F.col("normal").alias("surrogate"), F.lit(True).alias("real"))
    for _ in range(MOST_DRAWS):
        order = F.struct("attempt", "normal")
        first = drawn.groupBy("kind", "surrogate").agg(F.min(order).alias("first"), F.count("*").alias("n"))
        clash = drawn.join(first, ["kind", "surrogate"]).join(taken, ["kind", "surrogate"], "left")
        clash = durable(clash.where(F.col("real").isNotNull() | ((F.col("n") > 1) & (order != F.col("first")))).select(*_DRAWN), "clash")
        if clash.isEmpty():
            return drawn.where("attempt > 0 or gender <> ''").select(*_DRAWN)
        again = clash.withColumn("attempt", F.col("attempt") + 1).mapInArrow(lambda it: _drawn(it, key), schema)
        new = durable(drawn.join(clash, list(_DRAWN), "left_anti").select(*_DRAWN, "surrogate").union(again), "drawn")
        drop(drawn, clash)
        drawn = new
    raise RuntimeError(f"entities still collide after {MOST_DRAWS} draws")


def rewritten(text: str, key: bytes, known: dict[tuple[str, str], tuple[str, int]]) -> tuple[str, list[dict]]:
    """The text with surrogates, and where these stand in it; known: gender and attempt of entities that aren't drawn for plainly."""
    parts, places, at, length = [], [], 0, 0
    for e in entities(text):
        gender, attempt = known.get((e.kind, e.normal), ("", 0))
        new = written(draw(e.kind, e.normal, key, attempt, gender), e.kind, text[e.start : e.end])
        parts += [text[at : e.start], new]
        length += e.start - at
        places.append({"kind": e.kind, "start": length, "end": length + len(new)})
        length += len(new)
        at = e.end
    return ("".join(parts) + text[at:] if parts else text), places


def _rewritten(batches: Iterator[pa.RecordBatch], key: bytes, known: Callable[[pa.RecordBatch, int], dict]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [(None, []) if t is None else rewritten(t, key, known(batch, i)) for i, t in enumerate(batch.column("text").to_pylist())]
        columns = [c for c in batch.schema.names if c != "redraw"]
        place = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        new = [pa.array([len(p) for _, p in made], pa.int64()), pa.array([p for _, p in made], place)]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in made], pa.string()) if c == "text" else batch.column(c) for c in columns] + new, [*columns, "n_entities", "surrogates"])


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """docs (text, ...) -> the same rows and columns, texts with surrogates, and n_entities and surrogates (kind, start, end in the new text).

    A text without entities, null or empty stays as it is, with 0 of them. Repeated rows are rewritten alike; null ids and an empty
    table need nothing special. Columns of docs that are named like the two new ones are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_entities", "surrogates", "redraw")
    further = durable(special(docs, key), "special")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_entities", T.LongType()), T.StructField("surrogates", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    if further.count() <= MOST_KNOWN:
        known = {(r["kind"], r["normal"]): (r["gender"], r["attempt"]) for r in further.collect()}  # at most MOST_KNOWN
        return docs.mapInArrow(lambda it: _rewritten(it, key, lambda batch, i: known), schema)
    # each text with what is known of its own entities
    digest = F.md5(F.col("text").cast("binary"))
    held = docs.select("text").withColumn("digest", digest).dropDuplicates(["digest"]).mapInArrow(_with_digest, "digest string, kind string, normal string")
    own = held.join(further, ["kind", "normal"]).groupBy("digest").agg(F.collect_list(F.struct(*_DRAWN)).alias("redraw"))
    joined = docs.withColumn("__digest", digest).join(own, F.col("__digest") == own["digest"], "left").drop("__digest", "digest")
    return joined.mapInArrow(lambda it: _rewritten(it, key, lambda batch, i: {(x["kind"], x["normal"]): (x["gender"], x["attempt"]) for x in batch.column("redraw")[i].as_py() or []}), schema)


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [(d, k, n) for t, d in zip(_texts(batch), batch.column("digest").to_pylist(), strict=True) for k, n in sorted({(e.kind, e.normal) for e in entities(t)})]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in own], pa.string()) for i in range(3)], ["digest", "kind", "normal"])


#: The key of the registered query; real runs bring a secret of their own.
QUERY_KEY = b"emend"


def op8_surrogates(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
