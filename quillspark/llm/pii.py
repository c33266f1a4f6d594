"""Problem 6: personal information inside free text.

Entities are found by patterns, and persons by a gazetteer of name parts learned from unambiguous places (titles, contact
tables, names before an address or number). Method of the replacement: surrogate generation - every entity gets a keyed,
type-consistent surrogate that keeps its format, script, letter case and feminine ending. A surrogate is the image of a
keyed permutation of all values of the same format, without fixed points, so that distinct entities stay distinct and
equal ones equal over the whole corpus, by construction; each text is checked for collisions besides, and typed
placeholders are numbered by the same identity.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import materialise

MAX_NAMES = 200_000  # bound of the gazetteer sent to the workers, most frequent first; rarer name parts are looked up by a join

# Forms of electronic and postal addresses, telephone and identity numbers. Each begins with what it consumes
# and looks behind after that, so that the search can skip to the places where it may begin.
DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)"
AT = r"(?:@|\s?[\[(]\s?at\s?[\])]\s?)"
AT_SIGN = re.compile(r"(?i)@|[\[(]\s?at\s?[\])]")
DOMAIN = re.compile(rf"(?i)\s?[a-z0-9](?:[\w-]*\w)?(?:{DOT}[a-z0-9](?:[\w-]*\w)?)+")
PLAIN_DOMAIN = re.compile(rf"(?i)[a-z0-9](?:[\w-]*\w)?(?:{DOT}[a-z0-9](?:[\w-]*\w)?)+")
PHONES = (
    re.compile(r"\+(?<![\w+]\+)\d{1,3}(?:[ .\-\n](?:\(\d{1,5}\)|\d{1,7})){2,5}(?![\w])"),
    re.compile(r"\((?<![\w.+/\-]\()\d{3}\)[ .\-\n]?\d{3}[ .\-\n]\d{4}(?![\w/])"),
    re.compile(r"\d(?<![\w.+/\-]\d)\d\d[ .\-\n]\d{3}[ .\-\n]\d{4}(?![\w/])"),
    re.compile(r"0(?<![\w.+/\-]0)(?<!\d 0)\d(?:[ .\n]\d\d){4}(?![\w/])"),
)
ID_SELF = re.compile(
    r"[A-Z](?<![\w/\-][A-Z])(?:\d{8}|(?<=I)D\d{4}-\d{4}-[A-Z]|[A-Z]\d{2}(?:[ \n]?\d{4}){3,6}(?:[ \n]?\d{1,4})?|(?<=Q)Q[ \n]?\d\d[ \n]?\d\d[ \n]?\d\d[ \n]?[A-D])(?![\w/])"
)
ID_LABELLED = re.compile(r"\d(?<![\w/.\-]\d)(?:\d\d[ \n\-]\d\d[ \n\-]\d{4}|\d[ \n]\d{3}[ \n]\d{3}[ \n]\d{3})(?![\w/])")
ID_LABEL = re.compile(r"(?i)\b(?:ssn|social\s+security|tax\s+(?:id|number)|insurance|identity|passport|national\s+id|steuer|ausweis|sozialversicherung|identit|identidad|fiscal|contribuinte|nif|nie|dni|codice)")
THING_LABEL = re.compile(r"(?i)(?:part\s+number|\bINV|\bform|\blist|version|\bserial|\bitem|\border)\s*$")
TOWN = r"[A-ZÀ-Þ][a-zà-ÿ]+(?:[ \n](?:\d{5}|[A-Z]{2}\d{3})(?!\w))?"
PLACE = r"[A-ZÀ-Þ][\wà-ÿ'’-]+(?:\s[A-ZÀ-Þ][\wà-ÿ-]+)?"
STREETS = "Street Road Lane Avenue Court Close Hill Terrace Row Way Drive Square Place Gardens Crescent Walk Mews".split()
RUES = "rue place avenue boulevard chemin allée quai impasse".split()
CALLES = "Calle Avenida Plaza Paseo Via Viale Piazza Corso Largo Rua Praça Travessa".split()
STRASSEN = "straße strasse gasse platz weg allee ring damm ufer".split()
BOXES = ("Postfach", "Apartado", "Casella", "Caixa", "BP")
# Each form of address with words of which it holds one.
ADDRESSES = (
    (("Box",), re.compile(rf"P\.[ ]?O\.\s?Box\s\d+,\s{TOWN}")),
    (tuple(f"{w}," for w in STREETS), re.compile(rf"(?:F(?=lat)lat\s\d+[a-z]?,\s\d{{1,4}}|\d(?<![\w/.\-]\d)\d{{0,3}})[a-z]?\s(?:[A-Z][a-z]+\s){{1,3}}(?:{'|'.join(STREETS)}),\s{TOWN}")),
    (tuple(RUES), re.compile(rf"\d(?<![\w/.\-]\d)\d{{0,3}}[a-z]?,?\s(?:{'|'.join(RUES)})\s(?:(?:de\sla|des|du|de|aux?)\s)?(?:[dl]['’])?{PLACE},\s\d{{5}}\s[A-ZÀ-Þ][a-zà-ÿ]+")),
    (tuple(CALLES), re.compile(rf"[A-Z](?<!\w[A-Z])(?:{'|'.join(f'(?<={w[0]}){w[1:]}' for w in CALLES)})\s(?:(?:de|del|de\sla|da|do|dos|das|di|della|dei)\s)?{PLACE},?\s\d{{1,4}}[a-z]?,\s\d{{5}}\s[A-ZÀ-Þ][a-zà-ÿ]+")),
    (tuple(f"{w} " for w in STRASSEN) + tuple(f"{w}\n" for w in STRASSEN), re.compile(rf"[A-ZÄÖÜ](?<!\w[A-ZÄÖÜ])[\wäöüß-]*(?:{'|'.join(STRASSEN)})\s\d{{1,4}}[a-z]?,\s\d{{5}}\s[A-ZÀ-Þ][a-zà-ÿ]+")),
    (BOXES, re.compile(r"[A-Z](?<!\w[A-Z])(?:(?<=P)ostfach|(?<=A)partado|(?<=C)asella\sPostale|(?<=C)aixa\sPostal|(?<=B)P)\s\d+,\s\d{5}\s[A-ZÀ-Þ][a-zà-ÿ]+")),
)
KINDS = ("email", "phone", "id_number", "address", "person")

# Words before or after a name.
TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|Mme|Mlle|Sra?|Srta|Sig|Dott)\.?"
TITLE_WORD = re.compile(rf"{TITLES}$")
UPPER, LOWER = "A-ZÀ-ÞŁŚŻŠČŽĐĆŘŞİŐŰΑ-ΩА-ЯЁІЇЄ", "a-zß-ÿĀ-žα-ωά-ώа-яёіїєґ"
NAME = rf"[{UPPER}][{LOWER}]+"
CONTACT = rf"\s*(?:,|\(|;|\||\t|\s{{2,}}|\.{{3,}})\s*\(*(?:[+0]\d|\(?\d{{3}}\)?[ .\-]\d{{3}}[ .\-]|[\w.+\-]+{AT})"
ACTION = r",?\s(?:has\sasked|lives\sat|residing|habite|vive\sen|abita|mora\sn|wohnt)"
# The look-ahead for a capital comes first, since most places fail there.
GIVEN_FIRST = re.compile(rf"(?=[{UPPER}])\b(?:(?=[MDPHFS])({TITLES})\s)?({NAME}+)\s((?:[{UPPER}]\.\s)?({NAME}+))(?(1)|(?={CONTACT}|{ACTION}))")
SURNAME_FIRST = re.compile(rf"(?=[MDPHFS])\b{TITLES}\s({NAME}),\s({NAME})")
PART = re.compile(rf"[{UPPER}](?:[{UPPER}{LOWER}]+|\.(?<!\w..))")


def learn_names(text: str, given: Counter, surname: Counter) -> None:
    """Count the name parts in the unambiguous places of a text."""
    for m in GIVEN_FIRST.finditer(text):
        given[m.group(2)] += 1
        surname[m.group(4)] += 1
    for m in SURNAME_FIRST.finditer(text):
        surname[m.group(1)] += 1
        given[m.group(2)] += 1


def persons(text: str, given: frozenset[str], surname: frozenset[str]) -> list[tuple[int, int]]:
    """Spans of given name or initials with surname, or surname, given name; also the unambiguous mentions themselves."""
    parts = [(m.start(), m.end(), m.group()) for m in PART.finditer(text)]
    out, i, n = [], 0, len(parts)

    def near(k: int, between: tuple[str, ...]) -> bool:
        return k + 1 < n and text[parts[k][1] : parts[k + 1][0]] in between

    blank, comma = (" ", "\n"), (", ", ",\n")
    while i < n:
        word = parts[i][2]
        initial = word[-1] == "."
        name = word if initial or word[1:].islower() else word.capitalize()
        if initial or name in given:
            j = i
            while near(j, blank) and parts[j + 1][2][-1] == ".":
                j += 1
            if near(j, blank) and parts[j + 1][2].capitalize() in surname:
                out.append((parts[i][0], parts[j + 1][1]))
                i = j + 2
                continue
        if not initial and name in surname and near(i, comma):
            follow = parts[i + 1][2]
            if follow[-1] == "." or follow.capitalize() in given:
                j = i + 1
                while near(j, blank) and parts[j + 1][2][-1] == ".":
                    j += 1
                if not (near(j, blank) and parts[j + 1][2].capitalize() in surname):
                    out.append((parts[i][0], parts[j][1]))
                    i = j + 1
                    continue
        i += 1
    for m in GIVEN_FIRST.finditer(text):
        a, b = m.start(3 if TITLE_WORD.match(m.group(2)) else 2), m.end(4)
        if a < m.start(4) and all(b <= s or a >= e for s, e in out):
            out.append((a, b))
    return sorted(out)


def local_start(text: str, at: int) -> int:
    """Where the run of characters of a mailbox name that ends before a place begins."""
    while at and (text[at - 1].isalnum() or text[at - 1] in "_.+-"):
        at -= 1
    return at


def emails(text: str) -> list[tuple[int, int]]:
    out, last = [], 0
    for m in AT_SIGN.finditer(text):
        end, plain = m.start(), m.group() == "@"
        if not plain and end and text[end - 1].isspace():
            end -= 1
        start = max(last, local_start(text, end))
        domain = (PLAIN_DOMAIN if plain else DOMAIN).match(text, m.end())
        if domain and start < end and (text[start].isalnum() or text[start] == "_") and (text[end - 1].isalnum() or text[end - 1] == "_"):
            out.append((start, domain.end()))
            last = domain.end()
    return out


def entities(text: str, given: frozenset[str], surname: frozenset[str]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every entity, in order and without overlap; earlier kinds of KINDS win, then the earlier start."""
    found: list[list[tuple[int, int]]] = [emails(text)]
    found.append(sorted(m.span() for p in (PHONES if "+" in text else PHONES[1:]) for m in p.finditer(text)))
    ids = [m.span() for m in ID_SELF.finditer(text)]
    for m in ID_LABELLED.finditer(text):
        before = text[max(0, m.start() - 60) : m.start()]
        if ID_LABEL.search(before) and not THING_LABEL.search(before):
            ids.append(m.span())
    found.append(sorted(ids))
    found.append(sorted(m.span() for words, p in ADDRESSES if any(w in text for w in words) for m in p.finditer(text)))
    found.append(persons(text, given, surname))
    taken: list[tuple[int, int, str]] = []
    for kind, spans in zip(KINDS, found):
        if not taken:
            last = 0
            for a, b in spans:
                if a >= last:
                    taken.append((a, b, kind))
                    last = b
            continue
        starts, last, free = [x[0] for x in taken], 0, []
        for a, b in spans:
            i = bisect_right(starts, a)
            if a >= last and (not i or taken[i - 1][1] <= a) and (i == len(starts) or b <= starts[i]):
                free.append((a, b, kind))
                last = b
        if free:
            taken = sorted(taken + free)
    return taken


def identity(kind: str, found: str) -> str:
    """What two mentions must share to be the same entity: forms of writing are dropped."""
    plain = " ".join(found.split()).lower()
    if kind in ("phone", "id_number"):
        return re.sub(r"[^0-9a-z+]", "", plain)
    if kind == "email":
        return re.sub(r"\s?[\[(]\s?dot\s?[\])]\s?", ".", re.sub(r"\s?[\[(]\s?at\s?[\])]\s?", "@", plain))
    if kind == "person" and "," in plain:
        last, _, first = plain.partition(",")
        return f"{first.strip()} {last.strip()}"
    return plain


# Letters that stand for each other, by script and sound; other letters stay.
LETTERS = (
    "bcdfghjklmnpqrstvwxz", "aeiouy", "àáâãäåèéêëìíîïòóôõöøùúûüýÿ", "çñśżšžđćčřşł",
    "бвгджзйклмнпрстфхцчшщ", "аеёиоуыэюяіїє", "βγδζθκλμνξπρστφχψ", "αεηιουωάέήίόύώ",
)
PLACE_OF = {c: (k, i) for k, row in enumerate(LETTERS) for i, c in enumerate(row)}
FEMININE = "aаяα"
# Words of an address and of a disguised form that name no one.
ADDRESS_TERMS = frozenset(
    w.lower() for w in (*STREETS, *RUES, *CALLES, *BOXES, *"Postale Postal Flat Box P O de la des du aux au d l del da do dos das di della dei".split())
)
DISGUISE = re.compile(r"(?i)[\[(]\s?(?:at|dot)\s?[\])]")
RUN = re.compile(r"[^\W\d_]+|\d+")
ROUNDS = 6


@lru_cache(maxsize=1 << 16)
def shifted(value: int, size: int, key: bytes, tweak: str) -> int:
    """The image of a value in [0, size) under a keyed permutation without fixed points.

    A balanced Feistel network with cycle walking is a permutation p of [0, size); the image is the inverse of p at
    p(value) + 1, so that all values form one cycle and none stays for size >= 2.
    """
    if size < 2:
        return value
    half = (max(2, (size - 1).bit_length()) + 1) // 2
    mask = (1 << half) - 1

    def turn(v: int, order) -> int:
        while True:
            a, b = v >> half, v & mask
            for r in order:
                h = hashlib.blake2b(f"{tweak}|{r}|{b}".encode(), key=key[:64], digest_size=(half + 7) // 8 if half <= 512 else 64).digest()
                a, b = b, a ^ (int.from_bytes(h, "big") & mask)
            v = b << half | a
            if v < size:
                return v

    there = turn(value, range(ROUNDS))
    return turn((there + 1) % size, range(ROUNDS - 1, -1, -1))


PIECE = 24  # characters that are permuted together


def permuted(text: str, key: bytes, tweak: str) -> str:
    """A string of lower-case letters and digits with every letter in its own row of LETTERS and every digit a digit.

    Injective on all strings: pieces of a fixed length are permuted, each under what comes before it and under the pattern
    of its rows, which the image keeps.
    """
    if len(text) > PIECE:
        return "".join(permuted(text[i : i + PIECE], key, f"{tweak}|{text[:i]}") for i in range(0, len(text), PIECE))
    rows = [("0123456789", i) if c.isdecimal() and (i := "0123456789".find(c)) >= 0 else (LETTERS[PLACE_OF[c][0]], PLACE_OF[c][1]) if c in PLACE_OF else (c, 0) for c in text]
    value, size = 0, 1
    for row, i in rows:
        value, size = value * len(row) + i, size * len(row)
    pattern = " ".join(row[0] for row, _ in rows)
    value = shifted(value, size, key, f"{tweak}|{pattern}")
    out = []
    for row, _ in reversed(rows):
        value, i = divmod(value, len(row))
        out.append(row[i])
    return "".join(reversed(out))


@lru_cache(maxsize=1 << 16)
def name_word(word: str, key: bytes) -> str:
    """The surrogate of a lower-case word: the first letter by itself, so that initials agree, the rest under it.

    A feminine ending stays one, and no other word gets one.
    """
    first = permuted(word[0], key, "first")
    rest, end = word[1:], ""
    if len(word) > 2 and rest[-1] in FEMININE:
        rest, end = rest[:-1], rest[-1]
    made = first + permuted(rest, key, f"rest|{word[0]}|{end}") + end
    if len(made) > 2 and not end and made[-1] in FEMININE:  # walk on along the cycle, which leaves the map injective
        while made[-1] in FEMININE:
            rest = made[1:]
            made = first + permuted(rest, key, f"rest|{word[0]}|{end}")
    return made


def cased(made: str, like: str) -> str:
    return made.upper() if like.isupper() and len(made.upper()) == len(made) else made[:1].upper() + made[1:] if like[:1].isupper() else made


def surrogate(kind: str, found: str, key: bytes) -> str:
    """A replacement of the same format: digits for digits, letters of the same script, sound and case for letters.

    The words of a person are replaced one by one, so that a surname keeps its surrogate whether it is written first or
    last. All digits of a number, and its letters, are replaced together. Marks, spaces, words of disguised forms and of
    addresses, country prefixes (+49, DE12) and leading zeros stay.
    """
    kept = [m.span() for m in DISGUISE.finditer(found)] if kind == "email" else []
    runs = [m for m in RUN.finditer(found) if not any(a <= m.start() < b for a, b in kept)]
    if kind == "phone" and found[0] == "+" or kind == "id_number" and len(runs) > 1 and len(runs[0].group()) == 2:
        runs = runs[1:]
    if kind == "address":
        runs = [m for m in runs if m.group().lower() not in ADDRESS_TERMS] or runs
    if kind in ("phone", "id_number"):
        joined = "".join(m.group() for m in runs).lower()
        zeros = len(joined) - len(joined.lstrip("0")) if len(set(joined)) > 1 else 0
        made = joined[:zeros] + permuted(joined[zeros:], key, f"{kind}|{zeros}")
        words, at = [], 0
        for m in runs:
            words.append(made[at : at + len(m.group())])
            at += len(m.group())
    else:
        words = [permuted(m.group(), key, kind) if m.group().isdecimal() else name_word(m.group().lower(), key) if len(m.group().lower()) == len(m.group()) else m.group() for m in runs]
    out, at = [], 0
    for m, w in zip(runs, words):
        out += [found[at : m.start()], cased(w, m.group())]
        at = m.end()
    return "".join(out) + found[at:]


def replace(text: str, given: frozenset[str], surname: frozenset[str], key: bytes) -> tuple[str, str, list[tuple[str, str]]]:
    """(text with typed placeholders, text with surrogates, [(kind, found text)]).

    Distinct entities have distinct surrogates under one key wherever they stand. Should two forms of writing of distinct
    entities still meet in one text, the later one gets its placeholder instead, so that they are never taken for one.
    """
    numbers: dict[tuple[str, str], int] = {}
    count: Counter = Counter()
    owners: dict[tuple[str, str], tuple[str, str]] = {}
    holders, surrogates, found_items, at = [], [], [], 0
    for a, b, kind in entities(text, given, surname):
        found = text[a:b]
        who = (kind, identity(kind, found))
        if who not in numbers:
            count[kind] += 1
            numbers[who] = count[kind]
        holder = f"[{kind.upper()}_{numbers[who]}]"
        s = surrogate(kind, found, key)
        if owners.setdefault((kind, identity(kind, s)), who) != who:
            s = holder
        holders += [text[at:a], holder]
        surrogates += [text[at:a], s]
        found_items.append((kind, found))
        at = b
    holders.append(text[at:])
    surrogates.append(text[at:])
    return "".join(holders), "".join(surrogates), found_items


class Widened:
    """A set and a few words more, without copying the set."""

    def __init__(self, words: frozenset[str], more: list[str]):
        self.words, self.more = words, frozenset(more)

    def __contains__(self, word: str) -> bool:
        return word in self.words or word in self.more


def name_table(texts: DataFrame) -> DataFrame:
    """(word, role, n) of every name part in an unambiguous place of any text; a word has the role in which it is seen more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, surname = Counter(), Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                learn_names(t, given, surname)
            if len(given) + len(surname) > 1_000_000:
                yield emit(given, surname)
                given.clear()
                surname.clear()
        yield emit(given, surname)

    def emit(given: Counter, surname: Counter) -> pa.RecordBatch:
        rows = [(w, given[w], surname[w]) for w in {*given, *surname} if not TITLE_WORD.match(w)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], ["word", "g", "s"])

    counted = texts.select("text").filter("text is not null").mapInArrow(run, "word string, g bigint, s bigint").groupBy("word").agg(F.sum("g").alias("g"), F.sum("s").alias("s"))
    return counted.select("word", F.when(F.col("g") >= F.col("s"), "g").otherwise("s").alias("role"), F.greatest("g", "s").alias("n"))


def with_names(texts: DataFrame, names: tuple[frozenset[str], frozenset[str]] | None, most: int = MAX_NAMES) -> tuple[DataFrame, tuple[frozenset[str], frozenset[str]]]:
    """(texts with the columns more_given and more_surname, (given names, surnames) for the broadcast).

    The most frequent name parts are broadcast. Where there are more, the capitalised words of each text are joined with
    the table of the rest, and what is found travels beside the text.
    """
    none = F.array().cast("array<string>")
    plain = texts.withColumns({"more_given": none, "more_surname": none})
    if names is not None:
        return plain, names
    table = materialise(name_table(texts), "names")
    top = table.orderBy(F.desc("n"), "word").limit(most).collect()
    given, surname = (frozenset(r.word for r in top if r.role == role) for role in "gs")
    if len(top) < most:
        return plain, (given, surname)
    last = top[-1]
    rest = table.filter((F.col("n") < last.n) | (F.col("n") == last.n) & (F.col("word") > last.word)).select("word", "role")
    shared = texts.sparkSession.sparkContext.broadcast(given | surname)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column("text_key").to_pylist(), b.column("text").to_pylist()):
                rows += [(k, w) for w in {m.group().capitalize() for m in PART.finditer(t)} - shared.value]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["text_key", "word"])

    keyed = texts.withColumn("text_key", F.sha2("text", 256))
    found = keyed.select("text_key", "text").filter("text is not null").mapInArrow(run, "text_key string, word string").distinct().join(rest, "word")
    more = found.groupBy("text_key").agg(*[F.collect_set(F.when(F.col("role") == r, F.col("word"))).alias(c) for r, c in (("g", "more_given"), ("s", "more_surname"))])
    return keyed.join(more, "text_key", "left").drop("text_key"), (given, surname)


def widened(batch: pa.RecordBatch, names: tuple[frozenset[str], frozenset[str]]) -> Iterator[tuple]:
    """(file_id, text, given names, surnames) of the rows of a batch."""
    for i, t, g, s in zip(*[batch.column(c).to_pylist() for c in ("file_id", "text", "more_given", "more_surname")]):
        yield (i, t, Widened(names[0], g), Widened(names[1], s)) if g or s else (i, t, *names)


def find_entities(texts: DataFrame, names: tuple[frozenset[str], frozenset[str]] | None = None, key: str = "quill") -> DataFrame:
    """(file_id, kind, found_text), distinct, of every personal item that replace() replaces.

    texts: (file_id, text); further columns are ignored. Null and empty texts give no row, repeated rows count once.
    names: (given names, surnames); learned from the texts if not given.
    """
    source, listed = with_names(texts.select("file_id", "text").filter("file_id is not null and text is not null"), names)
    shared, secret = texts.sparkSession.sparkContext.broadcast(listed), key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, given, surname in widened(b, shared.value):
                rows += {(i, k, found) for k, found in replace(t, given, surname, secret)[2]}
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.int64(), pa.string(), pa.string()))], ["file_id", "kind", "found_text"])

    return source.mapInArrow(run, "file_id bigint, kind string, found_text string").distinct()


def redact(texts: DataFrame, key: str = "quill", names: tuple[frozenset[str], frozenset[str]] | None = None) -> DataFrame:
    """(file_id, redacted, surrogated): each text with typed numbered placeholders, and with keyed surrogates.

    The rest of a text stays as it is; texts without entities come back unchanged, null texts as null; one row for every
    input row. The same entity has the same surrogate in every document under one key, different ones different surrogates.
    """
    source, listed = with_names(texts.select("file_id", "text"), names)
    shared = texts.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(None, None) if t is None else replace(t, given, surname, key.encode())[:2] for _, t, given, surname in widened(b, shared.value)]
            yield pa.RecordBatch.from_arrays([b.column("file_id").cast(pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["file_id", "redacted", "surrogated"])

    return source.mapInArrow(run, "file_id bigint, redacted string, surrogated string")
