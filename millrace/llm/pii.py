"""Surrogates for personal data: keyed, of the same type and format, distinct, and the same
for every mention of one entity.

Found are e-mail addresses, IPv4 addresses, payment cards and other long digit groups, phone and
social security numbers, IBANs, and names of persons after a title or a known given name, with
initials between. All other whole-word mentions of a name so found in a text are replaced too.

Letters and digits are replaced by a keyed permutation of all strings of the entity's format
(a ten-round Feistel network over the two halves), so two entities can't share a surrogate. Where a
surrogate has to keep a property (a valid check digit, bytes below 256, not being a known given
name), the permutation is applied again until it does, which stays one to one. Given names
are exchanged within the names of the same gender and script by a keyed rotation. The mentions of
the whole corpus are then checked for collisions before any text is written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wordhash import small

# Titles and given names, by gender and script.
TITLES = {
    "m": "Mr Mister Sir Herr Monsieur Señor Sr Don Господин Κύριος".split(),
    "f": "Mrs Ms Miss Madam Frau Madame Mme Señora Sra Señorita Госпожа Κυρία".split(),
    "n": "Dr Prof Professor Doctor Доктор".split(),
}
NAMES = {
    ("m", "latin"): "Adam Andrew Anthony Antonio Carlos Charles Christopher Daniel David Diego "
    "Edward Francisco François Friedrich Georg George Hans Heinrich Henri Jacques James Javier "
    "Jean John Joseph José Juan Jürgen Karl Klaus Kevin Luis Manuel Marcel Mark Matthew Michael "
    "Miguel Paul Peter Philippe Pierre Richard Robert Steven Thomas William Wolfgang".split(),
    ("f", "latin"): "Alice Amelie Andrea Angela Anna Barbara Brigitte Camille Carmen Catherine "
    "Chloé Dolores Elizabeth Emily Emma Françoise Gisela Greta Hannah Helga Inés Ingrid Isabel "
    "Jennifer Jessica Karen Laura Linda Lisa Lucía Margaret María Maria Mary Monika Nancy "
    "Patricia Petra Pilar Sandra Sarah Sophie Susan Sylvie Teresa Ursula Valérie".split(),
    ("m", "cyrillic"): "Александр Алексей Андрей Владимир Дмитрий Иван Михаил Николай Сергей".split(),
    ("f", "cyrillic"): "Анна Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("m", "greek"): "Γιώργος Γιάννης Δημήτρης Κώστας Νίκος Παναγιώτης".split(),
    ("f", "greek"): "Αικατερίνη Βασιλική Γεωργία Ελένη Μαρία Σοφία".split(),
}
_GROUP = {name: group for group, names in NAMES.items() for name in names}
# Letters a letter may become, so that case, script, and vowel or consonant stay.
CLASSES = [
    "0123456789",
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "àáâäèéêëìíîïòóôöùúûü", "çñß", "ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ", "ÇÑ",
    "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
]
_CLASS = {c: letters for letters in CLASSES for c in letters}

_CAPITAL = "A-ZÀ-ÖØ-ÞΑ-ΩΆ-ΏЁА-Я"
_SMALL = "a-zß-öø-ÿα-ωά-ώёа-я"
# Capitals and apostrophes may stand within: O'Brien, McDonald.
_PART = rf"(?:[{_CAPITAL}]['’])?[{_CAPITAL}][{_SMALL}]+(?:['’]?[{_CAPITAL}][{_SMALL}]*)*"
_WORD = rf"{_PART}(?:-{_PART})*"
_INITIALS = rf"(?:[{_CAPITAL}](?:\.[ -]?| ))*"
_MAIL = re.compile(r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_NUMBER = re.compile(r"\d[\d ().-]*\d")
_IPV4 = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)")
_CARD = re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\d)")
_COUNTRY = re.compile(r"\+(\d{1,3})[ .-]")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_PHONE = re.compile(
    r"(?<!\d)(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,12}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}([.-])\d{3}\1\d{4})(?!\d)"
)
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NAME = re.compile(rf"[{_CAPITAL}][{_SMALL}]+")
_TITLED = re.compile(rf"\.? ({_INITIALS})({_WORD})(?: ({_INITIALS})({_WORD}))?")
_FAMILY = re.compile(rf" ({_INITIALS})({_WORD})")
_LETTER = re.compile(rf"[{_CAPITAL}]")
_WHOLE = re.compile(_WORD)
_WITHIN = re.compile("[^-'’]+")
_TITLE = {title for titles in TITLES.values() for title in titles}
_RANK = ("email", "iban", "ipv4", "ssn", "card", "phone", "person", "initial", "family")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


class Keyed:
    """Keyed permutations of strings that share a format."""

    def __init__(self, key: str) -> None:
        self.key = blake2b(key.encode(), digest_size=32).digest()

    def _number(self, text: str, below: int) -> int:
        size = max(16, below.bit_length() // 8 + 8)
        return int.from_bytes(blake2b(text.encode(), key=self.key, digest_size=min(64, size)).digest()) % below

    def _feistel(self, form: str, a: int, m: int, b: int, n: int) -> tuple[int, int]:
        """A permutation of the pairs of numbers below m and n."""
        for turn in range(5):
            a = (a + self._number(f"{form}|{turn}|a|{b}", m)) % m
            b = (b + self._number(f"{form}|{turn}|b|{a}", n)) % n
        return a, b

    def permute(self, kind: str, text: str) -> str:
        """Another string with every character from the class of the one it replaces."""
        places = [k for k, c in enumerate(text) if c in _CLASS]
        if not places:
            return text
        form = kind + "|" + "".join(_CLASS[c][0] if c in _CLASS else c for c in text)
        half = (len(places) + 1) // 2
        halves, sides = (places[:half], places[half:]), []
        for part in halves:
            value, space = 0, 1
            for k in part:
                letters = _CLASS[text[k]]
                value = value * len(letters) + letters.index(text[k])
                space *= len(letters)
            sides += [value, space]
        out = list(text)
        for part, value in zip(halves, self._feistel(form, *sides)):
            for k in reversed(part):
                letters = _CLASS[text[k]]
                value, at = divmod(value, len(letters))
                out[k] = letters[at]
        return "".join(out)

    def until(self, kind: str, text: str, good) -> str:
        """The first of text's repeated permutations that is good; one to one on good texts."""
        found = self.permute(kind, text)
        while not good(found):
            found = self.permute(kind, found)
        return found

    def surrogate(self, kind: str, entity: str) -> str:
        """What replaces the canonical form of an entity."""
        if kind == "email":
            local, _, domain = entity.partition("@")
            return self.permute("local", local) + "@" + self._domain(domain)
        if kind == "ipv4":
            w, x, y, z = map(int, entity.split("."))
            a, b = self._feistel(kind, 256 * w + x, 65536, 256 * y + z, 65536)
            return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
        if kind == "card":
            # The first digit tells the issuer's kind and stays.
            head = entity[0]
            return head + self.until(kind, entity[1:], lambda x: luhn(head + x) == luhn(entity))
        if kind == "phone":  # a country code stays
            code, _, rest = entity.rpartition(" ")
            return f"{code} {self.permute(kind, rest)}"
        if kind == "person":
            return self._person(entity)
        if kind == "initial":
            return self._initial(entity)
        if kind == "family":
            return self.until(kind, entity, lambda x: x not in _GROUP)
        return self.permute(kind, entity)

    def _domain(self, domain: str) -> str:
        *names, last = domain.split(".")
        return ".".join([self.permute("domain", ".".join(names)), last])

    def _person(self, word: str) -> str:
        names = NAMES[_GROUP[word]]
        shift = 1 + self._number("given|" + "|".join(_GROUP[word]), len(names) - 1)
        return names[(names.index(word) + shift) % len(names)]

    def _initial(self, letter: str) -> str:
        letters = _CLASS.get(letter, letter)
        shift = 1 + self._number("initial|" + letters, len(letters) - 1) if len(letters) > 1 else 0
        return letters[(letters.index(letter) + shift) % len(letters)]


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """Non-overlapping (start, end, kind, canonical form), by start."""
    found: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        local = _LOCAL.search(text, max(0, at - 64), at)
        domain = _MAIL.match(text, at + 1)
        if local and domain:
            # Case is not told apart in a domain.
            name = text[local.start() : at] + "@" + domain.group().lower()
            found.append((local.start(), domain.end(), "email", name))
        at = text.find("@", at + 1)
    for run in _NUMBER.finditer(text):
        found += _numbers(text, max(0, run.start() - 2), run.end())
    for m in _IBAN.finditer(text):
        if not text[m.start() - 1 : m.start()].isalnum():
            found.append((*m.span(), "iban", m.group().replace(" ", "")))
    for m in _NAME.finditer(text):
        word = m.group()
        if (word in _TITLE or word in _GROUP) and not text[m.start() - 1 : m.start()].isalnum():
            found += _persons(text, m.start(), m.end(), word)
    kept: list[tuple[int, int, str, str]] = []
    for one in sorted(found, key=lambda x: (x[0], _RANK.index(x[2]), -x[1])):
        if not kept or one[0] >= kept[-1][1]:
            kept.append(one)
    return _with_later(text, kept)


def _with_later(
    text: str, kept: list[tuple[int, int, str, str]]
) -> list[tuple[int, int, str, str]]:
    """Add all other whole-word mentions of the names in ``kept``, wherever they stand."""
    names: dict[str, str] = {}
    for _, _, kind, entity in kept:
        if kind in ("person", "family"):
            names.setdefault(entity, kind)
    if not names:
        return kept
    found = []
    for m in _WHOLE.finditer(text):
        if text[m.start() - 1 : m.start()].isalnum() or text[m.end() : m.end() + 1].isalnum():
            continue
        word = _plain(m.group())
        if word in names:
            found.append((*m.span(), names[word], word))
        else:  # Smith in Smith-Jones
            parts = _WITHIN.finditer(text, *m.span())
            found += [(*p.span(), names[p[0]], p[0]) for p in parts if p[0] in names]
    merged, at, until = [], 0, 0
    for one in found:
        while at < len(kept) and kept[at][0] < one[1]:
            merged.append(kept[at])
            until = kept[at][1]
            at += 1
        if one[0] >= until:
            merged.append(one)
    return merged + kept[at:]


def _plain(word: str) -> str:
    return word.replace("’", "'")


def _numbers(text: str, start: int, end: int) -> Iterator[tuple[int, int, str, str]]:
    for m in _IPV4.finditer(text, start, end):
        parts = [int(part) for part in m.group().split(".")]
        if max(parts) < 256:
            yield *m.span(), "ipv4", ".".join(map(str, parts))
    for kind, pattern in (("ssn", _SSN), ("card", _CARD), ("phone", _PHONE)):
        for m in pattern.finditer(text, start, end):
            digits = "".join(c for c in m.group() if c.isdigit())
            if code := _COUNTRY.match(m.group()):
                digits = f"{code[1]} {digits[len(code[1]) :]}"
            yield *m.span(), kind, digits


def _persons(text: str, start: int, end: int, word: str) -> Iterator[tuple[int, int, str, str]]:
    if word in _GROUP:
        if family := _FAMILY.match(text, end):
            yield start, end, "person", word
            yield from _initials(text, *family.span(1))
            yield *family.span(2), "family", _plain(family[2])
    elif named := _TITLED.match(text, end):
        for k in (1, 3):
            if named[k + 1]:
                yield from _initials(text, *named.span(k))
                part = _plain(named[k + 1])
                yield *named.span(k + 1), "person" if part in _GROUP else "family", part


def _initials(text: str, start: int, end: int) -> Iterator[tuple[int, int, str, str]]:
    for m in _LETTER.finditer(text, start, end):
        yield *m.span(), "initial", m.group()


def _shaped(kind: str, mention: str, surrogate: str) -> str:
    """The surrogate's digits or letters in the punctuation of this mention."""
    if kind == "family" and "’" in mention:
        marks = iter(c for c in mention if c in "'’")
        return "".join(next(marks) if c == "'" else c for c in surrogate)
    if kind not in ("card", "phone", "ssn", "iban"):
        return surrogate
    rest = (c for c in surrogate if c.isalnum())
    return "".join(next(rest) if c.isalnum() else c for c in mention)


class SurrogateCollision(RuntimeError):
    """Two entities would have been given the same surrogate."""


def entities(docs: DataFrame, key: str) -> DataFrame:
    """``kind, entity, surrogate`` per distinct entity of all texts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Keyed(key)
        make = lru_cache(100_000)(keyed.surrogate)
        for batch in small(batches):
            seen = {
                (kind, entity): make(kind, entity)
                for text in batch.column(0).to_pylist()
                if text
                for _, _, kind, entity in mentions(text)
            }
            columns = [[k for k, _ in seen], [e for _, e in seen], list(seen.values())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string()) for c in columns], ["kind", "entity", "surrogate"]
            )

    found = docs.select("text").mapInArrow(find, "kind string, entity string, surrogate string")
    return found.distinct()


def check_distinct(found: DataFrame) -> None:
    """Raise :class:`SurrogateCollision` if two entities of a kind have one surrogate."""
    shared = found.groupBy("kind", "surrogate").agg(
        F.min("entity").alias("one"), F.max("entity").alias("other")
    )
    clash = shared.filter("one <> other").first()
    if clash:
        raise SurrogateCollision(f"two entities of kind {clash['kind']} share a surrogate")


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """Replace personal data in column text; add n_entities and kinds (list of those found).

    All other columns pass through; columns of the added names are replaced. A null text
    stays null, an empty one empty, both with no entity. Whole texts are searched. The same
    key gives the same surrogates in every run. The corpus is searched once before for
    collisions, which is a job when this is called.
    """
    check_distinct(entities(docs, key))
    return replaced(docs, key)


def replaced(docs: DataFrame, key: str) -> DataFrame:
    docs = docs.select(*(c for c in docs.columns if c not in ("n_entities", "kinds")))
    place = docs.columns.index("text")
    names = [*docs.columns, "n_entities", "kinds"]

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = lru_cache(100_000)(Keyed(key).surrogate)
        for batch in small(batches):
            texts, counts, kinds = [], [], []
            for text in batch.column(place).to_pylist():
                found = mentions(text) if text else []
                parts, at = [], 0
                for start, end, kind, entity in found:
                    parts += [text[at:start], _shaped(kind, text[start:end], make(kind, entity))]
                    at = end
                texts.append("".join([*parts, text[at:]]) if found else text)
                counts.append(len(found))
                kinds.append(sorted({kind for _, _, kind, _ in found}))
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            columns += [pa.array(counts, pa.int64()), pa.array(kinds, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    added = T.StructType().add("n_entities", "long").add("kinds", T.ArrayType(T.StringType()))
    return docs.mapInArrow(replace, T.StructType([*docs.schema, *added]))
