"""Format-preserving pseudonyms for personal data.

A value found in a text and valid for its kind is replaced by another of the same format: its digits and letters, read
as one number of mixed radices, go through a keyed permutation of all such numbers. The permutation is a Feistel network
over two halves of nearly the square root of the range each; results outside the range go through it again, which keeps
it a permutation. Check digits are computed anew and dates stay dates. Equal values of a kind have equal pseudonyms in
every document, different ones different pseudonyms, and the key's owner can go back."""

from __future__ import annotations

import hmac
import re
from calendar import monthrange
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetledger.llm.common import text_slices

ROUNDS = 8
#: For tests and trials; in production the caller passes a secret.
TRIAL_KEY = b"trial key"
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)


class Permutation:
    """A keyed permutation of range(size) for each kind of value."""

    def __init__(self, key: bytes):
        self.key = blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, size: int, turn: int, half: int) -> int:
        return int.from_bytes(hmac.digest(self.key, f"{kind}/{size}/{turn}/{half}".encode(), "sha256"))

    def _once(self, kind: str, size: int, x: int, a: int, b: int, back: bool) -> int:
        left, right = divmod(x, b)
        for turn in range(ROUNDS)[:: -1 if back else 1]:
            sign = -1 if back else 1
            if turn % 2:
                right = (right + sign * self._round(kind, size, turn, left)) % b
            else:
                left = (left + sign * self._round(kind, size, turn, right)) % a
        return left * b + right

    def apply(self, kind: str, size: int, x: int, back: bool = False) -> int:
        a = isqrt(size - 1) + 1 if size > 1 else 1
        b = -(-size // a)
        x = self._once(kind, size, x, a, b, back)
        while x >= size:
            x = self._once(kind, size, x, a, b, back)
        return x


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _alphabet(c: str) -> str | None:
    return next((a for a in (_DIGITS, _LOWER, _UPPER) if c in a), None)


def permute_characters(p: Permutation, kind: str, value: str, back: bool = False) -> str:
    """Digits to digits and letters to letters of the same case; other characters stay."""
    alphabets = [_alphabet(c) for c in value]
    shape = "".join("-" if a is None else a[0] for a in alphabets)
    x, size = 0, 1
    for c, a in zip(value, alphabets, strict=True):
        if a:
            x, size = x * len(a) + a.index(c), size * len(a)
    if size == 1:
        return value
    x = p.apply(f"{kind}:{shape}", size, x, back)
    out = []
    for c, a in zip(reversed(value), reversed(alphabets), strict=True):
        if a:
            x, digit = divmod(x, len(a))
            c = a[digit]
        out.append(c)
    return "".join(reversed(out))


def _digits(value: str) -> str:
    return re.sub(r"\D", "", value)


def _refill(value: str, digits: str) -> str:
    left = iter(digits)
    return re.sub(r"\d", lambda _: next(left), value)


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _email(p: Permutation, m: re.Match, back: bool) -> str | None:
    local, domain = m[0].rsplit("@", 1)
    host, dot, top = domain.rpartition(".")
    return f"{permute_characters(p, 'local', local, back)}@{permute_characters(p, 'host', host, back)}{dot}{top}"


def _card(p: Permutation, m: re.Match, back: bool) -> str | None:
    digits = _digits(m[0])
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    payload = f"{p.apply(f'card{len(digits)}', 10 ** (len(digits) - 1), int(digits[:-1]), back):0{len(digits) - 1}d}"
    return _refill(m[0], payload + luhn_digit(payload))


def _iban(p: Permutation, m: re.Match, back: bool) -> str | None:
    plain = m[0].replace(" ", "")
    country, body = plain[:2], plain[4:]

    def remainder(text: str) -> int:
        return int("".join(str(int(c, 36)) for c in text)) % 97

    if not 15 <= len(plain) <= 34 or remainder(body + plain[:4]) != 1:
        return None
    body = permute_characters(p, f"iban{country}", body, back)
    left = iter(f"{country}{98 - remainder(body + country + '00'):02d}{body}")
    return re.sub(r"\S", lambda _: next(left), m[0])


def _address(p: Permutation, m: re.Match, back: bool) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255:
        return None
    x = p.apply("ip", 1 << 32, int.from_bytes(bytes(parts)), back)
    return ".".join(map(str, x.to_bytes(4)))


def _social(p: Permutation, m: re.Match, back: bool) -> str | None:
    """Nine digits; area 000, 666 and 900-999, group 00 and serial 0000 are never given, so never made either."""
    digits = _digits(m[0])

    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    if not valid(digits):
        return None
    while True:
        digits = f"{p.apply('social', 10**9, int(digits), back):09d}"
        if valid(digits):
            return _refill(m[0], digits)


def _phone(p: Permutation, m: re.Match, back: bool) -> str | None:
    digits = _digits(m[0])
    if not 8 <= len(digits) <= 15:
        return None
    lead = re.match(r"\+(\d{1,3})(?=\D)", m[0])
    code = lead[1] if lead else ""
    size = len(digits) - len(code)
    rest = f"{p.apply(f'phone{size}', 10**size, int(digits[len(code):]), back):0{size}d}"
    return _refill(m[0], code + rest)


def _day(p: Permutation, year: int, month: int, day: int, back: bool) -> date | None:
    if not (FIRST_DAY.year <= year <= LAST_DAY.year and 1 <= month <= 12 and 1 <= day <= monthrange(year, month)[1]):
        return None
    size = (LAST_DAY - FIRST_DAY).days + 1
    return FIRST_DAY + timedelta(p.apply("day", size, (date(year, month, day) - FIRST_DAY).days, back))


def _iso_date(p: Permutation, m: re.Match, back: bool) -> str | None:
    year, mark, month, day = m["y"], m["ymark"], m["ymonth"], m["yday"]
    new = _day(p, int(year), int(month), int(day), back)
    return new and f"{new.year:04d}{mark}{new.month:02d}{mark}{new.day:02d}"


def _local_date(p: Permutation, m: re.Match, back: bool) -> str | None:
    """Day first, or month first where only that makes a date with a slash."""
    mark, year = m["dmark"], int(m["dyear"])
    first, second = int(m["d1"]), int(m["d2"])
    new = _day(p, year, second, first, back)
    if new:
        return f"{new.day:02d}{mark}{new.month:02d}{mark}{new.year:04d}"
    new = _day(p, year, first, second, back) if mark == "/" else None
    return new and f"{new.month:02d}{mark}{new.day:02d}{mark}{new.year:04d}"


def _key_id(p: Permutation, m: re.Match, back: bool) -> str | None:
    return m[0][:4] + permute_characters(p, "key", m[0][4:], back)


def _secret(p: Permutation, m: re.Match, back: bool) -> str | None:
    return m["mark"] + permute_characters(p, "secret", m["value"], back)


#: Kinds in the order in which they claim a place: pattern and pseudonym. None means that the value isn't valid.
KINDS: dict[str, tuple[str, Callable[[Permutation, re.Match, bool], str | None]]] = {
    "email": (r"(?<![\w.+%-])[\w.+%-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])", _email),
    "secret": (
        r"(?i:(?P<mark>\b(?:pass(?:word|wd)?|pwd|token|secret|api[_-]?key|access[_-]?key)\s?[=:]\s?[\"']?))"
        r"(?P<value>[A-Za-z0-9_\-+/]{8,})",
        _secret,
    ),
    "key": (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", _key_id),
    "iban": (r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)\b", _iban),
    "iso_date": (r"(?<![\d.-])(?P<y>\d{4})(?P<ymark>[-/.])(?P<ymonth>\d\d)(?P=ymark)(?P<yday>\d\d)(?![\d-])", _iso_date),
    "local_date": (
        r"(?<![\d./-])(?P<d1>\d{1,2})(?P<dmark>[./-])(?P<d2>\d{1,2})(?P=dmark)(?P<dyear>(?:19|20)\d\d)(?![\d-])",
        _local_date,
    ),
    "ip": (r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)", _address),
    "social": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _social),
    "card": (r"(?<!\d)\d(?:[ -]?\d){12,}", _card),
    "phone": (
        r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}"
        r"|\(\d{2,4}\) ?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-])",
        _phone,
    ),
}
_PATTERNS = {kind: re.compile(pattern) for kind, (pattern, _) in KINDS.items()}
_WHOLE = re.compile(r".*", re.S)
_GROUP = re.compile(r"\d+")
_IBAN_START = re.compile(r"\b[A-Z]{2}\d{2}")
#: Digit groups as cards print them, and the digits that cards begin with. Such places come before others of their run.
_ISSUED = "23456"
_PRINTED = re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{4,5}")


def _card_places(text: str) -> Iterator[re.Match]:
    """Every stretch of 13 to 19 digits between borders of the groups of a run: the printed forms of the run first, then
    the longest from each group on. Other numbers before or after a card are groups of the same run. Where valid places
    overlap, the first in this order is taken, so that going back needs the places as pseudonymise returns them."""
    for run in _PATTERNS["card"].finditer(text):
        groups = [m.span() for m in _GROUP.finditer(text, *run.span())]
        printed, others = [], []
        for i, (a, _) in enumerate(groups):
            digits, ends = 0, []
            for c, d in groups[i : i + 19]:
                digits += d - c
                if digits > 19:
                    break
                if digits >= 13:
                    ends.append(d)
            for d in reversed(ends):
                (printed if _PRINTED.fullmatch(text, a, d) else others).append((a, d))
        printed.sort(key=lambda place: text[place[0]] not in _ISSUED)
        for a, d in printed + others:
            yield _WHOLE.fullmatch(text, a, d)


def _iban_places(text: str) -> Iterator[re.Match]:
    """From every start of an IBAN the longest match, then its shorter ends at spaces."""
    for start in _IBAN_START.finditer(text):
        m = _PATTERNS["iban"].match(text, start.start())
        while m:
            yield m
            cut = text.rfind(" ", m.start(), m.end())
            m = _PATTERNS["iban"].fullmatch(text, m.start(), cut) if cut > 0 else None


#: Kinds whose pattern may run into what stands beside a value: all places to try, in order.
_PLACES: dict[str, Callable[[str], Iterator[re.Match]]] = {"card": _card_places, "iban": _iban_places}
#: What every pattern needs somewhere; a text without it is left as it is.
NEEDED = r"[0-9@]|(?i:pass|pwd|token|secret|key)"


def pseudonymise(text: str, p: Permutation, back: bool = False) -> tuple[str, list[tuple[str, int, str, str]]]:
    """The text with pseudonyms, and what was replaced: kind, place in the old text, old and new value. A place belongs
    to the first kind, in the order of KINDS, that finds a valid value there; cards and IBANs are also looked for inside
    longer runs of groups."""
    taken: list[tuple[int, int, str, str]] = []
    claimed = bytearray(len(text))
    for kind, (_, make) in KINDS.items():
        for m in _PLACES.get(kind, _PATTERNS[kind].finditer)(text):
            if any(claimed[m.start() : m.end()]):
                continue
            new = make(p, m, back)
            if new is not None:
                taken.append((m.start(), m.end(), kind, new))
                claimed[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    if not taken:
        return text, []
    out, at, found = [], 0, []
    for a, b, kind, new in sorted(taken):
        out += [text[at:a], new]
        found.append((kind, a, text[a:b], new))
        at = b
    return "".join(out) + text[at:], found


@lru_cache(maxsize=4)
def _permutation(key: bytes) -> Permutation:
    return Permutation(key)


def with_pseudonyms(docs: DataFrame, key: bytes, text_column: str = "text") -> DataFrame:
    """docs with pseudonyms in text, and the columns n_values (how many were replaced) and kinds (which, in order,
    joined by commas). All other columns stay as they are, but for two of these names, which are replaced. A null text
    stays null and an empty one empty, both with no values. Equal rows stay equal."""
    plain = docs.drop(*({"n_values", "kinds"} - {text_column}))
    schema = f"`{text_column}` string, n_values long, kinds string"
    names = plain.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name != text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _permutation(key)
        for batch in text_slices(batches, text_column):
            column = batch.column(text_column)
            maybe = pc.match_substring_regex(column.fill_null(""), NEEDED).to_pylist()
            texts, counts, kinds = [], [], []
            for text, look in zip(column.to_pylist(), maybe, strict=True):
                found: list = []
                if look:
                    text, found = pseudonymise(text, p)
                texts.append(text)
                counts.append(len(found))
                kinds.append(",".join(sorted({f[0] for f in found})))
            rest = [n for n in names if n != text_column]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in rest), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.string())],
                names=[*rest, text_column, "n_values", "kinds"],
            )

    whole = plain.withColumn(text_column, F.col(text_column).cast("string"))
    return whole.mapInArrow(run, ", ".join(x for x in (types, schema) if x)).select(*names, "n_values", "kinds")
