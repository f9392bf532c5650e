"""Format-preserving Feistel pseudonyms for personal data.

A validated value is permuted within its own format under a key: digits stay digits, letters keep their case,
separators stay where they are, card numbers and IBANs stay valid, dates stay dates. The permutation depends on kind and format
alone, so an equal value has the same pseudonym in every document, and with the key it can be inverted. So the key is a secret: callers
name it, none is kept here.
"""

from __future__ import annotations

import datetime
import hashlib
import heapq
import ipaddress
import math
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

ROUNDS = 10
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_CLASS = {c: x for x in (_LOWER, _UPPER, _DIGITS) for c in x}


def permute(x: int, n: int, tweak: bytes, key: bytes, back: bool = False) -> int:
    """A keyed permutation of range(n), n up to 2 ** 64: a Feistel network on a * b >= n, walked until the value is in range."""
    if n < 2:
        return x
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def f(r: int, v: int, m: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d|%d|%d|" % (r, v, n) + tweak, key=key, digest_size=32).digest(), "big") % m

    while True:
        left, right = divmod(x, b)  # left < a, right < b
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if r % 2:
                right = (right + sign * f(r, left, b)) % b
            else:
                left = (left + sign * f(r, right, a)) % a
        x = left * b + right
        if x < n:
            return x


def digits(value: str, tweak: str, key: bytes, back: bool = False, alphabet: str = "") -> str:
    """Permutes the digits and ASCII letters of value together, each within its own kind (or alphabet); other characters stay.

    A Feistel network between the two halves of those characters: a round adds to each character of one half a stream
    drawn from the other half, modulo the size of the character's kind. Linear in the value's length.
    """
    sets = [alphabet if c in alphabet else "" for c in value] if alphabet else [_CLASS.get(c, "") for c in value]
    xs, sizes = [s.index(c) for c, s in zip(value, sets) if s], [len(s) for s in sets if s]
    shape = "".join(s[:1] or c for c, s in zip(value, sets))
    seed = hashlib.blake2b(f"{tweak}|{shape}".encode("utf-8", "surrogatepass"), key=key).digest()
    half = (len(xs) + 1) // 2
    parts, mods, sign = [xs[:half], xs[half:]], [sizes[:half], sizes[half:]], -1 if back else 1
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        to = 1 - r % 2
        n = len(parts[to])
        stream = struct.unpack(f"<{n}I", hashlib.shake_256(seed + bytes([r]) + bytes(parts[1 - to])).digest(4 * n))
        parts[to] = [(x + sign * k) % m for x, k, m in zip(parts[to], stream, mods[to])]
    it = iter(parts[0] + parts[1])
    return "".join(s[next(it)] if s else c for c, s in zip(value, sets))


def _refill(value: str, new: str, chars: str = "0123456789") -> str:
    """value with its characters of that kind replaced, in order, by those of new."""
    it = iter(new)
    return "".join(next(it) if c in chars else c for c in value)


def luhn(number: str) -> int:
    """The check digit for number."""
    return -(sum(_TWICE[d] for d in number[-1::-2]) + sum(map(int, number[-2::-2]))) % 10


#: The digit sum of twice a digit.
_TWICE = {str(d): sum(divmod(2 * d, 10)) for d in range(10)}
_SEPARATORS = str.maketrans("", "", " -")


def card(value: str, key: bytes, back: bool) -> str | None:
    """13 to 19 digits, not all the same, with a valid check digit; the body is permuted and the check digit made anew."""
    d = value.translate(_SEPARATORS)
    if not 13 <= len(d) <= 19 or d.count(d[0]) == len(d) or luhn(d[:-1]) != int(d[-1]):
        return None
    body = digits(d[:-1], "card", key, back)
    while len(set(body)) == 1:
        body = digits(body, "card", key, back)
    return _refill(value, body + str(luhn(body)))


def number(kind: str) -> Callable[[str, bytes, bool], str | None]:
    return lambda value, key, back: digits(value, kind, key, back)


def ssn(value: str, key: bytes, back: bool) -> str | None:
    a, b, c = (int(x) for x in re.split(r"\D", value))
    ok = lambda a, b, c: a not in (0, 666) and a < 900 and b and c
    if not ok(a, b, c):
        return None
    x = (a * 100 + b) * 10000 + c
    while True:
        x = permute(x, 10**9, b"ssn", key, back)
        a, b, c = x // 10**6, x // 10**4 % 100, x % 10**4
        if ok(a, b, c):
            return _refill(value, f"{x:09}")


def address(value: str, key: bytes, back: bool) -> str | None:
    try:
        x = int(ipaddress.IPv4Address(value))
    except ValueError:
        return None
    return str(ipaddress.IPv4Address(permute(x, 1 << 32, b"ipv4", key, back)))


#: The length of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02}"


def iban(value: str, key: bytes, back: bool) -> str | None:
    """Of a country in the table, of its length, in any case; of another country in capitals only."""
    v = value.replace(" ", "")
    length = IBAN_LENGTH.get(v[:2].upper())
    if len(v) != length if length else not 15 <= len(v) <= 34 or not v.isupper():
        return None
    if iban_check(v[:2], v[4:]) != v[2:4]:
        return None
    body = digits(v[4:], f"iban|{v[:2]}", key, back)
    it = iter(v[:2] + iban_check(v[:2], body) + body)
    return "".join(c if c == " " else next(it) for c in value)


#: Days that dates are permuted among: whole years, so that a year keeps four digits.
FIRST, LAST = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)


def date(value: str, key: bytes, back: bool) -> str | None:
    """Year first, else month first where that is a day of the calendar, else day first. Each part keeps its number of digits."""
    a, b, c = re.split(r"\D", value)
    orders = ((0, 1, 2),) if len(a) == 4 else ((2, 0, 1), (2, 1, 0))
    parts = (a, b, c)
    for k, (y, m, d) in enumerate(orders):
        try:
            day = datetime.date(int(parts[y]), int(parts[m]), int(parts[d]))
        except ValueError:
            continue
        if not FIRST <= day <= LAST:
            return None
        size = (LAST - FIRST).days + 1
        while True:
            day = FIRST + datetime.timedelta(permute((day - FIRST).days, size, f"date|{k}".encode(), key, back))
            short = (len(parts[m]) == 1 and day.month > 9) or (len(parts[d]) == 1 and day.day > 9)
            if not short and (k == 0 or day.day > 12):  # day-first dates stay recognizable as such
                break
        new = {y: f"{day.year:04}", m: f"{day.month:0{len(parts[m])}}", d: f"{day.day:0{len(parts[d])}}"}
        seps = re.findall(r"\D", value)
        return new[0] + seps[0] + new[1] + seps[1] + new[2]
    return None


def mail(value: str, key: bytes, back: bool) -> str | None:
    """The local part and the domain without its last label are permuted, each for itself."""
    local, _, domain = value.rpartition("@")
    host, _, top = domain.rpartition(".")
    return f"{digits(local, 'local', key, back)}@{digits(host, 'host', key, back)}.{top}"


def secret(value: str, key: bytes, back: bool) -> str | None:
    """What says which service a key is for stays; where that is no proof of a key, it needs letters and digits."""
    mixed = re.search(r"\d", value) and re.search(r"[A-Za-z]", value)
    head = _PREFIX.match(value).group()
    if head:
        return head + digits(value[len(head) :], f"secret|{head}", key, back) if mixed or _SURE.match(head) else None
    return digits(value, "hex", key, back, "0123456789abcdef" if value.islower() else "0123456789ABCDEF") if mixed else None


_PREFIX = re.compile(r"(?:[spr]k[_\-](?:(?:live|test)[_\-])?|AKIA|gh[pousr]_)?")
_SURE = re.compile(r"[spr]k[_\-](?:live|test)[_\-]|AKIA|gh[pousr]_")
#: Kinds in order of precedence, as (name, pattern, pseudonym): where two match at a place, the first wins. E-mail comes before all, see _mails.
KINDS: tuple[tuple[str, str, Callable], ...] = (
    ("iban", r"[A-Za-z]{2}\d{2}(?:[A-Za-z0-9]{11,30}|(?: [A-Za-z0-9]{4}){2,7}(?: [A-Za-z0-9]{1,3})?)(?![A-Za-z0-9])", iban),
    ("key", r"[spr]k[_\-](?:live|test)?[_\-]?[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}", secret),
    ("hex", r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])", secret),
    ("date", r"(?:\d{4}-\d{2}-\d{2}(?=[Tt]\d{2})|(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/\-])(?!\.\d))", date),
    ("ip", r"\d{1,3}(?:\.\d{1,3}){3}(?![\d])(?!\.\d)", address),
    ("ssn", r"\d{3}-\d{2}-\d{4}(?![\w\-])", ssn),
    ("card", r"\d(?:[ \-]?\d){12,18}(?![\d])", card),
    ("phone", r"(?:\+\d{1,3}[ .\-]?)(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}[\-. ]\d{4}(?!\d)|\d{3}[\-.]\d{3}[\-.]\d{4}(?!\d)", number("phone")),
)
NAMES = ("email", *(k[0] for k in KINDS))
#: At one place the kinds are tried in turn; a value that does not validate leaves the place to the next kind.
_AT = [(name, re.compile(p, re.ASCII), f) for name, p, f in KINDS]
#: Kinds whose pattern can run on into the next word or number: the longest match that ends at a separator and validates is the value.
_ON = {"card", "iban"}
#: Where a value other than an address may begin: at the edge of a run of letters and digits.
_MAY = re.compile(r"(?<![A-Za-z0-9])(?:[0-9]|\+(?=[0-9])|\((?=[0-9])|[0-9a-f]{32}|[0-9A-F]{32}|[A-Za-z]{2}(?=[0-9]{2})|[spr]k[_\-]|AKIA|gh[pousr]_)", re.ASCII)
#: A text without any of these holds nothing: every kind needs a digit or an address sign, but for keys that their beginning shows.
_ANY, _ANY_KEY = re.compile(r"[0-9@]"), re.compile(rf"[0-9@]|{_SURE.pattern}")
_KEY_MARKS = ("AKIA", "k_live", "k_test", "k-live", "k-test", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")
_LOCAL, _DOMAIN = frozenset(_LOWER + _UPPER + _DIGITS + "._%+-"), re.compile(r"(?:[A-Za-z0-9\-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])", re.ASCII)
_SPACE = re.compile(r"[ \t\n\r\v\f]")


def _shorter(value: str) -> Iterator[str]:
    """value, then what of it ends before each of its blanks and hyphens, the last one first, while it has 13 letters or digits."""
    n = sum(c not in " -" for c in value)
    yield value
    for i in range(len(value) - 1, 0, -1):
        if value[i] in " -":
            yield value[:i]
        else:
            n -= 1
            if n < 13:
                return


def _mails(text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Where addresses begin and end: from each sign back over what a local part may have, on over the labels of a domain."""
    at = text.find("@", lo, hi)
    while at >= 0:
        begin = at
        while begin > lo and text[begin - 1] in _LOCAL:
            begin -= 1
        while begin < at and text[begin] not in _CLASS:
            begin += 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
            lo = domain.end()
        else:
            lo = at + 1
        at = text.find("@", lo, hi)


def _value(text: str, at: int, key: bytes, back: bool) -> tuple[int, str, str] | None:
    """Where the value that begins here ends, its kind and its pseudonym."""
    for kind, pattern, f in _AT:
        v = pattern.match(text, at)
        for value in _shorter(v.group()) if v and kind in _ON else [v.group()] if v else []:
            if (new := f(value, key, back)) is not None:
                return at + len(value), kind, new
    return None


def spans(text: str, key: bytes, back: bool = False) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of each value, left to right, not overlapping. Values of any length; time is linear in the text's.

    Each run of non-space characters with a digit, an address sign or a key's beginning is gone through once. A value ends by its check
    digits; so where more digits or capitals follow a card number or IBAN, a longer one may validate by chance (1 in 10, 1 in 97),
    here or in the pseudonym's text when that is inverted.
    """
    at, any_ = 0, _ANY_KEY if any(mark in text for mark in _KEY_MARKS) else _ANY
    while m := any_.search(text, at):
        near = m.start()
        begin = max(at, 1 + max(text.rfind(c, at, near) for c in " \n\t\r\v\f"))
        end = _SPACE.search(text, near)
        stop = end.start() if end else len(text)
        at = begin
        starts = heapq.merge(((a, 0, b) for a, b in _mails(text, begin, stop)), ((c.start(), 1, 0) for c in _MAY.finditer(text, begin, stop)))
        for start, other, until in starts:
            if start < at:
                continue
            found = _value(text, start, key, back) if other else (until, "email", mail(text[start:until], key, back))
            if found:
                at = found[0]
                yield start, *found
                if at >= stop:
                    break
        at = max(at, stop)


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, list[str]]:
    out, kinds, at = [], [], 0
    for a, b, kind, new in spans(text, key, back):
        out += [text[at:a], new]
        kinds.append(kind)
        at = b
    return "".join([*out, text[at:]]), kinds


def pseudonymize(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, n_values, kinds (how many of each kind, by name in order).

    Null text stays null with 0 values, as does empty text. Texts of any length are read whole; a row is handled by itself, so
    repeated rows get the same result. An empty table gives an empty result; columns other than the two named are ignored. No shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, kinds = [], [], []
            for t in b.column(1).to_pylist():
                new, found = replace(t, key) if t else (t, [])
                texts.append(new)
                n.append(len(found))
                kinds.append(",".join(f"{k}:{found.count(k)}" for k in NAMES if k in found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(kinds, pa.string())], ["doc_id", "text", "n_values", "kinds"])

    d = pick(docs, doc_id=doc_id, text=text)
    return d.mapInArrow(work, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text string, n_values bigint, kinds string")


def pseudonymize_rows(docs: DataFrame, key: bytes, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with its text column replaced, other columns as they are, except n_chars (if there), which follows the text.

    Null and empty texts stay; repeated rows stay, each with the same result; an empty table stays empty. Columns of any name pass.
    """
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([replace(t, key)[0] if t else t for t in b.column(at).to_pylist()], pa.string())
            yield b.set_column(at, b.schema.field(at).name, new) if hasattr(b, "set_column") else pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    out = docs.mapInArrow(work, docs.schema)
    return out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else out
