"""Operator 5: format-preserving Feistel pseudonyms for validated numbers, dates and other personal data."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable
from datetime import date
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands in for a secret of the deployment: pass your own 16 to 64 bytes.
KEY = b"plumbline demonstration key 0001"
ROUNDS = 10
_FIRST, _LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
#: Hexadecimal digits that are permuted at once; a longer run is permuted part by part, each keyed by the one before.
_HEX = 128
#: Country codes of one and two digits; all others have three.
_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}

#: An e-mail address from its @ on: its name is found by going back from there, so no text is scanned twice.
_AT = re.compile(r"@\w[\w-]*+(?:\.\w[\w-]*+)+")
_NAME = re.compile(r"[\w.+-]*[\w+-]")
PATTERN = re.compile(
    r"(?<![\w.])(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
    r"|(?<!\w)(?P<hex>[0-9a-fA-F]{32,}+)(?!\w)"
    r"|(?<![\w.])(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![\w]|\.[0-9])"
    r"|(?<![\w/.-])(?P<date>[0-9]{4}(?P<s>[-/.])[0-9]{2}(?P=s)[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![\w/-]|\.[0-9])"
    r"|(?<![\w-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"
    r"|(?<![\w+])(?P<phone>\+[0-9]{7,15}|(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,5})(?![\w-])"
    r"|(?<![\w-])(?P<number>[0-9](?:[ -]?[0-9]){11,18})(?![\w-])"
)


@lru_cache(4096)
def _alphabet(c: str) -> str:
    """The characters that may stand for c: ASCII digits and letters of its case, else letters of its category in its page of 256."""
    for a in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        if c in a:
            return a
    if not c.isalnum():
        return ""
    kind, page = unicodedata.category(c), ord(c) & ~255
    return "".join(x for x in map(chr, range(max(page, 128), page + 256)) if unicodedata.category(x) == kind and x.isalnum())


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a balanced Feistel network on the covering power of four, cycle-walked."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    while True:
        a, b = value >> half, value & mask
        for r in range(ROUNDS):
            h = hashlib.blake2b(b.to_bytes(width, "big") + f"|{tweak}|{size}|{r}".encode(), key=key, digest_size=max(8, width)).digest()
            a, b = b, a ^ (int.from_bytes(h, "big") & mask)
        value = (a << half) | b
        if value < size:
            return value


def _hex_alphabet(c: str) -> str:
    return next(a for a in ("0123456789", "abcdef", "ABCDEF") if c in a)


def _spread(text: str, key: bytes, tweak: str, alphabet: Callable[[str], str] = _alphabet) -> str | None:
    """text with its characters permuted together, each within its own alphabet; others stay. None if nothing can change."""
    value, size = 0, 1
    for c in text:
        if a := alphabet(c):
            value, size = value * len(a) + a.index(c), size * len(a)
    if size == 1:
        return None
    value = permute(value, size, key, tweak)
    out = []
    for c in reversed(text):
        if a := alphabet(c):
            value, k = divmod(value, len(a))
            c = a[k]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _refill(shape: str, chars: str) -> str:
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _number(text: str, key: bytes) -> str | None:
    """Numbers that pass the Luhn check, to such numbers: the check digit follows from the rest."""
    digits = re.sub("[ -]", "", text)
    if not luhn(digits):
        return None
    body = str(permute(int(digits[:-1]), 10 ** (len(digits) - 1), key, "luhn")).zfill(len(digits) - 1)
    return _refill(text, next(body + d for d in "0123456789" if luhn(body + d)))


def _ip(text: str, key: bytes) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    v = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, v.to_bytes(4, "big")))


def _date(text: str, key: bytes) -> str | None:
    a, s1, b, s2, c = re.split(r"([./-])", text)
    if s1 != s2:
        return None
    y, m, d = (a, b, c) if len(a) == 4 else (c, a, b) if s1 == "/" else (c, b, a)
    try:
        day = date(int(y), int(m), int(d)).toordinal()
    except ValueError:
        return None
    if not _FIRST <= day <= _LAST:
        return None
    new = date.fromordinal(_FIRST + permute(day - _FIRST, _LAST - _FIRST + 1, key, "date"))
    y, m, d = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
    return s1.join((y, m, d) if len(a) == 4 else (m, d, y) if s1 == "/" else (d, m, y))


def _ssn(text: str, key: bytes) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    rank = area - 1 - (area > 666)
    v = permute((rank * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, "ssn")
    v, serial = divmod(v, 9999)
    rank, group = divmod(v, 99)
    return f"{rank + 1 + (rank >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(text: str, key: bytes) -> str | None:
    flat = text.replace(" ", "")
    if _mod97(flat[4:] + flat[:4]) != 1:
        return None
    body = _spread(flat[4:], key, "iban" + flat[:2])
    check = 98 - _mod97(body + flat[:2] + "00")
    return _refill(text, flat[:2] + f"{check:02d}" + body)


def _hex(text: str, key: bytes) -> str:
    low, out, last = text.lower(), [], ""
    mixed = text not in (low, text.upper())  # letters of both cases: each character stays of its kind
    for k in range(0, len(text), _HEX):
        part, tweak = text[k : k + _HEX], f"hex{len(text)},{last}"
        last = _spread(part, key, tweak, _hex_alphabet) if mixed else f"{permute(int(part, 16), 16 ** len(part), key, tweak):x}".zfill(len(part))
        out.append(last)
    new = "".join(out)
    return new if mixed or text == low else new.upper()


def _email(text: str, key: bytes) -> str | None:
    """The name, in parts of 64 characters; the host stays."""
    name, _, host = text.rpartition("@")
    parts = [name[k : k + 64] for k in range(0, len(name), 64)]
    new, last = [], ""
    for p in parts:
        last = _spread(p, key, f"email{len(name)},{last}@{host.lower()}") or p
        new.append(last)
    return f"{''.join(new)}@{host}" if any(_alphabet(c) for c in name) else None


def _phone(text: str, key: bytes) -> str:
    """The national digits; a number without a country's code is one of country 1. Its layout doesn't matter."""
    digits = re.sub("[^0-9]", "", text)
    code = next((digits[:k] for k in (1, 2) if digits[:k] in _CODES), digits[:3]) if text.startswith("+") else ""
    rest = digits[len(code) :]
    return _refill(text, code + str(permute(int(rest), 10 ** len(rest), key, f"phone{code or '1'}")).zfill(len(rest)))


_KINDS = {"email": _email, "iban": _iban, "hex": _hex, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "number": _number}


def _emails(text: str) -> list[tuple[int, int]]:
    """Where e-mail addresses begin and end."""
    out, done = [], 0
    for m in _AT.finditer(text):
        k = m.start()
        while k > done and (text[k - 1].isalnum() or text[k - 1] in "_.+-"):
            k -= 1
        if _NAME.fullmatch(text, k, m.start()):
            out.append((k, m.end()))
        done = m.end()
    return out


def pseudonymise(text: str, key: bytes = KEY, seen: dict | None = None) -> tuple[str, int]:
    """(text with every validated value replaced, how many were)."""
    found = 0
    seen = {} if seen is None else seen

    def new(kind: str, value: str) -> str:
        nonlocal found
        at = (kind, value)
        if at not in seen:
            if len(seen) > 20_000:
                seen.clear()
            seen[at] = _KINDS[kind](value, key)
        if seen[at] is None:
            return value
        found += 1
        return seen[at]

    out, done = [], 0
    for start, end in [*(_emails(text) if "@" in text else ()), (len(text), len(text))]:
        for m in PATTERN.finditer(text, done, start):
            out += [text[done : m.start()], new(m.lastgroup if m.lastgroup != "s" else "date", m.group())]
            done = m.end()
        out += [text[done:start], new("email", text[start:end]) if end > start else ""]
        done = end
    return "".join(out), found


def pseudonymised(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """docs with text pseudonymised and n_pii, the number of values replaced.

    Replaced are: numbers of 12 to 19 digits that pass the Luhn check (they go to such numbers; others aren't
    validated and stay), dates (of 1900 to 2099, as y-m-d, d.m.y or m/d/y, if the day exists), IPv4 addresses
    (octets up to 255), US social security numbers (of issued ranges), IBANs (with right check digits, which are
    recomputed), phone numbers (the country's code stays), names in e-mail addresses and hexadecimal secrets of 32
    digits and more, of any length. Each is permuted within its own format by a Feistel network under the key, so
    separators, length, case and validity stay, equal values get equal pseudonyms in every document, and different
    ones different. A value may be its own image, with the odds of any other. Dates are linked across formats,
    phone numbers across layouts. Letters of e-mail names of any script are replaced by such letters. Work is in
    proportion to a text's length, whatever it holds.

    No shuffle: texts without a digit, @ or 32 hexadecimal letters don't leave the JVM. Null text stays null, with n_pii 0, and empty
    text stays empty; texts are read whole. Repeated rows are treated alike; other columns are kept, but one
    named n_pii is replaced.
    """

    @F.pandas_udf("struct<text: string, n: int>")
    def swap(texts: pd.Series) -> pd.DataFrame:
        seen: dict = {}
        return pd.DataFrame([(None, 0) if t is None else pseudonymise(t, key, seen) for t in texts], columns=["text", "n"])

    out = docs.drop("n_pii").withColumn("__p", swap(F.when(F.col("text").rlike("[0-9@]|[a-fA-F]{32}"), F.col("text"))))
    return out.withColumn("text", F.coalesce("__p.text", "text")).withColumn("n_pii", F.coalesce("__p.n", F.lit(0))).drop("__p")
