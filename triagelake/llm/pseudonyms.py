"""Personal data replaced by format-preserving Feistel pseudonyms.

A value is recognised by a pattern and validated (check digits, calendar, octets, areas). It is then
read as a number below the count of valid values of its format, permuted by a keyed Feistel network
with cycle walking, and written in the same format. The permutation is one to one, so equal values
stay linked across documents, and unequal ones stay apart.
"""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back

ROUNDS = 10
#: The key of the query over the driver's tables. It is public, so whoever has it can undo its pseudonyms: for
#: data of your own give another.
EXAMPLE_KEY = "public example key; give your own"


def feistel(x: int, n: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0..n-1, or the way back: a Feistel network over the next even number of bits,
    walked until it lands below n. tweak names the format, so formats are permuted apart."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, size = (1 << half) - 1, (half + 7) // 8

    def mixed(r: int, v: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{n}|{r}|{v}".encode(), key=key, digest_size=min(64, size + 8)).digest(), "big")

    while True:
        a, b = x >> half, x & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            a, b = ((b ^ mixed(r, a)) & mask, a) if back else (b, (a ^ mixed(r, b)) & mask)
        x = a << half | b
        if x < n:
            return x


def permute(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..n-1 that leaves nothing where it was: there, one step on, and back, so that
    all values lie on one cycle. A single value has no other place."""
    return x if n < 2 else feistel((feistel(x, n, key, tweak) + 1) % n, n, key, tweak, back=True)


def _luhn_digit(digits: str) -> str:
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def _into(template: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in template)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _card(s: str, key: bytes) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or len(set(d)) == 1 or _luhn_digit(d[:-1]) != d[-1]:
        return None
    body = str(permute(int(d[:-1]), 10 ** (len(d) - 1), key, "card")).zfill(len(d) - 1)
    return _into(s, body + _luhn_digit(body))


def _ipv4(s: str, key: bytes) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ipv4")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _phone(s: str, key: bytes) -> str | None:
    head = re.match(r"\+\d{1,3}(?=[ .(-])", s)
    keep = head[0] if head else ""
    rest = s[len(keep) :]
    d = _digits(rest)
    if not 7 <= len(d) <= 13:
        return None
    return keep + _into(rest, str(permute(int(d), 10 ** len(d), key, "phone")).zfill(len(d)))


def _ssn(s: str, key: bytes) -> str | None:
    area, group, serial = int(s[:3]), int(s[4:6]), int(s[7:])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    index = (area - 1 - (area > 666)) * 99 * 9999 + (group - 1) * 9999 + serial - 1
    index = permute(index, 898 * 99 * 9999, key, "ssn")
    area, rest = divmod(index, 99 * 9999)
    area += 1 + (area >= 665)
    return f"{area:03d}{s[3]}{rest // 9999 + 1:02d}{s[6]}{rest % 9999 + 1:04d}"


_FIRST_DAY, _LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def _date(s: str, key: bytes) -> str | None:
    a, b, c = re.split(r"[-/.]", s)
    try:
        # year first; else day first where that is a date, month first where only that is
        orders = [(a, b, c)] if len(a) == 4 else [(c, b, a), (c, a, b)]
        day = next(d for o in orders if (d := _day(*map(int, o))))
    except StopIteration:
        return None
    if not _FIRST_DAY <= day.toordinal() <= _LAST_DAY:
        return None
    # parts without a leading zero stay so; they become two digits where the new day or month needs them
    width = 1 if any(len(p) == 1 for p in (a, b, c)) else 2
    new = dt.date.fromordinal(_FIRST_DAY + permute(day.toordinal() - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, key, "date"))
    if len(a) == 4:
        return f"{new.year:04d}{s[4]}{new.month:0{width}d}{s[-len(c) - 1]}{new.day:0{width}d}"
    month_first = _day(int(c), int(b), int(a)) is None
    x, y = (new.month, new.day) if month_first else (new.day, new.month)
    return f"{x:0{width}d}{s[len(a)]}{y:0{width}d}{s[-len(c) - 1]}{new.year:04d}"


def _day(year: int, month: int, day: int) -> dt.date | None:
    try:
        return dt.date(year, month, day)
    except ValueError:
        return None


def _mixed(s: str, key: bytes, tweak: str) -> str:
    """Letters stay letters of their case, digits digits, other characters as they are; the value is
    the same whatever its case."""
    x, n, radixes = 0, 1, []
    for c in s:
        if c.isascii() and (c.isdigit() or c.isalpha()):
            r = 10 if c.isdigit() else 26
            x, n = x * r + (int(c) if r == 10 else ord(c.lower()) - 97), n * r
            radixes.append(r)
    x = permute(x, n, key, f"{tweak}{len(s)}")
    out = []
    for r in reversed(radixes):
        x, v = divmod(x, r)
        out.append(str(v) if r == 10 else chr(97 + v))
    it = iter(reversed(out))
    return "".join((v.upper() if c.isupper() else v) if c.isascii() and c.isalnum() and (v := next(it)) else c for c in s)


def _email(s: str, key: bytes) -> str | None:
    local, _, host = s.rpartition("@")
    *names, top = host.split(".")
    return f"{_mixed(local, key, 'email')}@" + ".".join([*(_mixed(x, key, "host") for x in names), top])


def _secret(s: str, key: bytes) -> str | None:
    if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
        return None
    n = 16 ** len(s)
    new = f"{permute(int(s, 16), n, key, 'hex'):x}".zfill(len(s))
    return new.upper() if any(c.isupper() for c in s) else new


def _iban(s: str, key: bytes) -> str | None:
    flat = s.replace(" ", "")
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = _mixed(flat[4:], key, "iban")
    new = iter(f"{flat[:2]}{98 - number(body + flat[:2] + '00') % 97:02d}{body}")
    return "".join(c if c == " " else next(new) for c in s)


#: How long an IBAN of a country is.
IBAN_LENGTH = {
    code: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}


def _iban_ends(s: str) -> list[int]:
    """Where an IBAN that s begins with may end: at its country's length if a word ends there, or with s."""
    at = [i + 1 for i, c in enumerate(s) if c != " "]
    n = IBAN_LENGTH.get(s[:2], 0)
    return [at[n - 1], len(s)] if 0 < n < len(at) and s[at[n - 1]] == " " else [len(s)]


#: Kinds in the order of precedence, their patterns, and what is in a text that can match.
KINDS: list[tuple[str, str, str, Callable[[str, bytes], str | None]]] = [
    ("email", r"(?<![A-Za-z0-9_%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){0,8}\.?(?<=[A-Za-z0-9])", "@", _email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", _iban),
    ("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+)(?![A-Za-z0-9])", "", _secret),
    ("card", r"(?<!\d)(?<!\d[.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\d)", "", _card),
    ("ipv4", r"(?<!\d)(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)", ".", _ipv4),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", "-", _ssn),
    ("date", r"(?<![\d./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d/-]|\.\d)", "", _date),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\d)|(?<![\w+.(-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])", "", _phone),
]
_COMPILED = [(kind, re.compile(pattern), need, make) for kind, pattern, need, make in KINDS]
_ANY_DIGIT = re.compile(r"[0-9]")


def find(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(begin, end, kind, pseudonym) of every validated value, in order and apart."""
    digits = _ANY_DIGIT.search(text) is not None
    taken: list[tuple[int, int, str, str]] = []
    for kind, pattern, need, make in _COMPILED:
        if (need and need not in text) or (not digits and kind != "email"):
            continue
        at = 0
        while (m := pattern.search(text, at)) is not None:
            begin, at = m.start(), m.end()
            for end in [begin + n for n in _iban_ends(m[0])] if kind == "iban" else [at]:
                k = bisect.bisect(taken, (begin,))  # spans are apart and in order
                free = (not k or taken[k - 1][1] <= begin) and (k == len(taken) or end <= taken[k][0])
                if free and (new := make(text[begin:end], key)) is not None:
                    taken.insert(k, (begin, end, kind, new))
                    at = end
                    break
            else:  # what isn't an IBAN may hold one
                at = begin + 2 if kind == "iban" else at
    return taken


FOUND = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(f"n_{k}", T.LongType()) for k, *_ in KINDS)])


def pseudonymised(text: Column, key: str) -> Column:
    """A struct column: the text with pseudonyms, and for each kind how many values it had.
    Null stays null, with no values. Equal values get equal pseudonyms under one key."""
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    names = [f"n_{k}" for k, *_ in KINDS]

    @F.pandas_udf(FOUND)
    def replace(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                found = find(t, secret) if t else []
                if found:
                    parts, at = [], 0
                    for a, b, _, new in found:
                        parts += (t[at:a], new)
                        at = b
                    t = "".join([*parts, t[at:]])
                kinds = [k for _, _, k, _ in found]
                rows.append((t, *(kinds.count(k[2:]) for k in names)))
            yield pd.DataFrame(rows, columns=["text", *names])
        give_back()

    return replace(text)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with pseudonyms in the text; rows (repeats, too) and other columns stay as they are, whatever their
    names. Null and empty texts stay so."""
    return docs.withColumn(text_col, pseudonymised(F.col(text_col), key)["text"])
