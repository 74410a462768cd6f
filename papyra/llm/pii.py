"""Pseudonyms that keep the format: keyed Feistel permutations.

Found values are validated first: payment cards by their Luhn digit, IPv4 addresses by their octets, telephone and
identity numbers by their plan, calendar dates by the calendar, IBANs by their remainder, e-mail addresses by their
shape. Each is then permuted within its own format by a keyed, balanced-as-possible Feistel network with cycle walking:
digits give digits and keep their separators, a card keeps a right Luhn digit, an IBAN right check digits, a date stays
a date of its layout, an address an address, hexadecimal keys hexadecimal. Permutations are one to one, so equal values
(however written, for cards, telephones and dates: the separators are kept apart) have equal pseudonyms in every
document and different values different ones, with no table of values and no shuffle.

The key is a parameter, or the setting spark.papyra.pseudonym.key of the session. Where neither is given, a key is drawn at
random once for the application: pseudonyms are then linked within it, but not with those of another run, and nobody can
undo them.

Defined results: null and empty texts stay as they are with no counts; overlapping finds go to the earlier and longer
one, and to the kind named first; dates of 1900 to 2099 stay there, earlier and later ones among themselves; the country
code of a telephone number stays, with or without separators; characters other than letters and digits stay in place;
repeated rows are treated alike; other columns are kept, and a column `pii` of docs is kept beside the new `_pii`.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
import secrets
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import fresh, read

KEY_SETTING = "spark.papyra.pseudonym.key"
ROUNDS = 10
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date", "secret")


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names, else one drawn at random for this application."""
    named = spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING)
    if named:
        return hashlib.blake2b(named.encode()).digest()
    sc = spark.sparkContext
    if not hasattr(sc, "_papyra_key"):
        sc._papyra_key = secrets.token_bytes(64)
    return sc._papyra_key


def _round(key: bytes, kind: str, size: int, i: int, x: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}|{size:x}|{i}|{x:x}".encode(), key=key[:64], digest_size=64).digest(), "big")


def permute(key: bytes, kind: str, size: int, x: int) -> int:
    """A keyed permutation of range(size): Feistel rounds over the smallest a * b >= size, walked until inside."""
    if size < 2:
        return x
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(x, b)
        for i in range(ROUNDS):
            if i % 2:
                right = (right + _round(key, kind, size, i, left)) % b
            else:
                left = (left + _round(key, kind, size, i, right)) % a
        x = left * b + right
        if x < size:
            return x


def inverse(key: bytes, kind: str, size: int, x: int) -> int:
    if size < 2:
        return x
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)):
            if i % 2:
                right = (right - _round(key, kind, size, i, left)) % b
            else:
                left = (left - _round(key, kind, size, i, right)) % a
        x = left * b + right
        if x < size:
            return x


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    """Digits of shape replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _number(key: bytes, kind: str, digits: str) -> str:
    return str(permute(key, f"{kind}{len(digits)}", 10 ** len(digits), int(digits))).zfill(len(digits))


def card(key: bytes, m: str) -> str | None:
    d = _digits(m)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = _number(key, "card", d[:-1])
    return _refill(m, body + luhn_digit(body))


def iban_check(country: str, body: str) -> str:
    n = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(n) % 97:02d}"


_IBAN_LENGTHS = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "BE": 16, "AT": 20, "CH": 21, "PT": 25, "IE": 22, "PL": 28, "SE": 24, "DK": 18, "NO": 15, "FI": 18, "LU": 20}


def iban(key: bytes, m: str) -> str | None:
    flat = m.replace(" ", "")
    country, check, body = flat[:2], flat[2:4], flat[4:]
    if _IBAN_LENGTHS.get(country) != len(flat) or iban_check(country, body) != check:
        return None
    out = []
    digits, letters = _digits(body), "".join(c for c in body if c.isalpha())
    new_d = _number(key, f"iban{country}", digits) if digits else ""
    new_l = ""
    if letters:
        v = permute(key, f"ibanl{country}{len(letters)}", 26 ** len(letters), sum((ord(c) - 65) * 26**i for i, c in enumerate(letters)))
        new_l = "".join(chr(65 + v // 26**i % 26) for i in range(len(letters)))
    d, al = iter(new_d), iter(new_l)
    new = "".join(next(d) if c.isdigit() else next(al) for c in body)
    it = iter(country + iban_check(country, new) + new)
    for c in m:
        out.append(" " if c == " " else next(it))
    return "".join(out)


#: Country codes of one and two digits; all others have three (fixed values of the numbering plan).
_CODES_1 = {"1", "7"}
_CODES_2 = {"20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"}


def code_digits(d: str) -> int:
    """How many digits the country code of an international number takes."""
    return 1 if d[:1] in _CODES_1 else 2 if d[:2] in _CODES_2 else 3


def phone(key: bytes, m: str) -> str | None:
    d = _digits(m)
    if not 9 <= len(d) <= 15:
        return None
    keep = code_digits(d) if m[0] == "+" else 0
    return _refill(m, d[:keep] + _number(key, f"phone{d[:keep]}", d[keep:]))


def ssn(key: bytes, m: str) -> str | None:
    a, b, c = int(m[:3]), int(m[4:6]), int(m[7:])
    if a in (0, 666) or a >= 900 or b == 0 or c == 0:
        return None
    areas = 898  # 001 to 899 without 666
    x = (a - 1 - (a > 666)) * 99 * 9999 + (b - 1) * 9999 + c - 1
    x = permute(key, "ssn", areas * 99 * 9999, x)
    a, rest = divmod(x, 99 * 9999)
    a = a + 1 + (a + 1 >= 666)
    return f"{a:03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"


def ip(key: bytes, m: str) -> str | None:
    o = [int(x) for x in m.split(".")]
    if max(o) > 255 or any(len(x) > 1 and x[0] == "0" for x in m.split(".")):
        return None
    x = permute(key, "ip", 1 << 32, (o[0] << 24) | (o[1] << 16) | (o[2] << 8) | o[3])
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


#: First and last day of each range that is permuted within itself.
_RANGES = tuple((dt.date(a, 1, 1).toordinal(), dt.date(b, 12, 31).toordinal()) for a, b in ((1900, 2099), (1, 1899), (2100, 9999)))


def date(key: bytes, m: str) -> str | None:
    sep = next(c for c in m if not c.isdigit())
    p = m.split(sep)
    orders = [(0, 1, 2)] if len(p[0]) == 4 else [(2, 0, 1), (2, 1, 0)] if sep == "/" else [(2, 1, 0)]
    for order in orders:  # year, month, day; month/day/year goes before day/month/year
        try:
            day = dt.date(*(int(p[i]) for i in order)).toordinal()
        except ValueError:
            continue
        first, last = next(r for r in _RANGES if r[0] <= day <= r[1])
        new = dt.date.fromordinal(first + permute(key, "date", last - first + 1, day - first))
        parts = {order[0]: f"{new.year:04d}", order[1]: f"{new.month:02d}", order[2]: f"{new.day:02d}"}
        return sep.join(parts[i] for i in range(3))
    return None


def _shape(key: bytes, kind: str, s: str) -> str:
    """Letters give letters and digits digits, as one number in mixed base, under a tweak of their places; other characters
    and the case of each letter stay, so values that differ in case only have pseudonyms that do."""
    size = v = 0
    bases = [26 if "a" <= c.lower() <= "z" else 10 if "0" <= c <= "9" else 0 for c in s]
    size = math.prod(b for b in bases if b)
    for c, b in zip(s.lower(), bases, strict=True):
        if b:
            v = v * b + (ord(c) - 97 if b == 26 else int(c))
    v = permute(key, kind + "".join("x" if b == 26 else "0" if b else c for c, b in zip(s, bases, strict=True)), size, v)
    out = []
    for c, b in zip(reversed(s), reversed(bases), strict=True):
        if b:
            v, r = divmod(v, b)
            new = chr(97 + r) if b == 26 else str(r)
            c = new.upper() if c.isupper() else new
        out.append(c)
    return "".join(reversed(out))


def email(key: bytes, m: str) -> str | None:
    """The name and the first label of the domain are permuted; the rest of the domain stays."""
    name, _, domain = m.rpartition("@")
    head, _, tail = domain.partition(".")
    bare = name.lstrip("._%+-")
    if not bare:
        return None
    return f"{name[: len(name) - len(bare)]}{_shape(key, 'mail', bare)}@{_shape(key, 'host', head)}.{tail}"


def secret(key: bytes, m: str) -> str | None:
    kinds = [any(c.isdigit() for c in m), any(c.isalpha() for c in m)]
    if not all(kinds):
        return None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", m):
        new = f"{permute(key, f'hex{len(m)}', 16 ** len(m), int(m, 16)):0{len(m)}x}"
        return new.upper() if m.isupper() else new
    return _shape(key, "secret", m)


_PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}", email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    ("secret", r"(?<![A-Za-z0-9_])(?:AKIA[A-Z0-9]{16}|(?:sk|pk|rk)[-_](?:live|test|proj)?[-_]?[A-Za-z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9_])", secret),
    ("card", r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d])", card),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", ssn),
    ("ip", r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)", ip),
    ("date", r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})(?![\d/-])", date),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,5})(?!\w)", phone),
)
_ALL = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern, _ in _PATTERNS))
_MAKE: dict[str, Callable[[bytes, str], str | None]] = {name: f for name, _, f in _PATTERNS}
_SINGLE = {name: re.compile(pattern) for name, pattern, _ in _PATTERNS}
#: A text without any of these has nothing to find.
_MAYBE = re.compile(r"@|\d[\d .()/-]{5,}\d|[0-9a-fA-F]{32}|AKIA|xox|gh[pousr]_|[spr]k[-_]|[A-Z]{2}\d\d")


@lru_cache(maxsize=100_000)
def pseudonym(key: bytes, kind: str, value: str) -> str | None:
    return _MAKE[kind](key, value)


def _card_beginnings(run: str) -> Iterator[str]:
    """Shorter beginnings of a run of digit groups that end with a group and have 13 digits or more, longest first: a card
    may stand before an expiry date, a code or an amount."""
    for end in reversed([m.start() for m in re.finditer("[ -]", run)]):
        if len(_digits(run[:end])) < 13:
            return
        yield run[:end]


def replaced(text: str | None, key: bytes) -> tuple[str | None, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind."""
    counts: dict[str, int] = {}
    if not text or not _MAYBE.search(text):
        return text, counts
    out, at = [], 0
    while m := _ALL.search(text, at):
        kind, value = m.lastgroup, m[0]
        new, end = pseudonym(key, kind, value), m.end()
        if new is None:  # not valid as this kind: perhaps as a shorter card or as a later kind from the same place
            for later in [kind] * (kind == "card") + [n for n, _, _ in _PATTERNS if n != kind]:
                if m2 := _SINGLE[later].match(text, m.start()):
                    for part in [m2[0], *(_card_beginnings(m2[0]) if later == "card" else ())]:
                        if (new := pseudonym(key, later, part)) is not None:
                            break
                    if new is not None:
                        kind, end = later, m.start() + len(part)
                        break
        if new is None:
            out.append(text[at : m.start() + 1])
            at = m.start() + 1
            while at < len(text) and (text[at].isdigit() and text[at - 1].isdigit()):  # do not begin inside a number
                out.append(text[at])
                at += 1
            continue
        out += [text[at : m.start()], new]
        counts[kind] = counts.get(kind, 0) + 1
        at = end
    out.append(text[at:])
    return "".join(out), counts


def _replace(key: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [replaced(t, key) for t in pdf["text"]]
            yield pd.DataFrame({"text": [t for t, _ in done], **{f"n_{k}": [c.get(k, 0) for _, c in done] for k in KINDS}})

    def series(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return run(pd.DataFrame({"text": b}) for b in batches)

    return F.pandas_udf(series, "text string, " + ", ".join(f"n_{k} int" for k in KINDS))


def pseudonymised(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """docs with text replaced, and a struct column `pii` of counts by kind, as _pii where docs has such a column."""
    key = key or session_key(docs.sparkSession)
    (pii,) = fresh(docs, "pii")
    found = docs.withColumn(pii, _replace(key)(F.col("text").cast("string")))
    rest = [F.col(f"{pii}.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return found.select(*rest, F.struct(*[F.col(f"{pii}.n_{k}").alias(k) for k in KINDS]).alias(pii))


def op9_feistel_pseudonyms(spark, sf_dir: str) -> DataFrame:
    out = pseudonymised(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", *[F.col(f"pii.{k}").alias(f"n_{k}") for k in KINDS])
