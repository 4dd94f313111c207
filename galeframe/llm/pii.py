"""PII: format-preserving Feistel pseudonyms.

Mail addresses, phone numbers, payment cards, IBANs, social security numbers, IPv4 addresses and calendar
dates are found in whole texts, validated (check digits, number plans, real dates) and replaced by another
valid value of the same format. The replacement is a keyed permutation of the format's value space: an
alternating Feistel network over two parts whose round function is keyed BLAKE2, walked on until it lands on
a valid value. So equal values are equal pseudonyms in every document and every way of writing them, and
without the key they cannot be told back. With the key, restore() turns them back, exactly.

Days are permuted among those that can be written in the same ways (_day_group): a pseudonym keeps the width of day and month,
a day beyond 12 stays beyond 12, May stays May and September September, and years of 1969 to 2068 stay there. Numbers
abroad keep their country code, whatever separates its digits.

What does not validate stays as it is, so clean texts are unchanged. A null text stays null with no spans, an
empty text stays empty. Overlapping candidates: the leftmost, then the longer kind in the order of KINDS.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Callable
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeframe.llm.text import slices

KINDS = ("email", "iban", "card", "phone", "ssn", "ip", "date")
ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
#: two-digit years are of these days
FIRST_SHORT, LAST_SHORT = date(1969, 1, 1).toordinal(), date(2068, 12, 31).toordinal()
MONTHS = ("january february march april may june july august september october november december").split()
SHORT = [m[:3] for m in MONTHS]
#: fixed: country calling codes of two digits; 1 and 7 stand alone, all others have three
TWO_DIGIT_COUNTRIES = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
    "81 82 84 86 90 91 92 93 94 95 98".split())
KEPT_VALUES = 1 << 15   # pseudonyms a worker keeps
PIECE = 128     # letters and digits of a mail's local part that are permuted together

_MONTH = r"(?:" + "|".join([*MONTHS, "sept", *SHORT]) + ")"

SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("pseudonym", T.StringType())])
RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))])

PATTERNS = {
    "email": r"(?<![\w.+%-])[.+%-]*\w[\w.+%-]*@(?:[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|(?:[^\W_]|-)+(?:\.(?:[^\W_]|-)+)+)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "phone": r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w|-\d)"
             r"|(?<!\w)\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?=T\d)|(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}"
            r"|\d{1,2}/\d{1,2}/\d{2})(?!\w|[./-]\d))"
            r"|\b" + _MONTH + r"\.? \d{1,2}(?:st|nd|rd|th)?,? (?:\d{4}|'\d{2})\b"
            r"|\b\d{1,2}(?:\.|st|nd|rd|th)?(?: of)? " + _MONTH + r"\.?,? (?:\d{4}|'\d{2})\b"
            r"|\b\d{1,2}-" + _MONTH + r"-(?:\d{4}|\d{2})\b",
}
FINDER = re.compile("|".join(f"(?P<{k}>{PATTERNS[k]})" for k in KINDS), re.IGNORECASE)
#: a text without these has no candidate
HINT = re.compile(r"@|\d[\d(). /,:-]*\d|\d [a-z]", re.IGNORECASE)


class Pseudonyms:
    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.replace = lru_cache(KEPT_VALUES)(self._replace)

    def permute(self, tweak: str, value: int, size: int, back: bool = False) -> int:
        """Keyed permutation of range(size): an alternating Feistel network over the two factors of a grid
        a * b >= size, walked until it is inside."""
        if size < 2:
            return value
        a = max(2, math.isqrt(size))
        b = -(-size // a)
        head = f"{tweak}:{size}:".encode()
        while True:
            left, right = divmod(value, b)
            for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if k % 2:
                    right = (right + (-1 if back else 1) * self._round(head, k, left, b)) % b
                else:
                    left = (left + (-1 if back else 1) * self._round(head, k, right, a)) % a
            value = left * b + right
            if value < size:
                return value

    def _round(self, head: bytes, k: int, other: int, size: int) -> int:
        """A number that reaches all of range(size)."""
        many, text = (size.bit_length() + 7) // 8 + 8, b"%b%d:%d" % (head, k, other)
        if many <= 16:
            return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=16).digest(), "big")
        return int.from_bytes(hashlib.shake_256(self.key + text).digest(many), "big")

    def walk(self, tweak: str, value: int, size: int, valid: Callable[[int], bool], back: bool) -> int:
        """The permutation again and again, until the value is valid."""
        while True:
            value = self.permute(tweak, value, size, back)
            if valid(value):
                return value

    def _replace(self, kind: str, text: str, back: bool) -> str | None:
        """Pseudonym of a candidate, or None if it doesn't validate."""
        return getattr(self, f"_{kind}")(text, back)

    def _email(self, text: str, back: bool) -> str | None:
        """Letters and digits of the local part, each place in its own class. A local part of more than PIECE
        of them is permuted piece by piece, each under the pseudonyms before it."""
        local, at, domain = text.rpartition("@")
        places = [c for c in local if c.isalnum()]
        if not places:
            return None
        new: list[str] = []
        before = b""
        for k in range(0, len(places), PIECE):
            piece = places[k:k + PIECE]
            classes = [_class(c) for c in piece]
            value, size = 0, 1
            for c, (_, chars) in zip(piece, classes, strict=True):
                value, size = value * len(chars) + chars.index(c.lower() if c.isascii() else c), size * len(chars)
            tweak = f"email:{''.join(name for name, _ in classes)}:{domain.lower()}"
            value = self.permute(f"{tweak}:{k}:{before.hex()}" if k else tweak, value, size, back)
            done = []
            for c, (_, chars) in zip(reversed(piece), reversed(classes), strict=True):
                value, digit = divmod(value, len(chars))
                done.append(chars[digit].upper() if c.isascii() and c.isupper() else chars[digit])
            new += done[::-1]
            told = "".join(piece if back else done[::-1])
            before = hashlib.blake2b(before + "".join(c.lower() if c.isascii() else c for c in told).encode()).digest()
        return _fill(local, new) + at + domain

    def _card(self, text: str, back: bool) -> str | None:
        digits = [c for c in text if c.isdigit()]
        if digits[0] not in "23456" or _luhn(digits[:-1]) != digits[-1]:
            return None
        # the first digit (the kind of issuer) stays, the check digit is computed anew
        n = len(digits) - 2
        body = self.permute(f"card:{digits[0]}", int("".join(digits[1:-1])), 10 ** n, back)
        new = [digits[0], *str(body).zfill(n)]
        return _fill(text, [*new, _luhn(new)])

    def _iban(self, text: str, back: bool) -> str | None:
        plain = text.replace(" ", "").upper()
        if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
            return None
        shape = "".join("9" if c.isdigit() else "A" for c in plain[4:])
        value, size = 0, 1
        for c, s in zip(plain[4:], shape, strict=True):
            base = 10 if s == "9" else 26
            value, size = value * base + (int(c) if base == 10 else ord(c) - 65), size * base
        value = self.permute(f"iban:{plain[:2]}:{shape}", value, size, back)
        body = []
        for s in reversed(shape):
            value, digit = divmod(value, 10 if s == "9" else 26)
            body.append(str(digit) if s == "9" else chr(digit + 65))
        body = "".join(reversed(body))
        check = 98 - _mod97(body + plain[:2] + "00")
        new = [*plain[:2], *f"{check:02d}", *body]
        old = text.replace(" ", "")
        return _fill(text, [c.lower() if o.islower() else c for c, o in zip(new, old, strict=True)])

    def _phone(self, text: str, back: bool) -> str | None:
        digits = "".join(c for c in text if c.isdigit())
        plan = digits[-10:]
        if text.startswith("+") and not text.startswith("+1"):
            if not 8 <= len(digits) <= 15:
                return None
            cc = 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_COUNTRIES else 3
            rest = digits[cc:]
            new = self.permute(f"phone:{digits[:cc]}", int(rest), 10 ** len(rest), back)
            return _fill(text, [*digits[:cc], *str(new).zfill(len(rest))])
        if len(digits) not in (10, 11) or len(digits) == 11 and digits[0] != "1" or not _north_american(int(plan)):
            return None
        new = self.walk("phone:1", int(plan), 10 ** 10, _north_american, back)
        return _fill(text, [*digits[:-10], *str(new).zfill(10)])

    def _ssn(self, text: str, back: bool) -> str | None:
        value = int(text.replace("-", ""))
        if not _social(value):
            return None
        return _fill(text, list(str(self.walk("ssn", value, 10 ** 9, _social, back)).zfill(9)))

    def _ip(self, text: str, back: bool) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        value = sum(int(p) << 8 * (3 - k) for k, p in enumerate(parts))
        if not _host(value):
            return None
        new = self.walk("ip", value, 1 << 32, _host, back)
        return ".".join(str(new >> 8 * (3 - k) & 255) for k in range(4))

    def _date(self, text: str, back: bool) -> str | None:
        names = re.findall(r"[A-Za-z]{3,}", text)
        digits = re.findall(r"\d+", text)
        numbers = [int(n) for n in digits]
        written = names[0].lower() if names else ""
        if names:
            month = (MONTHS.index(written) if written in MONTHS else SHORT.index(written[:3])) + 1
            day, year = numbers
            order = "named"
        elif re.match(r"\d{4}", text):
            year, month, day = numbers
            order = "ymd"
        else:
            day, month, year = numbers
            order = "dmy" if month <= 12 else "mdy"
            if order == "mdy":
                day, month = month, day
        two = order != "ymd" and len(digits[-1]) == 2
        if two:
            year += 1900 if year >= 69 else 2000
        try:
            at = date(year, month, day).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= at <= LAST_DAY:
            return None
        group = _day_group(at)
        days = _days()[group]
        new = date.fromordinal(days[self.permute(f"date:{group}", bisect_left(days, at), len(days), back)])
        if order == "named":
            name = MONTHS[new.month - 1]
            name = name if written in MONTHS else name[:len(written)]
            name = name.title() if names[0][0].isupper() and not names[0].isupper() else name.upper() if names[0].isupper() else name
            out = text.replace(names[0], "\0")
            values = iter([new.day, new.year])
            out = re.sub(r"(\d+)(st|nd|rd|th)?", lambda m: _wide(next(values), m[1]) + (
                "" if not m[2] else _ordinal(new.day).upper() if m[2].isupper() else _ordinal(new.day)), out, flags=re.IGNORECASE)
            return out.replace("\0", name)
        values = iter({"ymd": (new.year, new.month, new.day), "dmy": (new.day, new.month, new.year),
                       "mdy": (new.month, new.day, new.year)}[order])
        return re.sub(r"\d+", lambda m: _wide(next(values), m[0]), text)

    def apply(self, text: str | None, back: bool = False) -> tuple[str | None, list[tuple[str, int, int, str]]]:
        """The text with pseudonyms, and its spans (kind, start, end in the input's code points, pseudonym)."""
        if not text or not HINT.search(text):
            return text, []
        out, spans, upto, at = [], [], 0, 0
        while m := FINDER.search(text, at):
            kind = m.lastgroup
            new = self.replace(kind, m[0], back)
            if new is None:  # other kinds may still begin at this place
                new = next((v for k in KINDS[KINDS.index(kind) + 1:] if (
                    m := _ALONE[k].match(text, m.start()) or m) and m.re is _ALONE[k] and (
                        v := self.replace(kind := k, m[0], back)) is not None), None)
            if new is None:
                at = _next_place(text, m.start())
                continue
            out += [text[upto:m.start()], new]
            spans.append((kind, m.start(), m.end(), new))
            upto = at = m.end()
        out.append(text[upto:])
        return "".join(out), spans


_ALONE = {k: re.compile(PATTERNS[k], re.IGNORECASE) for k in KINDS}
_TOKEN = re.compile(r"\w+|\W")


def _next_place(text: str, at: int) -> int:
    """The end of the word or sign at a place."""
    return _TOKEN.match(text, at).end()


@lru_cache(20_000)
def _class(c: str) -> tuple[str, str]:
    """Name and members of the class of a letter or digit: 0-9, a-z, or those of its 128 code points."""
    if c.isascii():
        return ("9", "0123456789") if c.isdigit() else ("a", "abcdefghijklmnopqrstuvwxyz")
    block = ord(c) >> 7
    return f"[{block}]", "".join(x for x in map(chr, range(block << 7, block + 1 << 7)) if x.isalnum())


def _ordinal(day: int) -> str:
    return "th" if 10 < day < 14 else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th")


def _fill(form: str, chars: list[str]) -> str:
    """The form with its letters and digits replaced in order."""
    new = iter(chars)
    return "".join(next(new) if c.isalnum() else c for c in form)


def _luhn(digits: list[str]) -> str:
    total = sum(int(d) if k % 2 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _north_american(value: int) -> bool:
    """Area and exchange code begin with 2 to 9."""
    return value // 10 ** 9 >= 2 and value // 10 ** 6 % 1000 >= 200


def _social(value: int) -> bool:
    area = value // 10 ** 6
    return 0 < area < 900 and area != 666 and value // 10 ** 4 % 100 > 0 and value % 10 ** 4 > 0


def _host(value: int) -> bool:
    """An address of one machine, not of this net, loopback, multicast or reserved."""
    return value >> 24 not in (0, 127) and value >> 24 < 224


def _day_group(day: int) -> str:
    """Days that can be written in the same ways: the month's day of one digit, up to 12 or beyond (it cannot be taken for a
    month), a month of one digit or two, May (which has no short form), September (which has one of four letters), and a year
    that two digits can tell or not."""
    d = date.fromordinal(day)
    month = {5: "may", 9: "sept"}.get(d.month, "short" if d.month < 10 else "long")
    return f"{(d.day > 9) + (d.day > 12)}:{month}:{FIRST_SHORT <= day <= LAST_SHORT}"


@lru_cache(1)
def _days() -> dict[str, list[int]]:
    groups: dict[str, list[int]] = {}
    for day in range(FIRST_DAY, LAST_DAY + 1):
        groups.setdefault(_day_group(day), []).append(day)
    return groups


def _wide(value: int, old: str) -> str:
    """A number as wide as the one it stands for; of a year the last two digits where there were two."""
    return str(value % 100 if len(old) == 2 else value).zfill(len(old))


_keyed: dict[bytes, Pseudonyms] = {}


def pseudonyms(key: bytes) -> Pseudonyms:
    if key not in _keyed:
        _keyed[key] = Pseudonyms(key)
    return _keyed[key]


def replaced(text: Column, key: bytes, back: bool = False) -> Column:
    """struct(text, spans) of a text column. back turns pseudonyms of the same key into the values again."""
    kind = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct(
        [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())])))])

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        own, out = pseudonyms(key), []
        for part in slices(pa.record_batch([texts], names=["text"])):
            rows, spans = [], []
            for t in part.column(0):
                new, found = own.apply(t.as_py(), back)
                rows.append(new)
                spans.append([dict(zip(("kind", "start", "end", "pseudonym"), s, strict=True)) for s in found])
            out.append(pa.StructArray.from_arrays([pa.array(rows, pa.string()), pa.array(spans, kind.field("spans").type)],
                                                  fields=list(kind)))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    return run(text)


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with text replaced by its pseudonymised form and a column pii_spans (one of that name is
    replaced). Other columns stay."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("text", "pii_spans")]
    return docs.select(*rest, replaced(F.col("text"), key).alias("_r")).select(
        *rest, F.col("_r.text").alias("text"), F.col("_r.spans").alias("pii_spans"))


def restore(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with the pseudonyms of key turned back."""
    return docs.withColumn("text", replaced(F.col("text"), key, back=True)["text"])
