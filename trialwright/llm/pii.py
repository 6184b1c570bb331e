"""Format-preserving pseudonyms for validated numbers and dates.

A value is recognised, validated, read as a number below the size of its format and permuted there by a keyed Feistel
network with cycle walking.  The same value always gets the same pseudonym, whatever its separators and in whatever
document, different values get different ones, and whoever holds the key can turn them back.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trialwright.llm.common import prepare, table, with_column
from trialwright.llm.registry import query

ROUNDS = 8
KINDS = ["card", "phone", "ip", "ssn", "iban", "date", "email"]
# Days that dates are permuted among.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

_EMAIL = r"(?P<email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+)"
_DATE = r"(?P<date>(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}[./-]\d{2}[./-]\d{4})(?![\w-]))"
_IP = r"(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
_IBAN = r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
_SSN = r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
_CARD = r"(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
_PHONE = r"(?P<phone>(?<![\w])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?!\w)|(?<![\w])\+\d{8,14}(?!\w))"
PATTERN = re.compile("|".join([_EMAIL, _DATE, _IP, _IBAN, _SSN, _CARD, _PHONE]))
NUMBERS = re.compile("|".join([_DATE, _IP, _IBAN, _SSN, _CARD, _PHONE]))
_DIGIT = re.compile(r"\d")


class Permutation:
    """Keyed permutation of 0 .. size - 1; ``kind`` separates formats of one size."""

    def __init__(self, key: bytes, kind: str, size: int):
        self.size, self.half = size, max(2, math.isqrt(max(0, size - 1)) + 1)
        self.hash = hashlib.blake2b(f"{kind}|{size}".encode(), key=key[:64], digest_size=16)

    def _f(self, turn: int, x: int) -> int:
        h = self.hash.copy()
        h.update(b"|%d|%d" % (turn, x))
        return int.from_bytes(h.digest(), "little") % self.half

    def __call__(self, x: int) -> int:
        while True:
            a, b = divmod(x, self.half)
            for turn in range(ROUNDS):
                a, b = b, (a + self._f(turn, b)) % self.half
            x = a * self.half + b
            if x < self.size:
                return x

    def back(self, x: int) -> int:
        while True:
            a, b = divmod(x, self.half)
            for turn in reversed(range(ROUNDS)):
                a, b = (b - self._f(turn, a)) % self.half, a
            x = a * self.half + b
            if x < self.size:
                return x


def luhn(digits: str) -> int:
    """Check digit that makes ``digits`` plus it valid."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += sum(divmod(2 * d, 10)) if i % 2 == 0 else d
    return -total % 10


def refill(form: str, digits: str) -> str:
    """``form`` with its digits replaced, one by one."""
    new = iter(digits)
    return _DIGIT.sub(lambda _: next(new), form)


class Pseudonyms:
    """Pseudonyms under one key; with ``back`` they are turned into the values again."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.direction, self.tables, self.counts = key, back, {}, Counter()

    def permuted(self, kind: str, size: int, x: int) -> int:
        table = self.tables.setdefault((kind, size), Permutation(self.key, kind, size))
        return table.back(x) if self.direction else table(x)

    def digits(self, kind: str, digits: str) -> str:
        return str(self.permuted(kind, 10 ** len(digits), int(digits))).zfill(len(digits))

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        body = self.digits("card", digits[:-1])
        while len(set(body + str(luhn(body)))) == 1:  # such a number would not be recognised again
            body = self.digits("card", body)
        return refill(text, body + str(luhn(body)))

    def phone(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        keep = max(0, len(digits) - 10)
        return refill(text, digits[:keep] + self.digits("phone", digits[keep:]))

    def ip(self, text: str) -> str | None:
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
            return None
        x = self.permuted("ip", 1 << 32, int.from_bytes(bytes(parts), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def ssn(self, text: str) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        place = area - 1 - (area > 666)
        x = self.permuted("ssn", 898 * 99 * 9999, (place * 99 + group - 1) * 9999 + serial - 1)
        x, serial = divmod(x, 9999)
        place, group = divmod(x, 99)
        return f"{place + 1 + (place >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1 or not _DIGIT.search(plain[4:]):
            return None
        body = refill(plain[4:], self.digits("iban" + plain[:2], "".join(_DIGIT.findall(plain[4:]))))
        check = 98 - number(body + plain[:2] + "00") % 97
        new = iter(plain[:2] + f"{check:02d}" + body)
        return re.sub(r"[A-Z0-9]", lambda _: next(new), text)

    def date(self, text: str) -> str | None:
        separator = next(c for c in text if not c.isdigit())
        parts = text.split(separator)
        if len(parts) != 3:
            return None
        forms = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0), (2, 0, 1)]  # day first where both can be read
        for y, m, d in forms:
            try:
                day = datetime.date(int(parts[y]), int(parts[m]), int(parts[d])).toordinal()
            except ValueError:
                continue
            if FIRST_DAY <= day <= LAST_DAY:
                break
        else:
            return None
        day_first = forms[0] == (y, m, d)
        while True:  # walk on until the pseudonym is read in the same order again
            day = FIRST_DAY + self.permuted("date", LAST_DAY - FIRST_DAY + 1, day - FIRST_DAY)
            new = datetime.date.fromordinal(day)
            if day_first or new.day > 12:
                break
        out = [""] * 3
        out[y], out[m], out[d] = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
        return separator.join(out)

    def email(self, text: str) -> str | None:
        local, _, host = text.partition("@")
        letters = re.findall(r"[a-z]", local.lower())
        digits = _DIGIT.findall(local)
        if not letters and not digits:
            return None
        # Letters and digits of the local part are one number, in base 26 and 10.
        size, x = 26 ** len(letters) * 10 ** len(digits), 0
        for c in letters:
            x = x * 26 + ord(c) - 97
        for c in digits:
            x = x * 10 + int(c)
        x = self.permuted("email", size, x)
        new = {}
        for i in reversed(range(len(digits))):
            x, r = divmod(x, 10)
            new["d", i] = str(r)
        for i in reversed(range(len(letters))):
            x, r = divmod(x, 26)
            new["l", i] = chr(97 + r)
        at = Counter()

        def put(m):
            kind = "d" if m[0].isdigit() else "l"
            at[kind] += 1
            c = new[kind, at[kind] - 1]
            return c.upper() if m[0].isupper() else c

        return re.sub(r"[a-zA-Z0-9]", put, local) + "@" + host

    def _replace(self, match) -> str:
        kind = match.lastgroup
        text = match[0]
        new = getattr(self, kind)(text)
        if new is None and kind == "card" and (phone := re.fullmatch(_PHONE, text)):
            kind, new = "phone", self.phone(phone[0])
        if new is None:
            return text
        self.counts[kind] += 1
        return new

    def __call__(self, text: str) -> str:
        if "@" in text:
            return PATTERN.sub(self._replace, text)
        return NUMBERS.sub(self._replace, text) if _DIGIT.search(text) else text


def pseudonymise(docs: DataFrame, key: bytes, into: str = "pii", back: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``text`` rewritten, and a struct ``into`` of how many values of each kind were replaced.

    Kinds: payment cards (Luhn), phone numbers, IPv4 addresses, US social security numbers, IBANs (mod 97), calendar dates from
    1900 to 2099, and the local part of e-mail addresses.  Numbers that fail their validation stay.  NULL texts stay
    NULL with counts of 0, empty ones empty; rows are judged one by one, so ids, repeats and hot groups do not matter.  An
    empty table gives an empty one.  A column named ``into`` is replaced.
    """
    prepare(docs.sparkSession)
    docs = docs.drop(into) if into in docs.columns else docs
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            names = Pseudonyms(key, back)
            texts, counts = [], {k: [] for k in KINDS}
            for text in batch.column(at).to_pylist():
                names.counts.clear()
                texts.append(None if text is None else names(text))
                for k in KINDS:
                    counts[k].append(names.counts[k])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            struct = pa.StructArray.from_arrays([pa.array(counts[k], pa.int64()) for k in KINDS], KINDS)
            yield pa.RecordBatch.from_arrays([*columns, struct], [*batch.schema.names, into])

    return with_column(docs, run, StructField(into, StructType([StructField(k, LongType()) for k in KINDS])))


# The key of the registered query.  Pass your own, kept secret, for real data.
DEMO_KEY = b"replace this key"


@query("op10_pii_pseudonyms")
def op10(spark, sf_dir):
    out = pseudonymise(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), DEMO_KEY)
    return out.select("doc_id", sum((F.col(f"pii.{k}") for k in KINDS), F.lit(0)).cast("bigint").alias("n_replaced"),
                      *[F.col(f"pii.{k}").alias(f"n_{k}") for k in KINDS], "text")
