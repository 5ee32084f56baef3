"""Format-preserving pseudonyms for personal numbers, dates and addresses in texts.

A value is recognised by its form, validated (check digits, ranges, calendar), mapped to
its index among all valid values of that form, moved by a keyed permutation of those
indexes and written back in the same form. The permutation is a Feistel network over the
next even power of two, walked until it lands inside the range, so it is one to one:
equal values get equal pseudonyms in every document and run with the same key, different
values never the same one, and whoever holds the key can turn pseudonyms back.

=========  ==========================================  ==============================
kind       validated                                   kept as it is
=========  ==========================================  ==============================
email      one ``@``, a dotted domain                  domain, length, punctuation
card       13 to 19 digits, check digit (Luhn)         first digit, separators
phone      North American, or ``+`` and 8-15 digits    country code, separators
ip         four numbers up to 255                      dots
ssn        area, group and serial in use               dashes
iban       check digits (mod 97)                       country, separators
date       in the calendar, years 1900 to 2099         order, separators, padding
=========  ==========================================  ==============================

A date's pseudonym depends on the day alone, so one day written in two ways stays one day.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.jobs import ready

#: Key of the registered query; a real run passes its own secret.
DEMO_KEY = b"ledgerlane demonstration key"
ROUNDS = 8
#: Values a worker remembers; beyond, it starts anew.
REMEMBERED = 100_000

FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()

EMAIL = re.compile(r"(?<![\w.+%-])_*[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])")
#: Forms that hold digits, in order of precedence where two begin at one place.
NUMBER = re.compile(
    r"(?<![\w.+-])(?:"
    r"(?P<iban>[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?!\w)"
    r"|(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?![\w]|\.\d)"
    r"|(?P<iso>\d{4}-\d{2}-\d{2})(?:(?![\w-])|(?=[Tt]\d{2}))"
    r"|(?P<ymd>\d{4}/\d{1,2}/\d{1,2})(?:(?!\w)|(?=[Tt]\d{2}))"
    r"|(?P<dmy>\d{1,2}(?P<sep>[./])\d{1,2}(?P=sep)\d{4})(?!\w)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?P<card>\d(?:[\x20-]?\d){12,18})(?![\w])"
    r"|(?P<nanp>(?:\+?1[\x20.-]?)?\(\d{3}\)\x20?\d{3}[\x20.-]\d{4}|(?:\+?1[\x20.-])?\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"
    r"|(?P<intl>\+\d{1,3}(?:[\x20.-]?\(?\d{1,4}\)?){2,6})(?!\w)"
    r")"
)


class Permutation:
    """A keyed one-to-one map of range(size) onto itself, named apart by ``tweak``."""

    def __init__(self, key: bytes, tweak: str, size: int) -> None:
        self.key, self.tweak, self.size = key, tweak.encode(), size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.width = (self.half + 7) // 8

    def _round(self, i: int, x: int) -> int:
        """As many digest bits as a half has, in blocks of 64 bytes where one is too short."""
        data = self.tweak + bytes([0, i]) + x.to_bytes(self.width, "big")
        size = self.width + 8
        out = hashlib.blake2b(data, key=self.key[:64], digest_size=min(64, size)).digest()
        block = 0
        while len(out) < size:
            block += 1
            out += hashlib.blake2b(data + block.to_bytes(8, "big"), key=self.key[:64], digest_size=64).digest()
        return int.from_bytes(out, "big") & self.mask

    def _once(self, x: int) -> int:
        left, right = x >> self.half, x & self.mask
        for i in range(ROUNDS):
            left, right = right, left ^ self._round(i, right)
        return left << self.half | right

    def _back(self, x: int) -> int:
        left, right = x >> self.half, x & self.mask
        for i in reversed(range(ROUNDS)):
            left, right = right ^ self._round(i, left), left
        return left << self.half | right

    def __call__(self, x: int, inverse: bool = False) -> int:
        # The network's range is at most four times as large, so a few steps suffice.
        step = self._back if inverse else self._once
        x = step(x)
        while x >= self.size:
            x = step(x)
        return x


def _to_index(digits: list[int], sizes: list[int]) -> int:
    out = 0
    for d, size in zip(digits, sizes, strict=True):
        out = out * size + d
    return out


def _from_index(x: int, sizes: list[int]) -> list[int]:
    out = []
    for size in reversed(sizes):
        x, d = divmod(x, size)
        out.append(d)
    return out[::-1]


def luhn_digit(body: str) -> str:
    total = sum((2 * d - 9 if d > 4 else 2 * d) if i % 2 == 0 else d for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


class Pseudonyms:
    """Pseudonyms of single values under one key; ``inverse`` turns them back."""

    def __init__(self, key: bytes, inverse: bool = False) -> None:
        if not key:
            raise ValueError("a key is needed")
        self.key, self.inverse = key, inverse
        self.known: dict[tuple[str, str], str | None] = {}

    def move(self, tweak: str, digits: list[int], sizes: list[int]) -> list[int]:
        size = 1
        for s in sizes:
            size *= s
        return _from_index(Permutation(self.key, tweak, size)(_to_index(digits, sizes), self.inverse), sizes)

    def __call__(self, kind: str, value: str) -> str | None:
        """The pseudonym, or None if the value is not valid for its kind."""
        if (kind, value) not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[kind, value] = getattr(self, f"_{kind}")(value)
        return self.known[kind, value]

    @staticmethod
    def _refill(value: str, replace: Callable[[str], bool], new: str) -> str:
        """``value`` with the characters that ``replace`` accepts exchanged for ``new``, in order."""
        rest = iter(new)
        return "".join(next(rest) if replace(c) else c for c in value)

    def _letters(self, tweak: str, text: str) -> str:
        """Digits stay digits, small letters small, capitals capital."""
        bases = [("0", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26) for c in text]
        moved = self.move(
            f"{tweak}:{''.join(b for b, _ in bases)}",
            [ord(c) - ord(b) for c, (b, _) in zip(text, bases, strict=True)],
            [n for _, n in bases],
        )
        return "".join(chr(ord(b) + d) for d, (b, _) in zip(moved, bases, strict=True))

    def _email(self, value: str) -> str:
        local, _, domain = value.rpartition("@")
        plain = "".join(c for c in local if c.isalnum())
        return self._refill(local, str.isalnum, self._letters("email", plain)) + "@" + domain

    def _card(self, value: str) -> str | None:
        digits = "".join(c for c in value if c.isdigit())
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        moved = self.move(f"card:{len(digits)}:{digits[0]}", [int(c) for c in digits[1:-1]], [10] * (len(digits) - 2))
        body = digits[0] + "".join(map(str, moved))
        return self._refill(value, str.isdigit, body + luhn_digit(body))

    def _ip(self, value: str) -> str | None:
        parts = [int(x) for x in value.split(".")]
        if max(parts) > 255 or any(str(p) != x for p, x in zip(parts, value.split("."), strict=True)):
            return None
        return ".".join(map(str, self.move("ip", parts, [256] * 4)))

    def _ssn(self, value: str) -> str | None:
        area, group, serial = map(int, value.split("-"))
        if not 0 < area < 900 or area == 666 or not group or not serial:
            return None
        a, g, s = self.move("ssn", [area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999])
        return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"

    def _nanp(self, value: str) -> str | None:
        digits = "".join(c for c in value if c.isdigit())
        # Any ten digits count: many texts show numbers outside the assigned area codes.
        moved = self.move("phone:1", [int(c) for c in digits[-10:]], [10] * 10)
        return self._refill(value, str.isdigit, digits[:-10] + "".join(map(str, moved)))

    def _intl(self, value: str) -> str | None:
        digits = "".join(c for c in value if c.isdigit())
        code = re.match(r"\+(\d+)", value)[1]
        if len(code) > 3 or len(code) == len(digits):
            code = digits[:2]
        if not 8 <= len(digits) <= 15:
            return None
        rest = digits[len(code) :]
        moved = self.move(f"phone:{code}:{len(rest)}", [int(c) for c in rest], [10] * len(rest))
        return self._refill(value, str.isdigit, code + "".join(map(str, moved)))

    def _iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _iban_number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = self._letters(f"iban:{plain[:2]}", plain[4:])
        check = 98 - _iban_number(body + plain[:2] + "00") % 97
        return self._refill(value, lambda c: c != " ", f"{plain[:2]}{check:02d}{body}")

    def _day(self, year: int, month: int, day: int) -> date | None:
        try:
            at = date(year, month, day).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= at <= LAST_DAY:
            return None
        size = LAST_DAY - FIRST_DAY + 1
        return date.fromordinal(FIRST_DAY + self.move("date", [at - FIRST_DAY], [size])[0])

    def _iso(self, value: str) -> str | None:
        moved = self._day(*map(int, value.split("-")))
        return moved and moved.isoformat()

    def _ymd(self, value: str) -> str | None:
        year, month, day = value.split("/")
        moved = self._day(int(year), int(month), int(day))
        widths = [2 if len(x) == 2 else 1 for x in (month, day)]
        return moved and f"{moved.year:04d}/{moved.month:0{widths[0]}d}/{moved.day:0{widths[1]}d}"

    def _dmy(self, value: str) -> str | None:
        """Day first, or month first where only that is a date; padded where the text is."""
        sep = "." if "." in value else "/"
        first, second, year = value.split(sep)
        for swap in (False, True):
            day, month = (second, first) if swap else (first, second)
            moved = self._day(int(year), int(month), int(day))
            if moved:
                pair = (moved.month, moved.day) if swap else (moved.day, moved.month)
                widths = [2 if len(x) == 2 else 1 for x in (first, second)]
                return sep.join([f"{pair[0]:0{widths[0]}d}", f"{pair[1]:0{widths[1]}d}", f"{moved.year:04d}"])
        return None

    def replace(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with pseudonyms, and (start, end, kind) of each replaced value in the original."""
        spans: list[tuple[int, int, str, str]] = []
        if "@" in text:
            for m in EMAIL.finditer(text):
                spans.append((m.start(), m.end(), "email", self("email", m[0])))
        taken = [(a, b) for a, b, *_ in spans]
        at = 0
        for m in iter(lambda: NUMBER.search(text, at), None):
            kind = m.lastgroup if m.lastgroup != "sep" else "dmy"
            value = m[0]
            new = self(kind, value)
            if new is None and kind in ("card", "intl"):
                # Numbers may stand side by side; try what ends at an earlier separator, longest first.
                for cut in reversed([x.start() for x in re.finditer(r"[\x20-](?=\d)", value)]):
                    if sum(c.isdigit() for c in value[:cut]) >= (13 if kind == "card" else 8):
                        new = self(kind, value[:cut])
                        if new is not None:
                            value = value[:cut]
                            break
            # An invalid value may hold a valid one of another form; go on behind its first run of digits.
            if new is None:
                at = m.start() + len(re.match(r"\D*\d+", value)[0])
                continue
            at = m.start() + len(value)
            if not any(a < at and m.start() < b for a, b in taken):
                spans.append((m.start(), at, _NAMES.get(kind, kind), new))
        spans.sort()
        out, last = [], 0
        for start, end, _, new in spans:
            out += [text[last:start], new]
            last = end
        return "".join([*out, text[last:]]), [(a, b, k) for a, b, k, _ in spans]


_NAMES = {"iso": "date", "ymd": "date", "dmy": "date", "nanp": "phone", "intl": "phone"}
_HINT = re.compile(r"[0-9@]")


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", inverse: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``pii_spans``: array of (start, end, kind).

    Spans are code points of the original text, by start. Null texts stay null and have no
    spans; empty texts stay empty; repeated rows come out alike; other columns pass through
    unchanged, except one named pii_spans, which is replaced. Invalid values (a wrong check
    digit, the 31st of February) stay as they are. Texts are processed whole.
    """
    ready(docs.sparkSession)
    docs = docs.drop("pii_spans")
    names = docs.columns
    place = names.index(text)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pseudonyms = Pseudonyms(key, inverse)
        for batch in batches:
            texts, spans = [], []
            for value in batch.column(place):
                value = value.as_py()
                if value is None or _HINT.search(value) is None:
                    texts.append(value)
                    spans.append([])
                else:
                    new, found = pseudonyms.replace(value)
                    texts.append(new)
                    spans.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, spans_type)], names=[*names, "pii_spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, pii_spans array<struct<start:bigint,end:bigint,kind:string>>")


def digest(found: DataFrame) -> DataFrame:
    """Per document: the new text, the number of replaced values, and how many of each kind."""
    kinds = F.array_sort(F.array_distinct(F.transform("pii_spans", lambda s: s["kind"])))
    counts = F.transform(
        kinds,
        lambda k: F.concat_ws(":", k, F.size(F.filter("pii_spans", lambda s: s["kind"] == k))),
    )
    return found.select(
        "doc_id", "text", F.size("pii_spans").cast("bigint").alias("n_private"), F.array_join(counts, ",").alias("kinds")
    )
