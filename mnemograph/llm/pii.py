"""PII: format-preserving pseudonyms from keyed Feistel permutations.

Values are found by pattern and validated (Luhn for card numbers, ranges for addresses, the
calendar for dates, check digits for IBAN), then permuted within their own format: a
valid card number becomes another valid card number with the same separators, a date
another date. The permutation depends on the key and the kind only, so equal values stay
equal in all documents, and whoever has the key can turn them back with ``reveal``.

Balanced Feistel rounds work on digits of any radix; where a format has fewer members than
the digits allow, the permutation is repeated until it lands on a member, which is again
a permutation.

Defined results: a null text stays null, text without such values stays as it is,
invalid look-alikes stay, and what they cover is searched again. Rows are independent; repeated rows give equal results, null ids
stay, other columns pass through whatever their names, an empty table gives an empty
result. Whole texts are searched, however long. A value of one character or a format of few
members may map to itself.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from mnemograph.llm.common import arrow_map, text_slices

SLICE_BYTES = 12 << 20
ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

# A cheap first look (RE2 syntax): a text without any of these cannot match.
# Its white space is Python's, which is more than RE2's \s.
MAYBE = (r"[0-9]{2}|[0-9]\.[0-9]|@|AKIA|ASIA|"
         r"[=:][\t-\r\x1c-\x20\x{85}\p{Z}]*[\"']?[A-Za-z0-9_+/-]{16}")

FORMS = r"""
    (?P<secret>(?<=[=:])\s*["']?(?P<secret_value>[A-Za-z0-9_+/-]{16,})(?![\w]))
  | (?P<access>(?<!\w)A[KS]IA(?P<access_value>[A-Z0-9]{16})(?!\w))
  | (?P<email>(?<![\w.+-])(?P<email_value>[\w.+-]+)@(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}))
  | (?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?(?!\w))
  | (?P<ipv4>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9]))
  | (?P<date>(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?!(?!T[0-9])[\w/-]|\.[0-9]))
  | (?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
  | (?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}
      |\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?!\w))
  | (?P<card>(?<![\w+])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?!\w))
"""
PATTERN = re.compile(FORMS, re.X)
#: Each kind alone, in the order in which they are tried at one place.
KINDS = {re.match(r"\s*(?:\| )?\(\?P<(\w+)>", x)[1]: re.compile(x.lstrip(" |"), re.X)
         for x in re.split(r"\n(?=  \| )", FORMS.strip("\n"))}
ASSIGNED = re.compile(r"(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|auth)\w*[\"']?\s*[=:]\Z", re.I)

#: Characters of an IBAN by country.
IBAN_LENGTH = {c[:2]: int(c[2:]) for c in """
    AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28
    EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26
    IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28
    NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25
    SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30""".split()}

SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()),
                   StructField("end", IntegerType())])


class Feistel:
    """A keyed permutation of numbers below ``radix ** width``."""

    def __init__(self, key: bytes, tweak: str, radix: int, width: int):
        self.tweak, self.key = f"{tweak}/{radix}/{width}/".encode(), key
        self.sizes = radix ** (width // 2), radix ** (width - width // 2)

    def mix(self, turn: int, half: int) -> int:
        data = self.tweak + bytes([turn]) + half.to_bytes((half.bit_length() + 7) // 8 + 1, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def forth(self, x: int) -> int:
        a, b = divmod(x, self.sizes[1])
        for i in range(ROUNDS):
            if i % 2:
                b = (b + self.mix(i, a)) % self.sizes[1]
            else:
                a = (a + self.mix(i, b)) % self.sizes[0]
        return a * self.sizes[1] + b

    def back(self, x: int) -> int:
        a, b = divmod(x, self.sizes[1])
        for i in reversed(range(ROUNDS)):
            if i % 2:
                b = (b - self.mix(i, a)) % self.sizes[1]
            else:
                a = (a - self.mix(i, b)) % self.sizes[0]
        return a * self.sizes[1] + b


def luhn_digit(digits: str) -> str:
    """The digit that makes ``digits`` and it a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def iban_valid(text: str) -> bool:
    flat = text.replace(" ", "")
    return 15 <= len(flat) <= 34 and iban_number(flat[4:] + flat[:4]) % 97 == 1


def iban_end(text: str) -> int:
    """Where the IBAN at the start of a match ends: the match may go on into the next words."""
    left = IBAN_LENGTH.get(text[:2], 0)
    for end, c in enumerate(text, 1):
        left -= c != " "
        if left == 0:
            return end if text[end:end + 1] in ("", " ") and iban_valid(text[:end]) else len(text)
    return len(text)


class Permuter:
    """Pseudonyms of one key, or the way back to the values."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = hashlib.blake2b(key, digest_size=32).digest(), back
        self.value = lru_cache(100_000)(self._value)

    def number(self, x: int, tweak: str, radix: int, width: int,
               member: Callable[[int], bool] = lambda _: True) -> int:
        f = Feistel(self.key, tweak, radix, width)
        step = f.back if self.back else f.forth
        x = step(x)
        while not member(x):
            x = step(x)
        return x

    def digits(self, text: str, tweak: str) -> str:
        return str(self.number(int(text), tweak, 10, len(text))).zfill(len(text)) if text else ""

    def characters(self, text: str, tweak: str) -> str:
        """Letters among letters of their case and digits among digits, hex among hex."""
        kinds: dict[str, list[int]] = {}
        hexed = bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text)) and not text.isdigit()
        for i, c in enumerate(text):
            if c.isascii() and c.isalnum():
                name = "0123456789abcdef" if hexed else "0123456789" if c.isdigit() else \
                    "abcdefghijklmnopqrstuvwxyz"
                kinds.setdefault(name if not c.isupper() else name.upper(), []).append(i)
        if hexed:
            name = "0123456789ABCDEF" if text.upper() == text else "0123456789abcdef"
            kinds = {name: list(range(len(text)))}
        out = list(text)
        for name, places in kinds.items():
            radix, x = len(name), 0
            for i in places:
                x = x * radix + name.index(text[i])
            x = self.number(x, tweak, radix, len(places))
            for i in reversed(places):
                x, d = divmod(x, radix)
                out[i] = name[d]
        return "".join(out)

    def _value(self, kind: str, text: str) -> str | None:
        """The pseudonym of a value; None if it is not valid."""
        return getattr(self, kind)(text)

    @staticmethod
    def refill(text: str, digits: str) -> str:
        """``text`` with its digits exchanged, separators as they are."""
        new = iter(digits)
        return "".join(next(new) if "0" <= c <= "9" else c for c in text)

    @staticmethod
    def plain(text: str) -> str:
        return re.sub(r"[^0-9]", "", text)

    def card(self, text: str) -> str | None:
        d = self.plain(text)
        if luhn_digit(d[:-1]) != d[-1]:
            return None
        body = self.digits(d[:-1], "card")
        return self.refill(text, body + luhn_digit(body))

    def phone(self, text: str) -> str | None:
        d = self.plain(text)
        if not 8 <= len(d) <= 15:
            return None
        lead = len(re.match(r"\+([0-9]{1,3})(?![0-9])|", text)[1] or "")
        return self.refill(text, d[:lead] + self.digits(d[lead:], "phone"))

    def ipv4(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        x = self.number(int.from_bytes(bytes(map(int, parts)), "big"), "ipv4", 2, 32)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def ssn(self, text: str) -> str | None:
        def member(x: int) -> bool:
            area, rest = divmod(x, 10 ** 6)
            return area not in (0, 666) and area < 900 and rest // 10000 != 0 and rest % 10000 != 0

        x = int(self.plain(text))
        return self.refill(text, str(self.number(x, "ssn", 10, 9, member)).zfill(9)) \
            if member(x) else None

    def date(self, text: str) -> str | None:
        order = ("%Y-%m-%d",) if "-" in text else ("%d.%m.%Y",) if "." in text else \
            ("%m/%d/%Y", "%d/%m/%Y")
        for form in order:
            try:
                day = datetime.datetime.strptime(text, form).date().toordinal()
            except ValueError:
                continue
            if FIRST_DAY <= day <= LAST_DAY:
                span = LAST_DAY - FIRST_DAY + 1
                # With slashes a day up to the 12th reads both ways: dates permute
                # among those that read the same way as before.
                def member(x: int, form: str = form) -> bool:
                    if x >= span:
                        return False
                    day = datetime.date.fromordinal(FIRST_DAY + x).day
                    return "/" not in form or (form == "%m/%d/%Y" or day > 12)

                if not member(day - FIRST_DAY):
                    return None
                x = self.number(day - FIRST_DAY, "date" + form[1], 10, 5, member)
                new = datetime.date.fromordinal(FIRST_DAY + x)
                return form.replace("%Y", f"{new.year:04}").replace("%m", f"{new.month:02}") \
                    .replace("%d", f"{new.day:02}")
        return None

    def iban(self, text: str) -> str | None:
        if not iban_valid(text):
            return None
        flat = text.replace(" ", "")
        body = flat[4:]
        while True:
            body = self.characters(body, "iban" + flat[:2])
            check = 98 - iban_number(body + flat[:2] + "00") % 97
            new = iter(flat[:2] + f"{check:02}" + body)
            out = "".join(c if c == " " else next(new) for c in text)
            if iban_end(out) == len(out):       # else the way back would find a shorter one
                return out

    def email(self, text: str) -> str:
        return self.characters(text, "email")

    def secret(self, text: str) -> str:
        return self.characters(text, "secret")

    def access(self, text: str) -> str:
        return self.characters(text, "access")

    def valid_at(self, kind: str, m: re.Match) -> tuple[str, int, int] | None:
        """Pseudonym, start and end of the value of a match; None if it is not valid."""
        text = m.string
        start, end = m.span(f"{kind}_value" if kind in ("secret", "access", "email") else kind)
        if kind == "secret" and not ASSIGNED.search(text, max(0, m.start() - 60), m.start()):
            return None
        if kind == "iban":
            end = start + iban_end(text[start:end])
        new = self.value(kind, text[start:end])
        # A phone number of too many digits may be one that runs into a date or the next number.
        if kind == "phone" and new is None and (date := KINDS["date"].search(text, start, end)):
            end = date.start()
        while kind == "phone" and new is None and end > start + 8:
            end -= 1
            if not re.match(r"\w", text[end]) and KINDS[kind].fullmatch(text[start:end]):
                new = self.value(kind, text[start:end])
        return None if new is None else (new, start, end)

    def replaced(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and where they stand in it."""
        out, spans, done, size = [], [], 0, 0
        m = PATTERN.search(text)
        while m:
            kind = m.lastgroup.removesuffix("_value")
            found = self.valid_at(kind, m)
            if found is None:
                # What a rejected candidate covers may still hold values of other kinds.
                for other, form in KINDS.items():
                    own = form.match(text, m.start()) if other != kind else None
                    found = self.valid_at(other, own) if own else None
                    if found:
                        kind = other
                        break
            if found is None:
                m = PATTERN.search(text, m.start() + 1)
                continue
            new, start, end = found
            out += [text[done:start], new]
            size += start - done
            spans.append((kind, size, size + len(new)))
            size, done = size + len(new), end
            m = PATTERN.search(text, end)
        return "".join([*out, text[done:]]), spans


def pseudonymized(docs: DataFrame, key: bytes, text_col: str = "text",
                  spans_col: str | None = None, back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in the text; ``spans_col`` adds (kind, start, end) of each."""
    fields = list(docs.schema.fields)
    if spans_col:
        fields.append(StructField(spans_col, ArrayType(SPAN, False)))
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()),
                                    ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permuter = Permuter(key, back)
        for part in text_slices(batches, text_col, SLICE_BYTES):
            column = part.column(text_col)
            maybe = pc.fill_null(pc.match_substring_regex(column, MAYBE), False).to_pylist()
            texts, spans = [], []
            for text, look in zip(column.to_pylist(), maybe):
                new, found = permuter.replaced(text) if look else (text, [])
                texts.append(new)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            at = part.schema.get_field_index(text_col)
            cols = list(part.columns)
            cols[at] = pa.array(texts, column.type)
            names = list(part.schema.names)
            if spans_col:
                cols.append(pa.array(spans, span_type))
                names.append(spans_col)
            yield pa.RecordBatch.from_arrays(cols, names)

    return arrow_map(docs, run, StructType(fields))


def reveal(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """Turns pseudonyms back into the values they stand for."""
    return pseudonymized(docs, key, text_col, back=True)
