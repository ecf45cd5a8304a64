"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Each kind has a pattern, a check, a score for a span that passes the check, and words that raise the score when they
stand close by. A span below ``THRESHOLD`` is dropped, unless its kind is one of the four base kinds, which are kept on
their check alone. Every document is looked at whole and on its own, so nothing is shuffled.

All patterns run in time linear in the text: none can begin again inside a run that it has already rejected.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
CONTEXT_SCORE = 0.35
WORDS_BEFORE, WORDS_AFTER = 48, 24  # code points in which a context word must lie

Span = tuple[int, int]

# The characters of the local part of an address, and the four base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ .-])[0-9]{2,5}(?:[ .-][0-9]{2,5}){0,3}(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def mod97(account: str) -> bool:
    """ISO 7064: the first four characters go to the end, letters count from 10, and the remainder must be 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """An ``@`` with local characters before it and a dotted domain after it.

    Searched from the ``@``: the local part reaches back to the last match or to another character, so that long runs
    of letters are not tried from every place.
    """
    done = 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
        if domain and start < at:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(done, at + 1))


def addresses(text: str) -> Iterator[Span]:
    for found in _IP.finditer(text):
        parts = (part.lstrip("0") for part in found[0].split("."))
        if all(len(part) <= 3 and int(part or 0) <= 255 for part in parts):
            yield found.span()


def cards(text: str) -> Iterator[Span]:
    for found in _CARD.finditer(text):
        digits = _digits(found[0]) if found.end() - found.start() < 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield found.span()


def phones(text: str) -> Iterator[Span]:
    for found in _PHONE.finditer(text):
        if 9 <= len(_digits(found[0])) <= 15:
            yield found.span()


def accounts(text: str) -> Iterator[Span]:
    """International bank account numbers; words in capitals that follow one are left out, group by group."""
    for found in _IBAN.finditer(text):
        start, end = found.span()
        while end - start >= 15:
            account = text[start:end].replace(" ", "").replace("-", "")
            if len(account) <= 34 and mod97(account):
                yield start, end
                break
            end = start + max(text[start:end].rfind(" "), text[start:end].rfind("-"))


def cards_in_chains(text: str) -> Iterator[Span]:
    """Single numbers of a chain of digits that is too long to be one card."""
    for found in _CARD.finditer(text):
        if len(_digits(found[0])) > 19:
            for number in re.finditer(r"[0-9]++", found[0]):
                if 13 <= len(number[0]) <= 19 and luhn(number[0]):
                    yield found.start() + number.start(), found.start() + number.end()


def social_numbers(text: str) -> Iterator[Span]:
    for found in _SSN.finditer(text):
        area, group, serial = found[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield found.span()


def local_phones(text: str) -> Iterator[Span]:
    for found in _LOCAL_PHONE.finditer(text):
        if 7 <= len(_digits(found[0])) <= 12:
            yield found.span()


@dataclass(frozen=True)
class Kind:
    name: str
    propose: Callable[[str], Iterator[Span]]
    score: float
    context: str
    base: bool = False


# In the order of the results; added kinds never overlap a span of an earlier one.
KINDS = (
    Kind("email", emails, 0.9, "mail|email|e-mail|contact|correo|courriel|kontakt", base=True),
    Kind("ip", addresses, 0.6, "ip|address|server|host|adresse|dirección", base=True),
    Kind("card", cards, 0.6, "card|credit|visa|mastercard|amex|carte|tarjeta|karte", base=True),
    Kind("phone", phones, 0.6, "phone|tel|call|mobile|fax|telefon|téléphone|teléfono", base=True),
    Kind("iban", accounts, 0.65, "iban|bank|account|konto|banque|banco|cuenta"),
    Kind("card_in_chain", cards_in_chains, 0.5, "card|credit|visa|mastercard|amex|carte|tarjeta|karte"),
    Kind("ssn", social_numbers, 0.3, "ssn|social security"),
    Kind("local_phone", local_phones, 0.2, "phone|tel|call|mobile|fax|telefon|téléphone|teléfono"),
)
_CONTEXTS = {kind.name: re.compile(rf"\b(?:{kind.context})\b", re.IGNORECASE) for kind in KINDS}
_DIGIT = re.compile(r"[0-9]")


def spans_of(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float, bool]]:
    """Kind, start, end (exclusive, in code points), score and whether the kind is a base one; by kind, then start."""
    found: list[tuple[str, int, int, float, bool]] = []
    has_digit, has_at = _DIGIT.search(text) is not None, "@" in text
    if not has_digit and not has_at:
        return found
    taken: list[Span] = []
    for kind in KINDS:
        if not (has_at if kind.propose is emails else has_digit):
            continue
        starts, reach = ([], []) if kind.base else _reach(taken)
        for start, end in kind.propose(text):
            near = text[max(0, start - WORDS_BEFORE) : start], text[end : end + WORDS_AFTER]
            context = any(_CONTEXTS[kind.name].search(part) for part in near)
            score = round(min(1.0, kind.score + CONTEXT_SCORE * context), 2)
            before = bisect_left(starts, end)
            free = not before or reach[before - 1] <= start
            if kind.base or (score >= threshold and free):
                found.append((kind.name, start, end, score, kind.base))
                taken.append((start, end))
    return found


def _reach(taken: list[Span]) -> tuple[list[int], list[int]]:
    """Sorted starts, and for each the farthest end of the spans up to it."""
    ordered = sorted(taken)
    return [start for start, _ in ordered], list(accumulate((end for _, end in ordered), max))


SCHEMA = "spans array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>"
_SPAN = pa.struct(
    [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]
)
_NAMES = [_SPAN.field(i).name for i in range(_SPAN.num_fields)]


def _column(texts: list[str | None], threshold: float) -> pa.Array:
    offsets, rows = [0], []
    for text in texts:
        rows += spans_of(text or "", threshold)
        offsets.append(len(rows))
    columns = zip(*rows, strict=True) if rows else [[] for _ in _NAMES]
    parts = [pa.array(column, type=_SPAN.field(i).type) for i, column in enumerate(columns)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(_SPAN)))


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, score, base) of every row.

    Offsets count code points, ends are exclusive; spans come in the order of ``KINDS``, then by start. A NULL or empty
    text has no spans. Rows with a NULL or repeated id are rows like any other. Other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = _column(batch.column(1).to_pylist(), threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], ["doc_id", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def masked(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    if text is None:
        return None
    parts, done = [], 0
    for kind, start, end, _, _ in sorted(spans_of(text, threshold), key=lambda s: (s[1], -s[2])):
        if start >= done:
            parts += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(parts) + text[done:]


def mask(docs: DataFrame, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with personal data replaced in ``text``; all columns keep their names, types and order."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda body: masked(body, threshold))

    return docs.select([cleaned(F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
