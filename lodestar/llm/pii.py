"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Each candidate starts from the prior of its pattern. A validator that its kind
has (Luhn for cards, mod-97 for bank account numbers) rejects it or raises the
score; words near it that speak of its kind raise the score further and words
that speak of something else lower it. Spans whose score reaches ``THRESHOLD``
are reported. The strict patterns of the contract ("base" spans) have a prior
that already reaches it: nothing takes them away again.

The text is scanned whole. Patterns that could retry long runs of one kind of
character are written with possessive repeats or are anchored at the run's
start, so that the time goes by the length of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.store import batch, rows

# The kinds in the order of reports.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]

THRESHOLD = 0.5
#: Characters on either side of a candidate that are searched for context words.
CONTEXT = 48

# Words that speak for a kind, in English, German, French and Spanish.
CONTEXT_WORDS = {
    "card": ("card", "visa", "mastercard", "amex", "american express", "credit", "debit", "karte", "carte", "tarjeta", "cvv"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "contact", "whatsapp", "sms", "telefon", "handy", "anruf", "téléphone", "teléfono", "móvil", "llame"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta", "transfer"),
    "ssn": ("ssn", "social security", "social insurance", "sozialversicherung", "sécurité sociale", "seguridad social"),
}
#: Words before a number that speak against personal data.
AGAINST = ("order", "invoice", "isbn", "issn", "doi", "version", "sku", "serial", "build", "ticket", "tracking")

_WORDS = {k: re.compile(rf"\b(?:{'|'.join(map(re.escape, w))})\b") for k, w in CONTEXT_WORDS.items()}
_AGAINST = re.compile(rf"\b(?:{'|'.join(AGAINST)})\b")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![a-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """The checksum of payment cards: every second digit from the right doubled, digit sums added, divisible by ten."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The checksum of bank account numbers: country and check digits to the end, letters as 10 to 35, remainder one."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)) and "." in m[0]:
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def _near(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()


def _context(kind: str, before: str, after: str) -> float:
    """What the words nearby add to the score of a candidate."""
    score = 0.0
    if _WORDS[kind].search(before):
        score += 0.35
    elif _WORDS[kind].search(after):
        score += 0.2
    if _AGAINST.search(before[-24:]):
        score -= 0.4
    return score


def find(text: str | None) -> list[Span]:
    """All spans of a text, by kind in the order of ``KINDS``, then start; null and empty texts have none."""
    if not text:
        return []
    found: list[Span] = [Span("email", s, e, 0.95, True) for s, e in _emails(text)]
    numbers: list[Span] = []
    if any(d in text for d in "0123456789"):
        numbers += [Span("ip", *m.span(), 0.8, True) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        short: list[tuple[int, int, str]] = []
        for m in _CARD.finditer(text):
            digits = digits_of(m[0])
            if 16 <= len(digits) <= 19:
                if luhn(digits):
                    numbers.append(Span("card", *m.span(), 0.6, True))
            elif 13 <= len(digits) <= 15 and luhn(digits):
                short.append((*m.span(), digits))
        if "+" in text:
            numbers += [Span("phone", *m.span(), 0.7, True) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
        taken = found + numbers
        numbers += list(_additional(text, short, taken))
    order = {k: n for n, k in enumerate(KINDS)}
    return sorted(found + numbers, key=lambda s: (order[s.kind], s.start, s.end))


def _additional(text: str, short: list[tuple[int, int, str]], taken: list[Span]) -> Iterator[Span]:
    """Spans beyond the base patterns; none overlaps a base span or another of these."""
    covered = bytearray(len(text))
    for s in taken:
        covered[s.start : s.end] = b"\1" * (s.end - s.start)

    def accept(kind: str, start: int, end: int, prior: float) -> Iterator[Span]:
        score = prior + _context(kind, *_near(text, start, end))
        if score >= THRESHOLD and 1 not in covered[start:end]:
            covered[start:end] = b"\1" * (end - start)
            yield Span(kind, start, end, min(1.0, round(score, 4)), False)

    for m in _IBAN.finditer(text):
        # What follows an account number may look like more of it, so its end is where the checksum holds.
        ends = [m.end(), *(m.start() + k for k in range(len(m[0]) - 1, 14, -1) if m[0][k] == " ")]
        for end in ends:
            compact = text[m.start() : end].replace(" ", "")
            if 15 <= len(compact) <= 34 and mod97(compact):
                yield from accept("iban", m.start(), end, 0.8)
                break
    for start, end, digits in short:
        # Shorter cards pass Luhn by chance one time in ten, so an issuer's prefix and context must agree.
        known = digits[:2] in ("34", "37") and len(digits) == 15 or digits[:2] in ("36", "38", "30") and len(digits) == 14 or digits[0] == "4" and len(digits) == 13
        yield from accept("card", start, end, 0.3 if known else 0.1)
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield from accept("ssn", *m.span(), 0.35)
    for m in _LOCAL_PHONE.finditer(text):
        if 7 <= len(digits_of(m[0])) <= 12:
            yield from accept("phone", *m.span(), 0.25)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def masked(text: str | None, spans: list[Span] | None = None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; where spans overlap, the first of the outermost counts."""
    if not text:
        return text
    spans = find(text) if spans is None else spans
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.end <= at:
            continue
        out += [text[at : max(at, s.start)], f"<{s.kind.upper()}>"] if s.start >= at else []
        at = s.end
    return "".join(out) + text[at:]


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans of each document: ``doc_id, spans`` with spans as an array of kind, start, end, score, base.

    Starts and ends count code points, ends are exclusive. Null and empty texts
    have an empty array; null ids, repeated rows and ties pass through row by
    row; columns other than the two named are not read.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])

    def scan(batches):
        for b in rows(batches, 512):
            spans = [[s._asdict() for s in find(t)] for t in b.column(1).to_pylist()]
            yield batch(pa.schema([("doc_id", b.schema.field(0).type), ("spans", pa.list_(span))]), b.column(0), spans)

    return source.mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind string, start bigint, end bigint, score double, base boolean>>")


def span_digests(spans: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and the list of all spans, from ``detected``.

    Counts are of base spans.
    """
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("bigint").alias(f"n_{k}")
    return spans.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
    )


def scrubbed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind; rows and other columns stay as they are."""
    names = docs.columns
    at = names.index(text_col)

    def scrub(batches):
        for b in rows(batches, 512):
            texts = pa.array([masked(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(scrub, docs.schema)


__all__ = ["KINDS", "Span", "detected", "find", "luhn", "masked", "mod97", "scrubbed", "span_digests"]
