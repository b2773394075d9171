"""Personal data: regular expressions propose spans, validators confirm them, words nearby adjust the score.

Four base kinds (email, ip, card, phone) are found by fixed patterns and kept whenever they are valid. Two more
kinds are kept by score: `iban` (mod-97 confirms it) and `local_phone` (ten digits without a country code, which
only a word such as "phone" nearby lifts over the threshold). Offsets are code points, the end is exclusive.

Null and empty texts have no spans. Repeated rows give repeated results; each row stands alone, so no key can be
hot. Texts of any length are searched whole, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "local_phone")
BASE = KINDS[:4]
#: Spans of the added kinds are kept from this score on.
THRESHOLD = 0.6
#: Code points before a span in which a context word counts.
NEAR = 48
#: Score without a context word; a context word adds LIFT.
PRIOR = {"email": 0.9, "ip": 0.5, "card": 0.7, "phone": 0.7, "iban": 0.8, "local_phone": 0.35}
LIFT = 0.3
CONTEXT = {
    "email": r"mail|contact",
    "ip": r"\bip\b|address|host|server",
    "card": r"card|visa|credit|payment",
    "phone": r"phone|call|tel\b|mobile|fax",
    "iban": r"iban|account|bank|konto",
    "local_phone": r"phone|call|\btel\b|mobile|fax",
}
_NEARBY = {k: re.compile(v, re.I) for k, v in CONTEXT.items()}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails from its first digit fails from the others too
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an IBAN leaves 1 when its digits, letters as 10 to 35, are divided by 97."""
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ has one possible match: the run of local characters before it, and the domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        free = at + 1
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", free)


def _octets(s: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in s.split("."))


def _card(s: str) -> bool:
    d = digits_of(s)
    return 14 <= len(d) <= 19 and luhn(d)


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        yield from (("email", a, b) for a, b in _emails(text))
    for kind, pattern, valid in (
        ("ip", _IP, _octets),
        ("card", _CARD, _card),
        ("phone", _PHONE, lambda s: 10 <= len(digits_of(s)) <= 15),
        ("iban", _IBAN, mod97),
        ("local_phone", _LOCAL_PHONE, lambda s: True),
    ):
        yield from ((kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(m[0]))


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of one text, by start and then by kind as KINDS lists them."""
    out = []
    for kind, start, end in _proposals(text or ""):
        score = PRIOR[kind] + LIFT * bool(_NEARBY[kind].search(text[max(0, start - NEAR) : start]))
        if kind in BASE or score >= THRESHOLD:
            out.append((kind, start, end, round(min(score, 1.0), 2)))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def redacted(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _joined(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def suspect(text_col: str) -> Column:
    """Every kind of span has a digit or an @: other texts needn't leave the JVM."""
    return F.col(text_col).rlike("[0-9@]")


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and scores (parallel to spans) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find_spans(x.as_py()) for x in b.column(1)]
            base = [[s for s in spans if s[0] in BASE] for spans in found]
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in BASE]
            texts = [
                [hashlib.sha256(_joined(x).encode()).hexdigest() for x in base],
                [_joined(x) for x in found],
                [",".join(f"{s[3]:.2f}" for s in x) for x in found],
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, *(pa.array(x, pa.string()) for x in texts)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.withColumn("text", F.when(suspect("text"), F.col("text"))).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with personal data in one column replaced by the kind in brackets; other columns as they were."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redacted(t, find_spans(t)))

    return docs.withColumn(text_col, F.when(suspect(text_col), clean(F.when(suspect(text_col), F.col(text_col)))).otherwise(F.col(text_col)))
