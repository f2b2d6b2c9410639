"""Personal data: regular expressions propose spans, validators confirm them, context words adjust the score.

Kinds, in the order that breaks ties: email, ip (four parts up to 255), card (12 to 19 digits that pass Luhn), phone (+ and 9 to 15 digits), and
two that the method adds: iban (country letters, check digits, mod-97) and ssn (three digit groups in valid ranges, only with a context word
nearby).  Within a kind, matches are the leftmost, non-overlapping ones; a match that its validator rejects is dropped and not tried shorter.
Offsets are code points, the end exclusive.  Each pattern is written so that its time is linear in the text.

Cases: null text counts as empty and has no spans; very long texts are read whole; spans of different kinds may overlap, and of the same start the kind
listed first comes first; redact() merges overlapping spans and names the first; repeated rows are judged each; an empty table gives no rows; an added column
takes the place of an equally named one.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from boardlark.llm.shared import arrow_pass

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
#: The score of a confirmed span before its context is read.
CONFIDENCE = {"email": 0.95, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
#: Words that speak for a kind, and words that speak against any kind, when they stand near.
FOR = {
    "email": ("email", "mail", "contact", "write", "e-mail"),
    "ip": ("ip", "address", "host", "server", "login", "from"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment", "pay", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta", "transfer"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
AGAINST = ("version", "release", "isbn", "sku", "serial", "order", "invoice", "example", "sample")
#: Code points of context on either side, and what one side's evidence changes.
NEAR, STEP = 48, 0.15
#: A kind that the method adds is kept from this score on; base kinds are always kept.
LEAST = 0.4

_EMAIL_END = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_EMAIL_START = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+(?<=[0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_IBAN_PART = re.compile(r" ?[A-Z0-9]")
#: The length of an international account number by country.
_LENGTHS = """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22
IL23 IS26 IT27 JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VG24 XK20"""
IBAN_LENGTH = {x[:2]: int(x[2:]) for x in _LENGTHS.split()}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
_ANY_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """The sum of the digits, every second from the right doubled and its own digits added, is divisible by 10."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of international bank accounts: first four characters moved to the end, letters as 10 to 35, the number is 1 modulo 97."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def _emails(text: str):
    done = 0
    for m in _EMAIL_END.finditer(text):
        at, low = m.start(), m.start()
        while low > done:  # read back in steps, so that a long run before one sign costs its length only
            step = max(done, low - 256)
            got = _EMAIL_START.search(text, step, low)
            moved = got.start()
            if moved == low:
                break
            low = moved
            if moved > step:
                break
        if low < at:
            done = m.end()
            yield low, done


def _account_end(text: str, start: int, at: int) -> int | None:
    """Where an account number that begins at `start` has its country's length, single blanks aside; None if it has less or more."""
    for _ in range(IBAN_LENGTH.get(text[start : start + 2], 0) - 4):
        m = _IBAN_PART.match(text, at)
        if not m:
            return None
        at = m.end()
    return at if text[start : start + 2] in IBAN_LENGTH and not text[at : at + 1].isalnum() else None


def _proposed(text: str):
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b
    if not _ANY_DIGIT.search(text):
        return
    if "." in text:
        for m in _IP.finditer(text):
            if all(map(_small, m[0].split("."))):
                yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        end = _account_end(text, m.start(), m.end())
        if end and mod97(text[m.start() : end].replace(" ", "")):
            yield "iban", m.start(), end
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's confidence, raised for a word that speaks for it on either side and lowered for one that speaks against."""
    value = CONFIDENCE[kind]
    for side in (text[max(0, start - NEAR) : start], text[end : end + NEAR]):
        words = {w.lower() for w in _WORD.findall(side)}
        value += STEP * (not words.isdisjoint(FOR[kind])) - STEP * (not words.isdisjoint(AGAINST))
    return round(min(1.0, max(0.0, value)), 4)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """The spans of one text as (kind, start, end, score), by start, then kind as listed."""
    text = text or ""
    found = [(k, a, b, score(text, k, a, b)) for k, a, b in _proposed(text)]
    found = [x for x in found if x[0] in BASE_KINDS or x[3] >= LEAST]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    out, at = [], 0
    for kind, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType())])


def detect(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) and pii_spans, an array of kind, start, end and score."""

    def make():
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

        def work(batch: pa.RecordBatch) -> dict:
            rows = [[dict(zip(SPAN.names, x)) for x in find(t)] for t in batch.column(text).to_pylist()]
            return {"pii_spans": pa.array(rows, kind)}

        return work

    return arrow_pass(df, text, df.columns if keep is None else keep, StructType([StructField("pii_spans", ArrayType(SPAN))]), make)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The same columns; each span of the text is replaced by its kind in brackets.  A null text stays null."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            texts = batch.column(text).to_pylist()
            return {text: pa.array([masked(t, s) if t and (s := find(t)) else t for t in texts], pa.string())}

        return work

    return arrow_pass(df, text, df.columns, StructType([StructField(text, StringType())]), make).select(*df.columns)


def digests(df: DataFrame) -> DataFrame:
    """The contract's columns from detect(): counts, the digest of the base spans, all spans as text, and the scores in the same order."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [F.expr(f"CAST(size(filter(pii_spans, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE_KINDS]
    return df.select(
        "doc_id",
        *counts,
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("pii_spans")).alias("spans"),
        F.array_join(F.transform("pii_spans", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )
