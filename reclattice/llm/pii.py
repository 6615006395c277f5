"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Base spans are the leftmost non-overlapping matches of four patterns, checked once and never
retried. The method then adds what those miss: cards, addresses and phone numbers inside a match
that failed as a whole, bank account numbers (mod 97), and identity numbers near a context word.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reclattice.llm.common import add_columns

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_id")
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"
ARROW_SPANS = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
    ("base", pa.bool_()), ("score", pa.float64()),
]))

# An address: a run of local characters, then the host. Runs are taken whole (``++``), which
# loses nothing because "@" is not a local character, and keeps the scan linear. A run is tried
# at its start only; EMAIL_HERE also tries the rest of a run right after a match.
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
EMAIL_HERE = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

# Shapes tried by the method on top of the base patterns.
PHONE_SHAPE = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4}(?![0-9])")
IP_SHAPE = re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])")
GROUP = re.compile(r"[0-9]+")
IBAN_SHAPE = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NATIONAL_SHAPE = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Words that raise or lower the score of a span when they stand within WINDOW characters of it.
WINDOW = 48
RAISE = {
    "email": ("mail", "contact", "correo", "courriel", "kontakt"),
    "ip": ("ip", "server", "host", "address", "adresse", "router"),
    "card": ("card", "visa", "credit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "telefon", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social", "security", "identity"),
}
LOWER = ("version", "isbn", "serial", "example", "order", "invoice")
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.85, "phone": 0.8, "iban": 0.9, "national_id": 0.4}
STEP = 0.2
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _only_digits(text: str) -> str:
    return "".join(GROUP.findall(text))


def _emails(text: str) -> list[tuple[int, int]]:
    found, at = [], 0
    while True:
        m = (EMAIL_HERE.match(text, at) if found else None) or EMAIL.search(text, at)
        if m is None:
            return found
        found.append(m.span())
        at = m.end()


def _card_ok(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def _cards_inside(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Runs of whole digit groups in a failed match that are cards, leftmost and longest first."""
    groups = [m.span() for m in GROUP.finditer(text, start, end)]
    found, i = [], 0
    while i < len(groups):
        digits, hit = "", None
        for j in range(i, len(groups)):
            digits += text[groups[j][0]:groups[j][1]]
            if len(digits) > 19:
                break
            if _card_ok(digits):
                hit = j
        if hit is None:
            i += 1
        else:
            found.append((groups[i][0], groups[hit][1]))
            i = hit + 1
    return found


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = text[max(0, start - WINDOW):start] + " " + text[end:end + WINDOW]
    words = [w.lower() for w in WORD.findall(near)]
    score = PRIOR[kind]
    if any(w in RAISE[kind] for w in words):
        score += STEP
    if any(w in LOWER for w in words):
        score -= STEP
    return min(1.0, max(0.0, score))


def spans_of(text: str | None, threshold: float = 0.5) -> list[tuple[str, int, int, bool, float]]:
    """All spans of a text as (kind, start, end, base, score), by kind as in KINDS, then start.

    Offsets count code points. Base spans are kept whatever their score; added ones need
    ``threshold`` and overlap no other span. A null or empty text has none.
    """
    if not text:
        return []
    mail = "@" in text
    if not mail and DIGITS.search(text) is None:
        return []
    base: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    extra: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    if mail:
        base["email"] = _emails(text)
    if DIGITS.search(text) is not None:
        for m in IP.finditer(text):
            # Parts are compared without leading zeros, so their length is no limit.
            parts = [p.lstrip("0") for p in m.group().split(".")]
            ok = all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)
            (base if ok else extra)["ip"].append(m.span())
        for m in CARD.finditer(text):
            ok = _card_ok(_only_digits(m.group()))
            (base if ok else extra)["card"].append(m.span())
        if "+" in text:
            for m in PHONE.finditer(text):
                ok = 9 <= len(_only_digits(m.group())) <= 15
                (base if ok else extra)["phone"].append(m.span())
        proposed = [("card", c) for s, e in extra["card"] if e - s >= 14 for c in _cards_inside(text, s, e)]
        for s, e in extra["phone"]:
            for m in PHONE_SHAPE.finditer(text, s, e):
                if 9 <= len(_only_digits(m.group())) <= 15:
                    proposed.append(("phone", m.span()))
        for s, e in extra["ip"]:
            for m in IP_SHAPE.finditer(text, s, e):
                if all(int(p) <= 255 for p in m.group().split(".")):
                    proposed.append(("ip", m.span()))
        for m in IBAN_SHAPE.finditer(text):
            if mod97(m.group().replace(" ", "")):
                proposed.append(("iban", m.span()))
        proposed += [("national_id", m.span()) for m in NATIONAL_SHAPE.finditer(text)]
    else:
        proposed = []
    out = [(k, s, e, True, _score(k, text, s, e)) for k in BASE_KINDS for s, e in base[k]]
    taken = [(s, e) for _, s, e, _, _ in out]
    for kind, (s, e) in proposed:
        score = _score(kind, text, s, e)
        if score >= threshold and not any(s < b and a < e for a, b in taken):
            out.append((kind, s, e, False, score))
            taken.append((s, e))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def find_spans(df: DataFrame, text: str = "text", out: str = "spans", threshold: float = 0.5) -> DataFrame:
    """``df`` with the array column ``out`` of spans (kind, start, end, base, score) of each text.

    Row by row, no shuffle. Null and empty texts get an empty array; repeated rows stay; a column
    already called ``out`` is replaced.
    """

    def make():
        def step(texts):
            rows = [
                [dict(zip(("kind", "start", "end", "base", "score"), s, strict=True)) for s in spans_of(t, threshold)]
                for t in texts.to_pylist()
            ]
            return [pa.array(rows, ARROW_SPANS)]

        return step

    return add_columns(df, [text], f"{out} {SPAN_TYPE}", make)


def redact(df: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` with every span of its texts replaced by its kind in brackets, as ``[EMAIL]``.

    Spans that overlap are replaced together under the kind of the first. Null texts stay null.
    """

    def clean(value: str | None) -> str | None:
        spans = sorted(spans_of(value, threshold), key=lambda s: (s[1], -s[2]))
        if not spans:
            return value
        parts, at = [], 0
        for kind, start, end, _, _ in spans:
            if start >= at:
                parts += [value[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        return "".join(parts) + value[at:]

    def make():
        return lambda texts: [pa.array([clean(t) for t in texts.to_pylist()], pa.string())]

    order = df.columns
    return add_columns(df, [text], f"`{text}` string", make).select(*[F.col(f"`{c}`") for c in order])


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def digest(df: DataFrame) -> DataFrame:
    """Counts and hash of the base spans, and all spans as one string."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    counts = [count(kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return df.select(
        "doc_id", *counts,
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
