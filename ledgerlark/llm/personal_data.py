"""Operator 3: personal data: patterns propose spans, checksums confirm them, nearby words move their score."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, texts

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A match inside a run of digits exists only if one from the run's start does, so only starts of runs are tried.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
DIGITS = re.compile(r"[0-9]+")
#: An account's start and what may belong to it; where it ends, mod 97 says.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
#: 19 digits hold no more groups of four, with a last one of any size.
MOST_GROUPS = 5
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

#: Words beside a span that speak for or against it; a span's score starts at BASE and gains or loses STEP for them.
NEAR = 40
CONTEXT = {
    "email": (("mail", "contact", "write", "reach"), ("example", "noreply")),
    "ip": (("ip", "host", "server", "address", "from"), ("version", "section", "release")),
    "card": (("card", "visa", "credit", "payment", "charge"), ("order", "tracking", "serial", "isbn")),
    "phone": (("phone", "call", "tel", "mobile", "fax"), ("version", "score")),
    "iban": (("iban", "account", "bank", "transfer"), ("serial", "part")),
    "ssn": (("ssn", "social", "security", "taxpayer"), ("order", "part", "phone")),
}
BASE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
STEP = 0.2
#: Added kinds count from this score on; base spans always stay.
LEAST = 0.5

ALPHABET = {c: str(int(c, 36)) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(ALPHABET.get(c, c) for c in moved)) % 97 == 1


def _emails(text: str):
    """Leftmost non-overlapping addresses, found from their "@" so that long runs cost linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL_END.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m.groups()))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def _cards_within(text: str, start: int, end: int):
    """Cards among whole digit groups of a run: 13 to 19 digits in groups of four or more, the last of any size.

    Every group may start one, and all that pass are given, overlapping ones too: one number in ten passes by chance,
    and such a find in front (a year, a quantity) must not hide the card behind it.
    """
    groups = [(m.start(), m.end()) for m in DIGITS.finditer(text, start, end)]
    for i, (a, _) in enumerate(groups):
        digits = ""
        for c, d in groups[i : i + MOST_GROUPS]:
            digits += text[c : min(d, c + 20)]
            if len(digits) > 19:
                break
            if len(digits) >= 13 and luhn(digits):
                yield a, d
            if d - c < 4:
                break


def _ibans(text: str):
    """From each start the longest account that ends at the end of a word and passes mod 97."""
    m = IBAN.search(text)
    while m:
        after = m.start() + 4
        for end in range(m.end(), m.start() + 14, -1):
            if text[end - 1] == " " or text[end : end + 1].isascii() and text[end : end + 1].isalnum():
                continue
            if 15 <= len(bare := text[m.start() : end].replace(" ", "")) <= 34 and mod97(bare):
                yield m.start(), end
                after = end
                break
        m = IBAN.search(text, after)


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Finds beyond the base: cards inside longer digit runs, bank accounts (mod 97), social security numbers."""
    taken = {(a, b) for k, a, b in base if k == "card"}
    runs = [m.span() for m in CARD.finditer(text) if m.end() - m.start() > 13 and m.span() not in taken]
    out = [("card", a, b) for run in runs for a, b in _cards_within(text, *run)]
    out += [("iban", a, b) for a, b in _ibans(text)]
    out += [("ssn", m.start(), m.end()) for m in SSN.finditer(text)]
    return [s for s in out if score(text, *s) >= LEAST]


def score(text: str, kind: str, start: int, end: int) -> float:
    """Confidence of a span from its kind's base and the words within ``NEAR`` characters on either side."""
    near = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}".lower()
    words = set(re.findall(r"[a-z]+", near))
    good, bad = CONTEXT[kind]
    value = BASE[kind] + STEP * any(w in words for w in good) - STEP * any(w in words for w in bad)
    return round(min(1.0, max(0.0, value)), 2)


def _listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _row(text: str) -> tuple:
    base = base_spans(text)
    n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:4]]
    spans = sorted({*base, *added_spans(text, base)}, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if base or DIGIT.search(text) else []
    return *n, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans), ",".join(f"{score(text, *s):.2f}" for s in spans)


def find_personal(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: counts of base spans by kind, their digest, all spans, and a score per span.

    Base spans are e-mail addresses, IP addresses (parts up to 255), card numbers (Luhn) and phone numbers; the method
    adds cards inside longer digit runs, IBANs (mod 97) and social security numbers whose context speaks for them.
    Spans are kind:start:end in code points, end exclusive; ``scores`` lists their confidence in the same order.
    Null text is empty text: zero counts, the digest of the empty string, empty lists.  Repeated rows get equal
    results; no rows give no rows.
    """
    return map_rows(texts(docs), _row, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
