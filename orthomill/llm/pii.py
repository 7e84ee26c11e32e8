"""Personal data: detectors on the text, and on a normalised tape whose spans map back.

Four detectors (email, ip, card, phone) run on the source text. Where a text shows signs of
disguise, transducers rewrite it: look-alike letters and digits, zero-width characters,
bracketed or spaced "at" and "dot", and runs of spelled digits. Every character of the
rewritten tape remembers the source range it came from, so a match on the tape maps to
source offsets. Such spans are added where they reach beyond every span of the source text;
spans of the source text that they overlap stay in the list.

Defined results: null and empty texts have no spans; base spans of one kind never overlap;
offsets count code points, ends exclusive; every input row gives one row, repeated rows
included; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The same matches as [0-9]+(\.[0-9]+){3} tried everywhere, without rescanning runs of digits.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Look-alike characters and the ASCII they stand for.
LOOKALIKES = {
    "а": "a", "А": "A", "В": "B", "с": "c", "С": "C", "е": "e", "Е": "E", "Н": "H", "і": "i", "І": "I", "ј": "j", "К": "K", "М": "M", "о": "o", "О": "O", "р": "p", "Р": "P", "ѕ": "s", "Т": "T", "у": "y", "х": "x", "Х": "X", "ԁ": "d", "ո": "n", "ԛ": "q", "ԝ": "w",
    "α": "a", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "ι": "i", "Κ": "K", "κ": "k", "Μ": "M", "Ν": "N", "ν": "v", "ο": "o", "Ο": "O", "Ρ": "P", "ρ": "p", "Τ": "T", "τ": "t", "Χ": "X", "Υ": "Y", "Ζ": "Z", "ɡ": "g", "ı": "i", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-",
}
LOOKALIKES |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full-width forms
LOOKALIKES |= {chr(start + i): str(i) for start in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for i in range(10)}
LOOKALIKES |= {c: "" for c in "​‌‍⁠﻿­"}
ODD = re.compile("[" + "".join(map(re.escape, LOOKALIKES)) + "]")
# Spelled digits.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
DIGIT_WORD = "(?ai:" + "|".join(SPELLED) + ")"
SPELLED_RUN = re.compile(rf"(?<!\w){DIGIT_WORD}(?:[\s,-]{{1,2}}{DIGIT_WORD}){{2,}}(?!\w)", re.I)
BRACKETED = r"[\[({{<][\x20\t]?(?:{})[\x20\t]?[\])}}>]"
BRACKET_AT = re.compile(rf"[\x20\t]?{BRACKETED.format('at|@')}[\x20\t]?", re.I)
BRACKET_DOT = re.compile(rf"[\x20\t]?{BRACKETED.format(r'dot|\.')}[\x20\t]?", re.I)
#: Found exactly where BRACKET_AT or BRACKET_DOT is; faster, as it starts at the bracket.
BRACKET = re.compile(BRACKETED.format(r"at|@|dot|\."), re.I)
# the last dot is spelled, or the sign stands between spaces
SPACED = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}(?:(?:\x20at\x20|\x20?@\x20?)[A-Za-z0-9-]{1,63}(?:(?:\x20dot\x20|\.)[A-Za-z0-9-]{1,63})*\x20dot\x20|\x20@\x20[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.)[A-Za-z]{2,24}(?![\w-])", re.I)
SPACED_WORD = re.compile(r"\x20(at|dot)\x20|\x20?(@)\x20?", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base span, in order."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


class Tape:
    """A rewritten text; character i stands for source characters starts[i] to ends[i]."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, replace) -> None:
        out, starts, ends, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            a, b, new = m.start(), m.end(), replace(m)
            if new == m[0]:
                continue
            out += [self.text[last:a], new]
            starts += self.starts[last:a] + [self.starts[a]] * len(new)
            ends += self.ends[last:a] + [self.ends[b - 1]] * len(new)
            last = b
        if last:
            self.text = "".join([*out, self.text[last:]])
            self.starts, self.ends = starts + self.starts[last:], ends + self.ends[last:]


def disguised(text: str) -> bool:
    """Whether any transducer finds anything to rewrite; the tests before a search are needed for its pattern to match."""
    if not text.isascii() and ODD.search(text):
        return True
    if BRACKET.search(text):
        return True
    low = text.lower()
    if ("@" in text or " at " in low) and (" dot " in low or " @ " in text) and SPACED.search(text):
        return True
    return sum(map(low.count, SPELLED)) >= 3 and SPELLED_RUN.search(text) is not None


def spelled_number(m: re.Match) -> str:
    """The digits; of 10 to 13 a phone number, which is rarely spelled with its plus."""
    digits = "".join(SPELLED[w.lower()] for w in re.findall(DIGIT_WORD, m[0], re.I))
    return "+" + digits if 10 <= len(digits) <= 13 else digits


def within(spans: list[tuple[int, int]]):
    """A test whether a match lies inside one of many spans, by the largest end of those that start before it."""
    spans = sorted(spans)
    starts, reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
    return lambda a, b: (at := bisect_right(starts, a)) > 0 and reach[at - 1] >= b


def normalise(text: str) -> Tape:
    tape = Tape(text)
    tape.rewrite(ODD, lambda m: LOOKALIKES[m[0]])
    tape.rewrite(BRACKET_AT, lambda m: "@")
    tape.rewrite(BRACKET_DOT, lambda m: ".")
    spots = [m.span() for m in SPACED.finditer(tape.text)]
    if spots:
        inside = within(spots)
        tape.rewrite(SPACED_WORD, lambda m: m[0] if not inside(*m.span()) else "." if (m[1] or "").lower() == "dot" else "@")
    tape.rewrite(SPELLED_RUN, spelled_number)
    return tape


def find_spans(text: str | None) -> tuple[list, list]:
    """Base spans, and all spans: those and the ones seen only through a disguise."""
    text = text or ""
    base = detect(text)
    if not disguised(text):
        return base, base
    tape, added, known = normalise(text), [], within([(s, e) for s, _, e in base])
    for start, kind, end in detect(tape.text):
        a, b = tape.starts[start], tape.ends[end - 1]
        if text[a:b] != tape.text[start:end] and not known(a, b):
            added.append((a, kind, b))
    return base, sorted(base + added)


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind; overlapping spans become one, of the kind that starts first, the longest of those."""
    if not text:
        return text
    out, last = [], 0
    for a, kind, b in sorted(find_spans(text)[1], key=lambda s: (s[0], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{KINDS[kind].upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]]) if last else text


def personal_data(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, counts by kind over all spans' base part, and the span lists."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1):
                base, spans = find_spans(t.as_py())
                kinds = [k for _, k, _ in base]
                rows.append((*[kinds.count(k) for k in range(4)], hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans) - len(base)))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.string() if i in (4, 5) else pa.int64()) for i, c in enumerate(cols)]], names)

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask_documents(docs: DataFrame, text_col="text", length_col="n_chars") -> DataFrame:
    """The same rows and columns with personal data masked in the text."""
    schema = docs.schema
    names, at = docs.columns, docs.columns.index(text_col)
    at_len = names.index(length_col) if length_col in names else None

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            new = [masked(t.as_py()) for t in cols[at]]
            cols[at] = pa.array(new, pa.string())
            if at_len is not None:
                cols[at_len] = pa.array([None if t is None else len(t) for t in new], cols[at_len].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
