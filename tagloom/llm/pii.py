"""Personal data: plain spans, and disguised ones found by offset-preserving deobfuscation.

Transducers rewrite a text step by step (homoglyphs and invisible characters, spelled digits, at/dot disguises) and
keep for every character of the rewritten text the source characters it stands for, so that a match found after
rewriting is mapped back to a span of the source.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def plain_spans(text: str) -> list[Span]:
    """Spans of each kind, leftmost and without overlap inside a kind; matches that fail a kind's test are dropped."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


#: Characters that look like ASCII ones. Full-width forms follow from their code points.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ѕ": "S",
    "ο": "o", "α": "a", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "Ο": "O", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ρ": "P", "Τ": "T", "Χ": "X", "Ζ": "Z",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "﹒": ".", "﹫": "@", " ": " ", " ": " ", " ": " ", "　": " ",
    "­": "", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "",
}
#: The names of the digits.
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")

_glyphs = LOOKALIKES | {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
_GLYPH = re.compile("[" + "".join(map(re.escape, _glyphs)) + "]")
_NAME = "|".join(DIGITS)
_SPELLED = re.compile(rf"\b(?:plus[ -])?(?:{_NAME})(?:[ ,-]{{1,2}}(?:{_NAME}|dot|point|[0-9]+)){{3,}}\b", re.I)
_SPELLED_PART = re.compile(rf"(plus|{_NAME}|dot|point)|([ ,-]+)", re.I)
_BRACKET_AT = re.compile(r"\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?", re.I)
_BRACKET_DOT = re.compile(r"\s?[\[({<]\s?(?:dot|punkt|point|\.)\s?[\])}>]\s?", re.I)
_WORD_AT_DOT = re.compile(r"(?<=[A-Za-z0-9._%+-])( at | @ )[A-Za-z0-9-]+(?:(?: dot | \. |\.)[A-Za-z0-9-]+)+", re.I)
_WORD_SEP = re.compile(r" at | @ | dot | \. ", re.I)
_WORD_DOTS = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: dot [0-9]{1,3}){3}(?![0-9.]| dot )", re.I)
#: What is said before an address, and words that stand before "at" without being one's local part.
_CUE = re.compile(r"\b(?:e-?mails?|mail|write|contact|reach|address)\b[^.!?\n]{0,24}$", re.I)
_PRONOUNS = frozenset(("me", "us", "him", "her", "them", "it", "you"))


class Traced:
    """A rewritten text; character i stands for source characters from starts[i] up to ends[i]."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text = text
        self.starts = list(range(len(text))) if starts is None else starts
        self.ends = list(range(1, len(text) + 1)) if ends is None else ends

    def rewrite(self, pattern: re.Pattern, to: Callable[[re.Match], str]) -> Traced:
        """Each match becomes to(match), whose characters stand for the match's whole source."""
        out, starts, ends, done = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = to(m)
            if new == m[0]:
                continue
            a, b = m.span()
            out += [self.text[done:a], new]
            starts += self.starts[done:a] + [self.starts[a]] * len(new)
            ends += self.ends[done:a] + [self.ends[b - 1]] * len(new)
            done = b
        if not out:
            return self
        return Traced("".join([*out, self.text[done:]]), starts + self.starts[done:], ends + self.ends[done:])


def _spelled(m: re.Match) -> str:
    """A run of digit names as digits; separators between two single digits go."""
    def one(p: re.Match) -> str:
        if p[2]:
            return ""
        word = p[1].lower()
        return "+" if word == "plus" else "." if word in ("dot", "point") else str(DIGITS.index(word))

    return _SPELLED_PART.sub(one, m[0])


def _at_dot(m: re.Match) -> str:
    """An address whose "at" is a word, or stands between spaces, rewritten; prose that only looks like one as it is.

    Its last label has two letters or more and nothing else. A spelled dot or an "@" is enough beside that; else the
    word before must have a digit, a sign or an inner capital beside a letter, or follow a word such as "mail" or "write".
    """
    said, text = m[0], m.string
    start = m.start()
    while start and text[start - 1] in _LOCAL:
        start -= 1
    local = text[start : m.start()]
    if not re.search(r"[ .][A-Za-z]{2,}$", said):
        return said
    sure = "@" in said or re.search(r" dot ", said, re.I)
    marked = re.search(r"[A-Za-z]", local) and re.search(r"[0-9._%+-]|[a-z][A-Z]", local) and not local.endswith(".")
    cued = local.lower() not in _PRONOUNS and _CUE.search(text, max(0, start - 40), start)
    return _WORD_SEP.sub(lambda s: "@" if s[0].strip().lower() in ("at", "@") else ".", said) if sure or marked or cued else said


def deobfuscated(text: str) -> Traced:
    """All transducers in turn."""
    t = Traced(text)
    t = t.rewrite(_GLYPH, lambda m: _glyphs[m[0]])
    t = t.rewrite(_SPELLED, _spelled)
    t = t.rewrite(_BRACKET_AT, lambda m: "@").rewrite(_BRACKET_DOT, lambda m: ".")
    t = t.rewrite(_WORD_DOTS, lambda m: re.sub(" dot ", ".", m[0], flags=re.I))
    return t.rewrite(_WORD_AT_DOT, _at_dot)


def suspicious(text: str) -> bool:
    """Whether any transducer's own pattern matches; where none does, no transducer changes what another one sees."""
    if not text.isascii() and _GLYPH.search(text):
        return True
    return any(p.search(text) for p in (_SPELLED, _BRACKET_AT, _BRACKET_DOT, _WORD_DOTS, _WORD_AT_DOT))


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans): the second adds disguised ones that touch no plain span of their kind."""
    if not text:
        return [], []
    base = plain_spans(text)
    if not suspicious(text):
        return base, base
    seen, more = deobfuscated(text), []
    for kind, a, b in plain_spans(seen.text):
        start, end = seen.starts[a], seen.ends[b - 1]
        if not any(k == kind and s < end and start < e for k, s, e in base) and not any(k == kind and s < end and start < e for k, s, e in more):
            more.append((kind, start, end))
    return base, sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1]))


def written_spans(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redact(text: str, found: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap become one of the first kind."""
    out, done = [], 0
    for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


_FOUND = pa.schema([("doc_id", pa.int64()), ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every whole text.

    The counts are of plain spans, as is the digest; `spans` has the disguised ones too. Offsets count code points,
    ends are exclusive. Null and empty texts have none; repeated rows each give a row.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [spans(t) for t in batch.column("text").to_pylist()]
        counts = [pa.array([sum(k == kind for k, _, _ in b) for b, _ in found], pa.int64()) for kind in KINDS]
        digests = pa.array([hashlib.sha256(written_spans(b).encode()).hexdigest() for b, _ in found])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digests, pa.array([written_spans(a) for _, a in found], pa.string())], schema=_FOUND)

    return map_slices(docs.select(docs["doc_id"].cast("long"), "text"), run, _FOUND)


def redacted(docs: DataFrame) -> DataFrame:
    """The rows with every span in `text` replaced; other columns stay as they are. Null texts stay null."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if not t else redact(t, spans(t)[1]))

    return docs.withColumn("text", clean("text"))
