"""Personal data with offset-preserving deobfuscation.

Transducers rewrite a text step by step and carry, for every character they put out, the span of the source
it came from: homoglyphs and compatibility forms become ASCII, zero-width characters vanish, at/dot disguises
become @ and ., spelled digits become digits. The detectors then run on the normalised text, and what they
find is mapped back to source characters. The plain detectors also run on the source itself; their spans
always stay, the transducers only add.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Every match begins at the start of a run of digits; looking there alone reads no run more than a few times.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones, and the characters without width.
LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсхуһԁѵԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρι", "ABESIJKMHOPCTXYaesijopcxyhdvqwABEZHIKMNOPTYXoavpi"))
ZERO_WIDTH = "­​‌‍⁠﻿"
# The digits spelled out, in English, German, French and Spanish.
DIGITS = (
    ("zero", "oh", "null", "zéro", "cero"), ("one", "eins", "un", "une", "uno"), ("two", "zwei", "deux", "dos"),
    ("three", "drei", "trois", "tres"), ("four", "vier", "quatre", "cuatro"), ("five", "fünf", "cinq", "cinco"),
    ("six", "sechs", "seis"), ("seven", "sieben", "sept", "siete"), ("eight", "acht", "huit", "ocho"), ("nine", "neun", "neuf", "nueve"),
)


def _folds() -> dict[int, str]:
    """Characters whose compatibility form is one printable ASCII character, other scripts' digits, look-alikes."""
    out = {}
    for a, b in ((0xB2, 0xBA), (0x660, 0x66A), (0x6F0, 0x6FA), (0x966, 0x970), (0x2070, 0x2090), (0x2460, 0x2469), (0xFE50, 0xFE6C), (0xFF01, 0xFF5F), (0x1D400, 0x1D800)):
        for c in range(a, b):
            form = unicodedata.normalize("NFKC", chr(c))
            form = form if len(form) == 1 and " " < form < "\x7f" else str(unicodedata.digit(chr(c), ""))
            if len(form) == 1:
                out[c] = form
    return out | {ord(k): v for k, v in LOOKALIKES.items()} | {0x2024: ".", 0x2010: "-", 0x2011: "-", 0x3002: "."}


FOLDS = _folds()
_ODD_SET = frozenset(map(chr, FOLDS)) | frozenset(ZERO_WIDTH)
_VALUE = {w: str(i) for i, words in enumerate(DIGITS) for w in words}
_DIGIT = "(?:" + "|".join(sorted(_VALUE, key=lambda w: (-len(w), w))) + ")"
_RUN = re.compile(rf"(?<!\w)(?:(?:plus|\+)[ ,-]*)?(?:{_DIGIT}|[0-9]+)(?:[ ,.\-]+(?:dot|point|{_DIGIT}|[0-9]+))+(?!\w)", re.I)
_TOKEN = re.compile(rf"plus|dot|point|{_DIGIT}|[0-9]|\+", re.I)
_SPELLED = re.compile(rf"(?<!\w){_DIGIT}[ ,.\-]+(?:(?:dot|point)[ ,.\-]+)?{_DIGIT}(?!\w)", re.I)
_SPELLING = frozenset(_VALUE) | {"dot", "point"}
_LETTERS = re.compile(r"[^\W\d_]+")
_ANY_DIGIT = re.compile("[0-9]")
_DISGUISED = re.compile(r"[\[({<]\s*+(at|@|dot|\.)\s*+[\])}>]", re.I)
_WORDS = re.compile(r"\s(?:dot|@)\s|\s@|@\s", re.I)
_AT = re.compile(r"(?<=\s)at(?=\s)|@", re.I)
_NAME, _TIED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-"), re.compile(r"[\w.%+-]")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\s++dot\s++)[A-Za-z0-9-]++)++", re.I)
_DOT = re.compile(r"\s+dot\s+", re.I)
_SLIPS = re.compile(r"(?<=[0-9])[OolI](?=[0-9 ().-]|$)|(?<=[ ().+-])[OolI](?=[0-9])")


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain detectors: leftmost, not overlapping within a kind, failures dropped."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        s = at
        while s > free and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, 0, free := m.end()))
        at = text.find("@", max(at + 1, free))
    if not _ANY_DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


class Aligned:
    """A text with, for each of its characters, where its source began and ended."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, found: list[tuple[int, int, str, int, int]]) -> None:
        """found: (start, end, replacement, source start, source end), in order and disjoint; the rest is copied."""
        text, starts, ends, at = [], [], [], 0
        for s, e, new, a, b in found:
            if s < at:
                continue
            text += [self.text[at:s], new]
            starts += self.starts[at:s] + [a] * len(new)
            ends += self.ends[at:s] + [b] * len(new)
            at = e
        self.text = "".join(text) + self.text[at:]
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]

    def span(self, s: int, e: int) -> tuple[int, int]:
        return self.starts[s], self.ends[e - 1]


def fold_glyphs(t: Aligned) -> None:
    t.rewrite([(i, i + 1, FOLDS.get(ord(c), ""), t.starts[i], t.ends[i]) for i, c in enumerate(t.text) if c in _ODD_SET])


def _spaced(text: str, s: int, e: int, least: int) -> tuple[int, int]:
    """The span with the white space around it, from ``least`` on."""
    while s > least and text[s - 1].isspace():
        s -= 1
    while e < len(text) and text[e].isspace():
        e += 1
    return s, e


def undo_brackets(t: Aligned) -> None:
    found, free = [], 0
    for m in _DISGUISED.finditer(t.text):
        s, free = _spaced(t.text, m.start(), m.end(), free)
        found.append((s, free, "@" if m[1].lower() in ("at", "@") else ".", t.starts[m.start(1)], t.ends[m.end(1) - 1]))
    t.rewrite(found)


def _name_start(text: str, end: int, least: int) -> int:
    """Where the name that ends at ``end`` begins, its parts joined by dots, spelled or not; -1 where there is none."""
    best, at = -1, end
    while True:
        s = at
        while s > least and text[s - 1] in _NAME:
            s -= 1
        if s == at:
            return best
        if s == 0 or not _TIED.match(text, s - 1):
            best = s
        if s > least and text[s - 1] == ".":
            at = s - 1
            continue
        e, _ = _spaced(text, s, s, least)
        if e == s or e - 3 < least or text[e - 3 : e].lower() != "dot":
            return best
        at, _ = _spaced(text, e - 3, e, least)
        if at == e - 3:
            return best


def undo_words(t: Aligned) -> None:
    """``name at host dot org``: plain words count as disguise only where a spelled dot or a spaced @ shows intent."""
    found, free = [], 0
    for m in _AT.finditer(t.text):
        if m.start() < free:
            continue
        s, e = _spaced(t.text, m.start(), m.end(), free)
        host = _HOST.match(t.text, e)
        begin = _name_start(t.text, s, free) if host else -1
        if begin < 0:
            continue
        free = host.end()
        spelled = bool(_DOT.search(host[0]))
        top = re.split(r"\.|\s+dot\s+", host[0], flags=re.I)[-1]
        if (m[0] == "@" or spelled) and (not spelled or (top.isalpha() and len(top) > 1)):
            for d in (*_DOT.finditer(t.text, begin, s), None, *_DOT.finditer(t.text, e, free)):
                a, b, new = (s, e, "@") if d is None else (d.start(), d.end(), ".")
                found.append((a, b, new, t.starts[a], t.ends[b - 1]))
    t.rewrite(found)


def undo_digits(t: Aligned) -> None:
    found = []
    for m in _RUN.finditer(t.text):
        if not _SPELLED.search(m[0]):
            continue
        tokens = list(_TOKEN.finditer(t.text, m.start(), m.end()))
        while tokens and tokens[-1][0].lower() in ("dot", "point"):
            tokens.pop()
        at = m.start()
        for k in tokens:
            word = k[0].lower()
            new = _VALUE.get(word) or {"plus": "+", "dot": ".", "point": "."}.get(word, word)
            if k.start() > at:
                found.append((at, k.start(), "", 0, 0))
            found.append((k.start(), k.end(), new, t.starts[k.start()], t.ends[k.end() - 1]))
            at = k.end()
    t.rewrite(found)


def undo_slips(t: Aligned) -> None:
    """Letters that stand for digits between digits."""
    t.rewrite([(i := m.start(), i + 1, "0" if m[0] in "Oo" else "1", t.starts[i], t.ends[i]) for m in _SLIPS.finditer(t.text)])


def _has_spelled(text: str) -> bool:
    """Whether two digit words (or a spelled dot) follow each other; a cheap look before the pattern's."""
    flags = bytes(map(_SPELLING.__contains__, _LETTERS.findall(text.lower())))
    return b"\1\1" in flags and _SPELLED.search(text) is not None


#: A transducer runs on texts in which its trigger is found; the cheapest part of each trigger stands first.
TRANSDUCERS = (
    (lambda t: not (t.isascii() or _ODD_SET.isdisjoint(t)), fold_glyphs), (_DISGUISED.search, undo_brackets), (lambda t: ("@" in t or "dot" in t.lower()) and _WORDS.search(t), undo_words),
    (_has_spelled, undo_digits), (lambda t: _ANY_DIGIT.search(t) and _SLIPS.search(t), undo_slips),
)


def find_all(text: str, base: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
    """The plain spans and those that only show after normalisation, by start, kind and end."""
    base = find(text) if base is None else base
    t = None
    for trigger, run in TRANSDUCERS:
        if trigger(text if t is None else t.text):
            t = t or Aligned(text)
            run(t)
    if t is None or t.text == text:
        return base
    seen = set(base)
    for s, kind, e in find(t.text):
        a, b = t.span(s, e)
        seen.add((a, kind, b))
    return sorted(seen)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def private_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, counts of the plain spans, their digest, all spans written out, and how many were added.

    Spans are in code points, end exclusive. A null text counts as empty and has none; repeated rows are
    answered one by one.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"

    def one(text: str | None) -> tuple:
        base = find(text or "")
        spans = find_all(text or "", base)
        n = [sum(k == i for _, k, _ in base) for i in range(4)]
        return (*n, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
        for b in batches:
            cols = list(zip(*[one(t.as_py()) for t in b.column(1)])) or [[]] * 7
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    narrow = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind's name in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join(out) + text[at:]
