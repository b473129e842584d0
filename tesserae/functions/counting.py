"""Counting inside one text: small helpers in Arrow batches, for what would else be a row a word, or a pass a word.

Each takes a text (or a text with its few keywords) and returns one array, so that nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.keywords import EXPLAINING
from tesserae.functions.text import CANDIDATE, SPACES

_COUNTS = pa.struct([("word", pa.string()), ("n", pa.int64()), ("first", pa.int32()), ("held", pa.int64()), ("at", pa.int64())])
_TOLD = pa.struct([("told", pa.bool_()), ("frequency", pa.int64()), ("best_context", pa.string()), ("context_importance", pa.float64()), ("first_importance", pa.float64())])
_ENDS, _TERMS = re.compile("[。！？.!?]"), re.compile("[ァ-ヴー]{3,}|[A-Z]{2,}|[一-龥]{4,}")


def _lists(made: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    """Lists of tuples as an Arrow array of lists of structs."""
    flat = [x for m in made for x in m]
    columns = [pa.array(c, f.type) for c, f in zip(zip(*flat), kind)] if flat else [pa.array([], f.type) for f in kind]
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, made))], pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind)))


def word_counts(text: Column, pattern: str = CANDIDATE, least: int = 2, stop: tuple[str, ...] = (), k: int | None = None, inside: str = "") -> Column:
    """array<word, n, first, held, at>: the words of a text that match the pattern, in the order of their first places.

    ``k`` keeps the most frequent ones (of equals the first). ``inside`` "held" also counts where a word stands in the
    text at all, inside other words too (3 stands for more), "at" tells the first such place, from 0.
    """
    found, stops = re.compile(pattern), frozenset(stop)

    def of(t: str) -> list[tuple]:
        every = found.findall(t)
        first = dict(zip(reversed(every), range(len(every) - 1, -1, -1)))
        n = Counter(every)
        for w in [w for w in n if len(w) < least or w in stops]:
            del n[w]
        held = (lambda w, c: 3 if c >= 3 else min(3, t.count(w))) if inside == "held" else lambda w, c: None
        at = t.find if inside == "at" else lambda w: None
        return [(w, c, first[w], held(w, c), at(w)) for w, c in (n.most_common(k) if k else n.items())]

    @F.arrow_udf("array<struct<word:string,n:bigint,first:int,held:bigint,at:bigint>>")
    def counted(texts: pa.Array) -> pa.Array:
        return _lists([of(t.as_py() or "") for t in texts], _COUNTS)

    return counted(text)


def frequent_words(parts: Column, k: int, pattern: str = CANDIDATE) -> Column:
    """array<array<string>>: of each text of an array the k words that it holds most often, of equals the first."""
    found = re.compile(pattern)

    @F.arrow_udf("array<array<string>>")
    def frequent(texts: pa.Array) -> pa.Array:
        best = lambda t: [w for w, _ in Counter(w for w in found.findall(t or "") if len(w) > 1).most_common(k)]
        return pa.array([[best(t) for t in p.as_py() or []] for p in texts], pa.list_(pa.list_(pa.string())))

    return frequent(parts)


def _general(s: str) -> tuple[float, float, float]:
    """What a sentence's importance has from its terms, explanations and length; as ``keywords.importance``."""
    told = sum(p in s for p in EXPLAINING) / len(EXPLAINING)
    return min(len(_TERMS.findall(s)) / 5.0, 1.0) * 0.3, told * 0.3, max(0.0, 1.0 - abs(len(s) - 50) / 50) * 0.2


def _told(text: str, words: list[str]) -> list[tuple]:
    parts, general, out = _ENDS.split(text), {}, []
    for w in words:
        best, most, first = "", None, None
        for i, s in enumerate(parts):
            if (at := s.find(w)) < 0:
                continue
            if i not in general:
                general[i] = _general(s)
            a, b, c = general[i]
            x = math.floor(min((1.0 - at / len(s)) * 0.2 + a + b + c, 1.0) * 1e9 + 0.5) / 1e9
            first = x if first is None else first
            if most is None or x > most:
                best, most = s, x
        told = f"{w}とは" in text or (f"{w}は" in text and "である" in text) or f"{w}（" in text
        out.append((told, text.count(w), best.strip(SPACES), most or 0.0, first or 0.0))
    return out


def sentences_told(text: Column, words: Column) -> Column:
    """array<told, frequency, best_context, context_importance, first_importance> of a text's keywords, from one pass of its sentences."""

    @F.arrow_udf("array<struct<told:boolean,frequency:bigint,best_context:string,context_importance:double,first_importance:double>>")
    def told(texts: pa.Array, sets: pa.Array) -> pa.Array:
        return _lists([_told(t.as_py() or "", w.as_py() or []) for t, w in zip(texts, sets)], _TOLD)

    return told(text, words)
