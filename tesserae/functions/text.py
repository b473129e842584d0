"""Column functions over text: cleaning, language, token estimates, splitting. All run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

JAPANESE = "\\u3040-\\u309F\\u30A0-\\u30FF\\u4E00-\\u9FFF"
# What counts as a word, a technical word and a named concept.
CANDIDATE = r"[ァ-ヴー]{2,}|[一-龥]{2,}|[A-Za-z]{2,}[A-Za-z0-9]*"
TECHNICAL = r"[ァ-ヴー]{3,}|[A-Z]{2,}[A-Z0-9]*|[一-龥]{4,}"
# A run of capitalised words is taken without a step back, so that one of any length needs no stack. Word ends and spaces are
# those of SQL's \b and \s, which know ASCII only, in every Java.
_WORD = "[0-9A-Za-z_]"
CONCEPT = rf"(?<!{_WORD})[A-Z][a-z]++(?!{_WORD})(?:[\t\n\f\r ]++[A-Z][a-z]++(?!{_WORD}))*+"

# The words that tell an English chunk from a Japanese one.
EN_MARKERS = ("the ", "The ", " is ", " are ", " was ", " were ", " have ", " has ", "and ", "for ")
JA_MARKERS = ("。", "は", "が", "を", "に", "で", "と", "の")


#: What SQL's trim takes away: spaces of all kinds, but no other white space.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def trim(c: Column) -> Column:
    """Without the spaces of any kind at both ends, as SQL's trim."""
    return F.trim(c, F.lit(SPACES))


def strip(c: Column) -> Column:
    """Unicode-aware strip. A run of white space within the text is walked once, not again from each of its places."""
    return F.regexp_replace(c, r"(?U)^\s+|(?<!\s)\s++$", "")


def clean_text(c: Column, literal_quirk: bool = True) -> Column:
    """Null to '', white space to single spaces, stripped.

    ``literal_quirk`` also replaces one odd 15-character literal, as existing pipelines do by accident.
    """
    out = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return F.replace(out, F.lit(", \"'\").replace("), F.lit("'")) if literal_quirk else out


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def count_of(c: Column, chars: str) -> Column:
    """Characters of a class in a text."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{chars}]", ""))


def detect_language(c: Column) -> Column:
    """ja if over 0.3 of the characters that are not white space are kana or han, else en."""
    body = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s", "")
    ratio = F.try_divide(count_of(body, "\\u3040-\\u30FF\\u4E00-\\u9FFF"), F.length(body))
    return F.when(F.coalesce(ratio, F.lit(0.0)) > 0.3, "ja").otherwise("en")


def is_japanese(c: Column, first: int = 100) -> Column:
    return F.coalesce(F.substring(c, 1, first).rlike(f"[{JAPANESE}]"), F.lit(False))


def is_english(c: Column, first: int = 200) -> Column:
    """More of the English marker words than of the Japanese ones in the first characters."""
    head = F.substring(c, 1, first)
    hits = lambda words: reduce(lambda a, b: a + b, [F.contains(head, F.lit(w)).cast("int") for w in words])
    return F.coalesce(hits(EN_MARKERS) > hits(JA_MARKERS), F.lit(False))


def token_estimate(c: Column, least: int = 1) -> Column:
    """Half a token for a character beyond ASCII, a quarter for one within; '' has none."""
    text = F.coalesce(c, F.lit(""))
    wide = F.length(F.regexp_replace(text, r"[\x00-\x7F]+", ""))
    return F.when(text == "", 0).otherwise(F.greatest(F.lit(least), F.floor((F.length(text) + wide) * 0.25))).cast("bigint")


def truncate_tokens(c: Column, tokens: int) -> Column:
    return F.substring(c, 1, 2 * tokens)


def sanitize_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^0-9a-zA-Z_]", "_"))


def kept(parts: Column) -> Column:
    """Stripped, without the blank ones."""
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def paragraphs(c: Column) -> Column:
    return kept(F.split(F.coalesce(c, F.lit("")), r"\n(?U:\s*)\n"))


def sentences(c: Column, ends: str = "。．.!?") -> Column:
    return kept(F.split(F.coalesce(c, F.lit("")), f"(?U)(?<=[{ends}])\\s*"))


def candidates(c: Column, pattern: str = CANDIDATE) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({pattern})"), F.lit(1))


def occurrences(c: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a non-empty part."""
    return ((F.length(c) - F.length(F.replace(c, part, F.lit("")))) / F.greatest(F.length(part), F.lit(1))).cast("bigint")


def windows(c: Column, size: int = 500, stride: int = 400) -> Column:
    """Overlapping character windows that begin every ``stride`` characters."""
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(0), F.length(c) - 1, F.lit(stride)), lambda i: F.substring(c, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def domain_of(name: Column) -> Column:
    """Knowledge domain of a data set's name, by the first rule that fits."""
    return (
        F.when(F.contains(name, F.lit("medical")), "medical").when(F.contains(name, F.lit("legal")), "legal")
        .when(name.rlike("sciq|science"), "science").when(name.rlike("customer|faq"), "customer_support").when(F.contains(name, F.lit("trivia")), "trivia").otherwise("general")
    )
