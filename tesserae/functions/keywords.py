"""Column functions that score and classify keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.text import occurrences

# Function words without content, words of little use in questions, words that matter in the field.
STOPWORDS = (
    "こと", "もの", "これ", "それ", "ため", "よう", "さん", "ます", "です", "ある", "いる", "する", "なる", "できる", "いう", "的", "な",
    "に", "を", "は", "が", "で", "と", "の", "から", "まで", "等", "など", "よる", "おく", "くる",
)
QA_STOPWORDS = (
    "最新", "問題", "実現", "可能", "場合", "結果", "方法", "技術", "今後", "現在", "将来", "重要", "必要", "状況", "対象", "目的", "効果", "影響",
    "これ", "それ", "あれ", "この", "その", "あの",
)
IMPORTANT = (
    "AI", "人工知能", "機械学習", "深層学習", "ディープラーニング", "自然言語処理", "NLP", "トランスフォーマー", "BERT", "GPT", "CNN", "Vision",
    "Transformer", "医療", "診断", "自動運転", "倫理", "バイアス", "課題", "問題", "モデル", "データ",
)
GAP_WORDS = (
    "AI", "人工知能", "機械学習", "深層学習", "ディープラーニング", "医療", "診断", "自動運転", "倫理", "バイアス", "課題", "問題",
    "トランスフォーマー", "CNN", "NLP", "BERT", "GPT",
)
SYNONYMS = (("AI", "人工知能"), ("ML", "機械学習"), ("DL", "深層学習"), ("NLP", "自然言語処理"), ("DX", "デジタルトランスフォーメーション"))
SPECIFIC, CORE, GENERAL = ("BERT", "GPT", "CNN", "RNN", "LSTM"), ("技術", "手法", "方式", "理論", "モデル"), ("データ", "システム", "処理", "分析")
EXPLAINING = ("とは", "である", "という", "により", "ため")
# The forms of technical words.
KATAKANA, ACRONYM, HAN = r"^[ァ-ヴー]{3,}$", r"^[A-Z]{2,}$", r"^[一-龥]{4,}$"


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds any of the words."""
    return c.rlike("|".join(words))


def form_score(w: Column, katakana: float, acronym: float, han: float) -> Column:
    return F.when(w.rlike(KATAKANA), katakana).when(w.rlike(ACRONYM), acronym).when(w.rlike(HAN), han).otherwise(0.0)


def rank_score(w: Column, frequency: Column) -> Column:
    """Frequency up to 3, length up to 8, importance and form."""
    base = F.least(frequency / 3.0, F.lit(1.0)) * 0.3 + F.least(F.length(w) / 8.0, F.lit(1.0)) * 0.3
    return base + F.when(w.isin(*IMPORTANT), 0.5).otherwise(0.0) + form_score(w, 0.2, 0.3, 0.2)


def text_score(w: Column, text: Column) -> Column:
    """Score of a keyword within a text, at most 1."""
    return occurrence_score(w, occurrences(text, w))


def occurrence_score(w: Column, n: Column) -> Column:
    """The same from the number of occurrences, of which three count."""
    base = F.least(n / 3.0, F.lit(1.0)) * 0.3 + F.least(F.length(w) / 8.0, F.lit(1.0)) * 0.2
    return F.least(base + F.when(w.isin(*IMPORTANT), 0.4).otherwise(0.0) + form_score(w, 0.15, 0.2, 0.15), F.lit(1.0))


def fit_for_qa(w: Column) -> Column:
    return ~w.isin(*QA_STOPWORDS, *STOPWORDS) & (F.length(w) >= 2) & ~w.rlike(r"^[0-9]+$") & ~w.startswith("第") & ~w.endswith("等") & ~w.endswith("的")


def difficulty(w: Column, told: Column, n: Column | None = None) -> Column:
    """Of a word that a text explains (told) or not, and holds n times; without n both come from the text, given as ``told``."""
    if n is None:
        text = told
        held = lambda end: F.contains(text, F.concat(w, F.lit(end)))
        told, n = held("とは") | (held("は") & F.contains(text, F.lit("である"))) | held("（"), occurrences(text, w)
    # fixed values: the form of an acronym, and the limits of length and number
    acronym = w.rlike(r"^[A-Z]{2,}[A-Z0-9]*$")
    return F.when(told & (n >= 3), "basic").when(acronym & ~told, "advanced").when((F.length(w) >= 8) | (n == 1), "advanced").when(n >= 5, "basic").otherwise("intermediate")


def category(w: Column) -> Column:
    return (
        # fixed value: the forms of a technical term
        F.when(w.isin(*SPECIFIC), "specific_name").when(w.rlike(r"^[A-Z]{2,}[A-Z0-9]*$|^[ァ-ヴー]{4,}$"), "technical_term")
        .when(any_of(w, CORE), "core_concept").when(any_of(w, GENERAL), "general_term").otherwise("other")
    )


def importance(s: Column, word: Column) -> Column:
    """Of a sentence for a word: place .2, company .3, explanation .3, length .2; at most 1."""
    size = F.length(s)
    at = F.when(F.contains(s, word), F.position(word, s) - 1).otherwise(size)
    place = F.when(size > 0, 1.0 - at / F.greatest(size, F.lit(1))).otherwise(0.0)
    others = F.size(F.regexp_extract_all(s, F.lit(r"([ァ-ヴー]{3,}|[A-Z]{2,}|[一-龥]{4,})"), F.lit(1)))
    told = sum((F.contains(s, F.lit(p)).cast("int") for p in EXPLAINING), F.lit(0)) / len(EXPLAINING)
    length = F.greatest(F.lit(0.0), 1.0 - F.abs(size - 50) / 50)
    return F.least(place * 0.2 + F.least(others / 5.0, F.lit(1.0)) * 0.3 + told * 0.3 + length * 0.2, F.lit(1.0))


def gap_priority(text: Column) -> Column:
    """How urgent an uncovered chunk is, 0 to 100: length, density of terms, digits, symbols, important words."""
    terms = F.size(F.regexp_extract_all(text, F.lit(r"([ァ-ヴー]+|[A-Z][a-z]*|[一-龥]{3,})"), F.lit(1)))
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    named = sum((F.contains(text, F.lit(w)).cast("int") for w in GAP_WORDS), F.lit(0))
    raw = F.least(F.length(text) / 200.0, F.lit(1.0)) * 0.3 + F.least(terms / F.greatest(words, F.lit(1)) * 10, F.lit(1.0)) * 0.4
    raw = raw + F.when(text.rlike("[0-9]"), 0.15).otherwise(0.0) + F.when(text.rlike("[％%＄$€¥]"), 0.15).otherwise(0.0)
    return F.least((raw + F.least(named / 3.0, F.lit(1.0)) * 0.3) * 100, F.lit(100.0))


def covered_chars(text: Column, words: Column) -> Column:
    """How many characters of a text lie in an occurrence of any of the words (occurrences may overlap, also their own).

    One pass of one pattern puts before each place the longest word that begins there, between two NULs; a fold over
    the parts then carries how many of the coming characters are still covered.
    """
    quoted = lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    by_length = F.reverse(F.array_sort(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))))
    pattern = F.concat(F.lit("(?=("), F.array_join(F.transform(by_length, lambda x: quoted(x["w"])), "|"), F.lit("))"))
    marked = F.regexp_replace(F.translate(text, "\0", "\1"), pattern, F.lit("\0$1\0"))
    steps = F.transform(F.split(marked, "\0"), lambda p, i: F.when(i % 2 == 1, -F.length(p)).otherwise(F.length(p)))  # a word's length below zero
    start = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("left"))
    step = lambda a, n: F.struct(
        F.when(n > 0, a["covered"] + F.least(a["left"], n)).otherwise(a["covered"]).alias("covered"),
        F.when(n < 0, F.greatest(a["left"], -n)).otherwise(F.greatest(F.lit(0), a["left"] - n)).alias("left"),
    )
    found = F.aggregate(steps, start, step, lambda a: a["covered"])
    return F.when(F.size(by_length) > 0, found).otherwise(0).cast("bigint")


def coverage_level(rate: Column) -> Column:
    return F.when(rate >= 0.8, "excellent").when(rate >= 0.6, "good").when(rate >= 0.4, "fair").otherwise("poor")


def best_count(text: Column) -> Column:
    """How many keywords suit a text, by its length, technical density and sentences."""
    n = F.length(text)
    terms = F.size(F.regexp_extract_all(text, F.lit(r"([ァ-ヴー]{3,}|[A-Z]{2,}|[一-龥]{4,})"), F.lit(1)))
    dense = F.when(terms / F.greatest(n / 100.0, F.lit(1.0)) > 2, 2).otherwise(0)
    many = F.when(F.size(F.split(text, "[。！？.!?]+")) > 10, 2).otherwise(0)
    grown = F.least(F.lit(30), 20 + F.floor(F.log2(F.greatest(n, F.lit(1)) / 2000.0)))
    return F.when(n < 100, 3).when(n < 300, 5).when(n < 500, 7 + dense).when(n < 1000, 10 + many).when(n < 2000, 15).otherwise(grown).cast("bigint")

