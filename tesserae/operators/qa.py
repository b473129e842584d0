"""Question-and-answer generation by rules and templates, quotas, quality, duplicates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.counting import frequent_words
from tesserae.functions.text import CONCEPT, TECHNICAL, candidates, is_english, kept, token_estimate, trim
from tesserae.session import small_batches

QA = "array<struct<question:string,answer:string,type:string>>"


def _qa(question: Column, answer: Column, kind: str) -> Column:
    return F.struct(question.alias("question"), answer.alias("answer"), F.lit(kind).alias("type"))


def _concept(c: Column) -> Column:
    return F.regexp_extract(c, CONCEPT, 0)


def _named(concept: Column, named: str, plain: Column) -> Column:
    """``named`` with the concept put in, or the plain question where there is none."""
    return F.when(concept != "", F.concat(*[F.lit(p) if p else F.lit("") for p in named.split("{}")[:1]], concept, F.lit(named.split("{}")[1]))).otherwise(plain)


def _leading(text: Column, ends: str, n: int) -> Column:
    """The first n sentences of over 20 characters. The whole text is cut only where its first pieces do not hold as many."""
    long = lambda parts: F.filter(kept(parts), lambda x: F.length(x) > 20)
    few = long(F.slice(F.split(text, ends, 4 * n + 1), 1, 4 * n))
    return F.slice(F.when(F.size(few) >= n, few).otherwise(long(F.split(text, ends))), 1, n)


# The question strings of the two functions below are fixed values.


def rule_qa(chunks: DataFrame, per_chunk: int = 4, chunk_col: str = "chunk") -> DataFrame:
    """Adds question, answer, type, qa_idx to English chunks: up to per_chunk rule-made pairs of each, in a fixed order.

    All in built-in array functions: one over the whole chunk, then per sentence a factual, a contextual (from the
    second sentence on) and a keyword pair, then one on the theme. Chunks without a sentence over 20 characters give none.
    """
    text = F.col(chunk_col)
    s = _leading(text, r"\. ", max(1, per_chunk - 1) + 1)  # one more, which the last answer goes on with

    def of_sentence(x: Column, i: Column) -> Column:
        before, after = F.get("parts", i - 1), F.get("parts", i + 1)
        c50, c30, p30, cx = _concept(F.substring(x, 1, 50)), _concept(F.substring(x, 1, 30)), _concept(F.substring(before, 1, 30)), _concept(x)
        fact = _qa(_named(c50, "What specific information is provided about {}?", F.concat(F.lit("What information is provided in the following context: "), F.substring(x, 1, 50), F.lit("?"))), F.concat(x, F.coalesce(F.concat(F.lit(" "), after), F.lit(""))), "factual_detailed")
        linked = F.when((c30 != "") & (p30 != ""), F.concat(F.lit("How does "), c30, F.lit(" relate to "), p30, F.lit("?"))).otherwise(F.concat(F.lit("How does the information '"), F.substring(x, 1, 30), F.lit("...' connect to the previous context?")))
        context = F.when(i > 0, _qa(linked, F.concat(before, F.lit(" "), x), "contextual"))
        keyword = F.when(cx != "", _qa(F.concat(F.lit("What is mentioned about "), cx, F.lit("?")), x, "keyword_based"))
        return F.filter(F.array(fact, context, keyword), lambda q: q.isNotNull())

    whole = F.when(F.length(text) > 50, F.array(_qa(F.lit("What information is discussed in this section?"), F.substring(text, 1, 500), "comprehensive"))).otherwise(F.array().cast(QA))
    theme_concept = _concept(F.substring(F.get("parts", F.lit(0)), 1, 50))
    theme = F.when(F.length(text) > 100, F.array(_qa(_named(theme_concept, "What is the main theme related to {}?", F.lit("What is the main theme discussed in this content?")), F.substring(text, 1, 400), "thematic"))).otherwise(F.array().cast(QA))
    rows = chunks.withColumn("parts", s).filter(F.size("parts") > 0)
    each = F.flatten(F.transform(F.slice("parts", 1, max(1, per_chunk - 1)), of_sentence))
    rows = rows.withColumn("qa", F.slice(F.concat(whole, each, theme), 1, per_chunk))
    return rows.select("*", F.posexplode("qa").alias("qa_idx", "pair")).select(*chunks.columns, "qa_idx", "pair.*")


def most_frequent(words: Column, k: int) -> Column:
    """The k words that an array holds most often, of equals the one that comes first.

    The words are sorted once with their places; runs of equal ones are told by their heads.
    """
    once = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)  # noqa: E731  the argument is evaluated once

    def ranked(s: Column, heads: Column) -> Column:
        runs = F.transform(heads, lambda h, j: F.struct((h - F.coalesce(F.get(heads, j + 1), F.size(s))).alias("less"), F.get(s, h)["at"].alias("at"), F.get(s, h)["word"].alias("word")))
        return F.transform(F.slice(F.array_sort(runs), 1, k), lambda r: r["word"])

    def counted(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i - 1)["word"] != F.get(s, i)["word"]))
        return once(heads, lambda h: ranked(s, h))

    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))))
    return F.when(F.size(words) > 0, once(placed, counted)).otherwise(F.array().cast("array<string>"))


def rule_qa_ja(chunks: DataFrame, per_chunk: int = 4, chunk_col: str = "chunk") -> DataFrame:
    """The Japanese rules: per sentence one factual pair and one for each of its two most frequent keywords."""
    text = F.col(chunk_col)
    small_batches(chunks.sparkSession)
    s = _leading(text, "。", max(1, per_chunk - 1) + 1)

    def of_sentence(x: Column, i: Column) -> Column:
        after = F.get("parts", i + 1)
        fact = _qa(F.concat(F.lit("「"), F.substring(x, 1, 30), F.lit("」について詳しく説明してください。")), F.concat(x, F.coalesce(F.concat(F.lit("。"), after), F.lit(""))), "factual_detailed")
        return F.concat(F.array(fact), F.transform(F.get("best", i + 1), lambda w: _qa(F.concat(F.lit("「"), w, F.lit("」について何が述べられていますか？")), x, "keyword_based")))

    whole = F.when(F.length(text) > 50, F.array(_qa(F.lit("このセクションにはどのような情報が含まれていますか？"), F.substring(text, 1, 500), "comprehensive"))).otherwise(F.array().cast(QA))
    top = F.get(F.get("best", F.lit(0)), F.lit(0))
    about = F.when(top.isNotNull(), F.concat(F.lit("「"), top, F.lit("」に関する主要テーマは何ですか？"))).otherwise("この内容の主要テーマは何ですか？")
    theme = F.when(F.length(text) > 100, F.array(_qa(about, F.substring(text, 1, 400), "thematic"))).otherwise(F.array().cast(QA))
    rows = chunks.withColumn("parts", s).filter(F.size("parts") > 0)
    # the most frequent words of the text's beginning, then of each sentence
    rows = rows.withColumn("best", frequent_words(F.concat(F.array(F.substring(text, 1, 200)), F.slice("parts", 1, max(1, per_chunk - 1))), 2))
    rows = rows.withColumn("qa", F.slice(F.concat(whole, F.flatten(F.transform(F.slice("parts", 1, max(1, per_chunk - 1)), of_sentence)), theme), 1, per_chunk))
    return rows.select("*", F.posexplode("qa").alias("qa_idx", "pair")).select(*chunks.columns, "qa_idx", "pair.*")


def rule_qa_both(chunks: DataFrame, per_chunk: int = 4, chunk_col: str = "chunk") -> DataFrame:
    """The English rules for chunks with more English than Japanese marker words, the Japanese rules for all others."""
    english = is_english(F.col(chunk_col))
    return rule_qa(chunks.filter(english), per_chunk, chunk_col).unionByName(rule_qa_ja(chunks.filter(~english), per_chunk, chunk_col))


def strided(chunks: DataFrame, idx: str, most: int) -> DataFrame:
    """Every n-th chunk, so that at most about ``most`` are left. ``idx`` counts the chunks from 0."""
    total = chunks.count()
    return chunks if total <= most else chunks.filter((F.col(idx) % (total // most) == 0) & (F.col(idx) < (total // most) * most))


def first_of_prefix(qa: DataFrame, order: list[str], length: int = 30) -> DataFrame:
    """The first pair of each question beginning. A beginning shared by very many pairs is reduced map-side."""
    keyed = qa.select(F.substring("question", 1, length).alias("prefix"), F.struct(*order).alias("place"), F.struct(*[F.col(f"`{c}`") for c in qa.columns]).alias("pair"))
    return keyed.groupBy("prefix").agg(F.min_by("pair", "place").alias("pair")).select("pair.*")


def chunk_quota(tokens: Column, place: Column, base: int = 5) -> Column:
    """Pairs to ask of a chunk: more for longer ones and for those late in a document, 8 at most."""
    n = F.when(tokens < 50, 2).when(tokens < 100, 3).when(tokens < 200, base + 1).when(tokens < 300, base + 2).otherwise(base + 3)
    return F.least(n + F.when(place >= 5, 1).otherwise(0), F.lit(8)).cast("bigint")


def redistribute(chunks: DataFrame, made: DataFrame, batch: str = "batch") -> DataFrame:
    """chunks: batch, place, quota. made: batch, ordinal (from 0). Each made pair goes to the chunk whose running quota holds its ordinal."""
    end = F.sum("quota").over(Window.partitionBy(batch).orderBy("place"))
    ranges = chunks.withColumn("until", end).withColumn("since", F.col("until") - F.col("quota"))
    return made.join(ranges, batch).filter((F.col("ordinal") >= F.col("since")) & (F.col("ordinal") < F.col("until"))).drop("since", "until")


def document_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and what the number of pairs is planned from: lengths, sentences, terms, density, complexity."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    s, terms = kept(F.split(t, "[。！？.!?]+")), candidates(t, TECHNICAL)
    rows = docs.select(id_col, t.alias("t"), s.alias("s"), terms.alias("terms")).withColumns({
        "doc_length": F.length("t").cast("bigint"), "token_count": token_estimate(F.col("t")), "sentence_count": F.size("s").cast("bigint"), "keyword_count": F.size(F.array_distinct("terms")).cast("bigint"),
        "keyword_density": F.size("terms") / F.greatest(F.lit(1.0), F.length("t") / 100.0), "n": F.size("s"),
        "sum1": F.aggregate("s", F.lit(0.0), lambda a, x: a + F.length(x)), "sum2": F.aggregate("s", F.lit(0.0), lambda a, x: a + F.length(x).cast("double") * F.length(x)),
        "marks": F.size(F.regexp_extract_all("t", F.lit(r"([、；：「」『』（）\[\]])"), F.lit(1))),
    })
    mean = F.try_divide(F.col("sum1"), F.col("n"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("sum2"), F.col("n")) - mean * mean))
    shape = F.when(F.col("n") > 1, F.least(F.lit(1.0), F.coalesce(F.try_divide(spread, mean), F.lit(0.0))) * 0.3).otherwise(0.0)
    score = shape + F.least(F.lit(1.0), F.col("keyword_density") / 5) * 0.4 + F.least(F.lit(1.0), F.col("marks") / F.greatest(F.lit(1), F.col("n"))) * 0.3
    return rows.select(id_col, "doc_length", "token_count", "sentence_count", "keyword_count", F.round("keyword_density", 9).alias("keyword_density"), F.round(F.least(F.lit(1.0), score), 9).alias("complexity"))


def planned_count(m: DataFrame, mode: str = "auto") -> DataFrame:
    """Adds base_count, adjusted_count, optimal_count to document metrics."""
    n = F.col("doc_length")
    ladder = F.when(n < 500, 3).when(n < 1000, 5).when(n < 2000, 8).when(n < 5000, 12).when(n < 10000, 18).otherwise(F.least(F.lit(30), 18 + F.floor(F.log2(F.greatest(n, F.lit(1)) / 10000.0) * 3)))
    base = {
        "evaluation": F.floor(F.col("sentence_count") * 0.075), "learning": F.least(F.lit(20), F.greatest(F.lit(10), F.floor(F.col("keyword_count") / 2))),
        "search_test": F.least(F.lit(30), F.greatest(F.lit(20), F.floor(F.col("sentence_count") / 3))), "faq": F.least(F.lit(15), F.greatest(F.lit(5), F.floor(F.col("keyword_count") / 3))),
    }.get(mode, ladder)
    d, c = F.col("keyword_density"), F.col("complexity")
    factor = F.when((d > 4) & (c > 0.7), 1.5).when((d > 2.5) | (c > 0.5), 1.2).when((d < 1) & (c < 0.3), 0.7).otherwise(1.0)
    out = m.withColumn("base_count", base.cast("bigint")).withColumn("adjusted_count", F.greatest(F.lit(3), F.floor(F.col("base_count") * factor)).cast("bigint"))
    needed = F.floor(F.floor(F.col("token_count") / 150) * 0.7 / 2.5)
    return out.withColumn("optimal_count", F.greatest(F.lit(3), F.least(F.lit(50), F.floor((F.col("adjusted_count") + needed) / 2))).cast("bigint"))


def missing_count(length: Column, existing: Column) -> Column:
    """Further pairs that would lift the estimated coverage to 0.7."""
    now = F.least(F.lit(1.0), existing * 2.5 / F.greatest(F.lit(1), F.floor(length / 200)))
    return F.floor(F.greatest(F.lit(0.0), 0.7 - now) * length / 500).cast("bigint")


def hybrid_count(text: Column, n_chunks: Column, quality: bool = False) -> Column:
    unique = F.size(F.array_distinct(candidates(text, r"[ァ-ヴー]{3,}|[A-Z]{2,}|[一-龥]{4,}")))
    density = F.coalesce(F.try_divide(unique.cast("double"), F.length(text) / 1000.0), F.lit(0.0))
    base = F.when(density > 10, 8).when(density > 5, 6).otherwise(4)
    base = F.floor(base * 1.5) if quality else base
    return F.least(F.floor(base + n_chunks * 0.5), F.lit(15)).cast("bigint")


# Two questions for each difficulty and category (categories not named take the difficulty's plain pair),
# and the length asked for.
TEMPLATES = (
    ("basic", None, "とは何ですか？", "について説明してください。"), ("intermediate", "core_concept", "の仕組みを説明してください。", "の特徴は何ですか？"),
    ("intermediate", None, "はどのように使われますか？", "の利点は何ですか？"), ("advanced", "technical_term", "の技術的な詳細を説明してください。", "と他の手法との違いは何ですか？"),
    ("advanced", None, "の応用例を挙げてください。", "の課題と解決策は何ですか？"),
)
LENGTHS = {"basic": "1-2文", "intermediate": "2-3文", "advanced": "3-5文"}


def template_questions(details: DataFrame) -> DataFrame:
    """details: word, difficulty, category, best_context. Adds two questions, the hint and the suggested length."""
    fits = [((F.col("difficulty") == d) & ((F.col("category") == c) if c else F.lit(True)), a, b) for d, c, a, b in TEMPLATES]
    ask = lambda k: F.concat("word", F.coalesce(*[F.when(f[0], F.lit(f[k])) for f in fits]))
    length = F.coalesce(*[F.when(F.col("difficulty") == k, F.lit(v)) for k, v in LENGTHS.items()])
    return details.withColumns({"question_1": ask(1), "question_2": ask(2), "answer_hint": F.col("best_context"), "suggested_length": length})


def template_pairs(asked: DataFrame, relations: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pairs from template questions; the answer names the other ends of a keyword's first two relations, in their order.

    relations: id, source, target, place. Two relations with the same keyword name it twice.
    """
    end = lambda own, other: relations.select(id_col, F.col(own).alias("word"), F.struct("place", "relation_type", F.col(other).alias("other")).alias("r"))
    near = end("source", "target").unionAll(end("target", "source")).groupBy(id_col, "word").agg(F.slice(F.array_sort(F.collect_list("r")), 1, 2).alias("r"))
    near = near.select(id_col, "word", F.transform("r", lambda r: r["other"]).alias("related"))
    rows = asked.join(near, [id_col, "word"], "left").withColumn("related", F.coalesce("related", F.array().cast("array<string>")))
    more = F.when(F.col("difficulty") != "basic", F.concat(F.lit("関連する概念として、"), F.array_join("related", "、"), F.lit("があります。"))).otherwise("")
    answer = F.when((F.size("related") > 0) & (F.col("answer_hint") != ""), F.concat("answer_hint", F.lit(" "), more)).otherwise(F.when(F.col("answer_hint") != "", F.col("answer_hint")).otherwise(F.concat("word", F.lit("に関する説明"))))
    return rows.withColumn("answer", answer).select(id_col, "word", F.explode(F.array("question_1", "question_2")).alias("question"), "answer", "difficulty", "category", F.concat(F.array("word"), F.col("related")).alias("keywords"), "suggested_length")


def hint_pairs(asked: DataFrame, k: int = 5, id_col: str = "doc_id") -> DataFrame:
    """The first question of each document's k best keywords, the hint cut by difficulty."""
    cut = F.when(F.col("difficulty") == "basic", 100).when(F.col("difficulty") == "intermediate", 150).otherwise(200)
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("context_importance"), "word"))
    return asked.withColumn("place", place).filter(F.col("place") <= k).select(id_col, "word", F.col("question_1").alias("question"), F.substring(F.col("answer_hint"), F.lit(1), cut).alias("answer"))


# How Japanese texts define or list things (pattern, what may open the second part, what may end it).
DEFINED = (r"([^。]+)とは([^。]+)(?:である|です)", ("とは",), ("である", "です"))
CALLED = (r"([^。]+)は([^。]+)と呼ばれ", ("は",), ("と呼ばれ",))
LISTED = (r"([^。]+)(?:には|に|では)、([^。]+(?:、[^。]+)+)が(?:ある|あります|含まれ|存在)", ("に、", "には、", "では、"), ("がある", "があります", "が含まれ", "が存在"))


def _matches(text: Column, pattern: str, opens: tuple[str, ...], ends: tuple[str, ...], inside: str = "") -> Column:
    """array<struct<a, b>>: the two groups of all matches, which lie within sentences.

    A sentence is cut after the last ending; one that cannot match by the order of its parts is left out before the
    pattern runs, so that no sentence is tried from each of its characters.
    """
    tail = lambda s: F.least(*[F.length(F.substring_index(s, e, -1)) for e in ends]) if len(ends) > 1 else F.length(F.substring_index(s, ends[0], -1))
    heads = F.transform(F.split(text, "。"), lambda s: F.substring(s, F.lit(1), F.length(s) - tail(s)))

    def fits(s: Column) -> Column:
        at = [F.when((p := F.position(F.lit(o), s, F.lit(2))) > 0, p + len(o)) for o in opens]
        begin = F.least(*at) if len(at) > 1 else at[0]  # of what follows the first opening
        stop = F.greatest(*[F.when(s.endswith(e), F.length(s) - len(e)).otherwise(-1) for e in ends], F.lit(-1))  # the last place before the ending
        if not inside:
            return begin <= stop
        mark = F.position(F.lit(inside), s, begin + 1)
        return (mark > 0) & (mark < stop)

    zipped = lambda s: F.arrays_zip(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(s, F.lit(pattern), F.lit(2)).alias("b"))
    return F.flatten(F.transform(F.filter(heads, lambda s: F.coalesce(fits(s), F.lit(False))), zipped))


def definitions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs from the two definition patterns of Japanese texts."""
    out = []
    for known, ask, tell, kind, sure in ((DEFINED, "{a}とは何ですか？", "{a}とは{b}です。", "definition", 0.9), (CALLED, "{a}は何と呼ばれますか？", "{b}と呼ばれます。", "terminology", 0.85)):
        rows = docs.select(id_col, F.inline(_matches(F.col(text_col), *known))).select(id_col, trim(F.col("a")).alias("a"), trim(F.col("b")).alias("b"))
        # what a text holds is never read as a place to fill
        put = lambda s: F.concat(*[F.col(p[1]) if p in ("{a}", "{b}") else F.lit(p) for p in re.split(r"(\{[ab]\})", s) if p])
        out.append(rows.select(id_col, put(ask).alias("question"), put(tell).alias("answer"), F.lit(kind).alias("type"), F.lit(sure).alias("confidence")))
    return reduce(DataFrame.unionAll, out)


def enumerations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs from lists of Japanese texts, with their items."""
    rows = docs.select(id_col, F.inline(_matches(F.col(text_col), *LISTED, inside="、"))).select(id_col, trim(F.col("a")).alias("a"), F.transform(F.split("b", "、"), trim).alias("items"))
    return rows.select(id_col, F.concat("a", F.lit("には何がありますか？")).alias("question"), F.concat("a", F.lit("には、"), F.array_join("items", "、"), F.lit("があります。")).alias("answer"), "items")


# What is asked about entities of a type, and of all others.
ENTITY_QUESTIONS = {
    "PERSON": ("は誰ですか？", "は何をしましたか？", "の役割は何ですか？"), "ORG": ("はどのような組織ですか？", "の使命は何ですか？", "は何を提供していますか？"),
    "PRODUCT": ("の特徴は何ですか？", "はどのように使われますか？", "の利点は何ですか？"), "WORK_OF_ART": ("の特徴は何ですか？", "はどのように使われますか？", "の利点は何ですか？"),
}
OTHER_QUESTIONS = ("とは何ですか？", "の重要性は何ですか？", "の例を挙げてください。")


def entity_pairs(entities: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """entities: id, entity, entity_type. Three questions each; the answer is the first sentence that holds the entity."""
    ask = F.coalesce(*[F.when(F.col("entity_type") == k, F.array(*map(F.lit, v))) for k, v in ENTITY_QUESTIONS.items()], F.array(*map(F.lit, OTHER_QUESTIONS)))
    rows = entities.join(docs.select(id_col, kept(F.split(text_col, "[。！？.!?]")).alias("parts")), id_col)
    answer = F.get(F.filter("parts", lambda s: F.contains(s, F.col("entity"))), F.lit(0))
    return rows.withColumn("answer", answer).filter("answer IS NOT NULL").select(id_col, "entity", F.explode(F.transform(ask, lambda q: F.concat(F.col("entity"), q))).alias("question"), "answer", F.lit("entity_based").alias("type"))


def hierarchical(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """English pairs in three layers: the document, its first four long parts, its first six names."""
    t = F.col(text_col)
    parts = F.when(F.contains(t, F.lit("\n\n")), F.split(t, "\n\n")).otherwise(F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(0), F.length(t) - 1, F.lit(400)), lambda i: F.substring(t, i + 1, F.lit(500)))).otherwise(F.array().cast("array<string>")))
    one = F.array(F.struct(F.lit("What is the main content of this document?").alias("question"), F.substring(t, 1, 500).alias("answer"), F.lit("comprehensive").alias("type"), F.lit(1).alias("layer")))
    two = F.transform(F.filter(F.slice(parts, 1, 4), lambda p: F.length(trim(p)) > 50), lambda p: F.struct(F.concat(F.lit("Explain the following: '"), F.substring(p, 1, 30), F.lit("...'")).alias("question"), p.alias("answer"), F.lit("paragraph_detail").alias("type"), F.lit(2).alias("layer")))
    names = F.slice(F.array_distinct(candidates(t, CONCEPT + r"|[A-Z]{2,}")), 1, 6)
    sentence = lambda e: F.get(F.filter(F.split(t, "[。.!?]"), lambda s: F.contains(s, e)), F.lit(0))
    three = F.filter(F.transform(names, lambda e: F.struct(F.concat(F.lit("What is mentioned about "), e, F.lit("?")).alias("question"), sentence(e).alias("answer"), F.lit("entity_specific").alias("type"), F.lit(3).alias("layer"))), lambda q: q["answer"].isNotNull())
    return docs.select(id_col, F.posexplode(F.concat(one, two, three)).alias("qa_idx", "q")).select(id_col, "qa_idx", "q.*")


def targeted(uncovered: DataFrame, id_col: str = "doc_id", k: int = 5) -> DataFrame:
    """One question about the first concept of each document's first k uncovered chunks."""
    place = F.row_number().over(Window.partitionBy(id_col).orderBy("chunk_idx"))
    rows = uncovered.withColumn("place", place).filter(F.col("place") <= k).withColumn("concept", F.get(candidates(F.col("chunk"), CONCEPT), F.lit(0)))
    return rows.filter("concept IS NOT NULL").select(id_col, "chunk_idx", F.concat(F.lit("What does the text say about "), "concept", F.lit("?")).alias("question"), F.col("chunk").alias("answer"))


def adversarial(qa: DataFrame, order: str) -> DataFrame:
    """Negations of the first five pairs and two constants."""
    first = qa.orderBy(order).limit(5).select(F.replace("question", F.lit("何ですか"), F.lit("何ではありませんか")).alias("question"), F.concat("answer", F.lit("ではないものを指します。")).alias("answer"), F.lit("adversarial_negation").alias("type"))
    fixed = [("この文書に書かれていない情報は何ですか？", "文書には含まれていない情報です。", "out_of_context"), ("それは何を指していますか？", "文脈により異なります。", "ambiguous_reference")]
    return first.unionAll(qa.sparkSession.createDataFrame(fixed, first.schema))


def budget_plan(spark, budget: float) -> DataFrame:
    """The five phases of a generation budget."""
    rows = [("phase1", "rule_based", "high_confidence_facts", 0.0, 10), ("phase2", "template_based", "entities_and_concepts", 0.0, 15), ("phase3", "llm_cheap", "gap_filling", 0.3, 20), ("phase4", "llm_quality", "complex_reasoning", 0.5, 10), ("phase5", "human_validation", "quality_assurance", 0.2, None)]
    return spark.createDataFrame(rows, "phase string, method string, target string, part double, expected_qa int").withColumn("cost", F.round(F.col("part") * budget, 6)).drop("part")


# Fixed value: words that make a question.
QUESTION_WORDS = ("何", "なぜ", "どのように", "いつ", "どこ", "だれ", "どちら")


def quality(qa: DataFrame) -> Column:
    """Score of a pair from its question, answer, difficulty, keywords, category and suggested_length columns, at most 1."""
    n = F.length(F.coalesce(qa["answer"], F.lit("")))
    length = F.coalesce(qa["suggested_length"], F.lit(""))
    meets = F.when(F.contains(length, F.lit("1-2文")), n <= 100).when(F.contains(length, F.lit("2-3文")), n.between(50, 150)).when(F.contains(length, F.lit("3-5文")), n.between(100, 250)).otherwise(True)
    asks = F.coalesce(qa["question"].rlike("|".join(QUESTION_WORDS)), F.lit(False))
    score = F.when(asks, 0.2).otherwise(0.0) + F.when(n.between(20, 200), 0.2).when(n.between(10, 300), 0.1).otherwise(0.0)
    score = score + F.when(F.coalesce(qa["difficulty"], F.lit("intermediate")).isin(*LENGTHS), 0.2).otherwise(0.0) + F.least(F.lit(0.2), F.greatest(F.coalesce(F.size(qa["keywords"]), F.lit(0)), F.lit(0)) * 0.1)
    return F.least(F.lit(1.0), score + F.when(F.coalesce(qa["category"], F.lit("")) != "", 0.1).otherwise(0.0) + F.when((length != "") & meets, 0.1).otherwise(0.0))


def similar_questions(qa: DataFrame, id_col: str, least: float = 0.7) -> DataFrame:
    """Pairs (a < b) of equal questions or of word sets with a Jaccard similarity over ``least``.

    Sets can only be that similar if they share one of the first few words of each, rarest first (a prefix filter),
    so candidates come from an equi-join on those words. Equal questions meet as one row with their ids.
    """
    rows = qa.select(F.col(id_col).alias("id"), F.col("question"))
    texts = rows.groupBy("question").agg(F.min("id").alias("rep")).withColumn("set", F.array_distinct(F.filter(F.split("question", r"(?U)\s+"), lambda w: w != "")))
    freq = texts.select(F.explode("set").alias("w")).groupBy("w").agg(F.count("*").alias("f"))
    ranked = texts.select("rep", F.size("set").alias("n"), F.explode("set").alias("w")).join(freq, "w").withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("f", "w")))
    prefix = ranked.filter(F.col("r") <= F.col("n") - F.floor(F.col("n") * least)).select("rep", "w", "n")
    a, b = prefix.select(F.col("rep").alias("ra"), "w", F.col("n").alias("na")), prefix.select(F.col("rep").alias("rb"), "w", F.col("n").alias("nb"))
    met = a.join(b, "w").filter((F.col("ra") < F.col("rb")) & (F.least("na", "nb") > F.greatest("na", "nb") * least)).select("ra", "rb").distinct()
    sets = texts.select("rep", "set")
    full = met.join(sets.withColumnsRenamed({"rep": "ra", "set": "sa"}), "ra").join(sets.withColumnsRenamed({"rep": "rb", "set": "sb"}), "rb")
    score = F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))
    return full.withColumn("jaccard", score).filter(F.col("jaccard") > least).select(F.col("ra").alias("a"), F.col("rb").alias("b"), F.round("jaccard", 6).alias("jaccard"))


# Fixed value: how example questions end.
EXAMPLES = ("とは何ですか？", "の特徴を教えてください", "のメリットは何ですか？")


def example_questions(words: DataFrame, word: str = "word") -> DataFrame:
    """Two example questions of each keyword, by its form."""
    two = F.array(F.struct(F.concat(F.col(word), F.lit(EXAMPLES[0])).alias("question"), F.lit("definition").alias("type")), F.struct(F.concat(F.col(word), F.lit(EXAMPLES[1])).alias("question"), F.lit("feature").alias("type")))
    return words.select(*words.columns, F.explode(two).alias("q")).select(*words.columns, "q.*")


# What an answer made by rules holds, and the coverage thresholds with and without one.
RULE_MARKS = ("文書内で", "文書では", "重要な概念")
RULE_THRESHOLD, WRITTEN_THRESHOLD = 0.4, 0.7


def coverage_threshold(pairs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, threshold: the lower one for documents of which any answer was made by rules."""
    by_rule = F.coalesce(F.max(reduce(Column.__or__, [F.contains("answer", F.lit(m)) for m in RULE_MARKS])), F.lit(False))
    return pairs.groupBy(id_col).agg(F.when(by_rule, RULE_THRESHOLD).otherwise(WRITTEN_THRESHOLD).alias("threshold"))


def validated(pairs: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order_col: str = "ordinal") -> DataFrame:
    """Adds four checks, ``valid`` (all hold) and ``quality_score`` (their share) to pairs: id, order, question, answer.

    answer_found: at least half of the answer's different words stand in the document's text. question_clear: at least
    five characters, and a question mark or a question word. no_contradiction: no earlier pair of the document asks
    the same with another answer. appropriate_length: an answer of 10 to 1000 characters. Nulls count as empty.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[\s.,;:!?。、！？]+"), lambda w: w != ""))
    q, a = F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))
    texts = docs.select(F.col(id_col), words(F.coalesce(F.col(text_col), F.lit(""))).alias("text_words")).dropDuplicates([id_col])
    first = F.first(a).over(Window.partitionBy(id_col, q).orderBy(F.col(order_col), a))
    known = F.size(F.array_intersect(words(a), F.coalesce("text_words", F.array().cast("array<string>"))))
    checks = {
        "answer_found": (F.size(words(a)) > 0) & (known * 2 >= F.size(words(a))),
        "question_clear": (F.length(q) >= 5) & (q.rlike("[?？]") | q.rlike("|".join(QUESTION_WORDS))),
        "no_contradiction": first == a, "appropriate_length": F.length(a).between(10, 1000),
    }
    held = reduce(Column.__add__, [F.col(c).cast("int") for c in checks])
    return pairs.join(texts, id_col, "left").withColumns(checks).drop("text_words").withColumns({"valid": held == len(checks), "quality_score": held / len(checks)})
