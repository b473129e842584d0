"""Kinds of requests to a writer, each with the form of its reply: one table of kinds, one way to ask and to read.

A text's requests of a kind are made as columns, asked through the ledger of ``generation`` and read by the kind's
schema, so that a new kind is a row of KINDS. Replies may stand in a fence; what does not parse gives no pair.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import token_estimate
from tesserae.operators.generation import Ledger
from tesserae.operators.ordering import numbered_rows
from tesserae.providers import Writer
from tesserae.staging import staged

FIELDS = ("question", "answer", "question_type", "difficulty", "source_span", "reasoning", "confidence")


@dataclass(frozen=True)
class Kind:
    """What is asked (a request for each of ``topics``), how much of the text is shown, and what a reply's pairs hold."""

    ask: str
    longest: int | None
    pair: str
    topics: tuple[str | None, ...] = (None,)


# The six sorts of questions of a diverse request, and how many characters each kind shows.
SORTS = {
    "factual": "questions about facts (who, what, when, where)", "causal": "questions about causes (why, how)", "comparative": "questions that compare (differences, likenesses)",
    "inferential": "questions that need an inference", "summary": "questions for a summary", "application": "questions about uses",
}
KINDS = {
    "basic": Kind("Write {n} question and answer pairs about the text, specific, answered by the text, of various kinds, as JSON with qa_pairs of question, answer, question_type, difficulty (easy, medium or hard), source_span.", 3000, "question string, answer string, question_type string, difficulty string, source_span string"),
    "diverse": Kind("Write 2 {topic} about the text with their answers, as JSON with qa_pairs of question, answer.", 2000, "question string, answer string", tuple(SORTS)),
    "reasoned": Kind("Find the text's topics and concepts, what matters about each, questions for it and their answers in the text, and check them. Reply as JSON with analysis (main_topics, key_concepts, information_density) and qa_pairs of question, answer, reasoning, confidence.", None, "question string, answer string, reasoning string, confidence double"),
}
# What a batch request asks for by the documents' type.
DOCUMENT_TYPES = {"news": "Ask who, what, when, where, why and how.", "technical": "Ask how things are done.", "academic": "Ask why, and what if.", "auto": "Ask questions of various kinds."}


def bare(reply: Column) -> Column:
    """A reply without the fence around it."""
    return F.regexp_replace(F.trim(reply), r"^```[a-z]*\s*|\s*```$", "")


def asked(docs: DataFrame, kind: str, writer: Writer, ledger: Ledger, n: int = 5, id_col: str = "doc_id", text_col: str = "text", tries: int = 3, wait: float = 1.0) -> DataFrame:
    """id, kind, topic, ordinal and FIELDS (null where a kind has none) of the pairs of every text.

    The pairs of a diverse request have its sort as question_type, whatever the reply says. Blank texts are not asked.
    """
    k = KINDS[kind]
    text = F.col(text_col) if k.longest is None else F.substring(text_col, 1, k.longest)
    named = F.array(*[F.struct(F.lit(t).cast("string").alias("topic"), F.lit(k.ask.format(n=n, topic=SORTS.get(t, ""))).alias("ask")) for t in k.topics])
    rows = docs.filter(F.trim(text_col) != "").select(F.col(id_col), text.alias("shown"), F.explode(named).alias("r"))
    requests = staged(rows.select(id_col, "r.topic", F.concat("r.ask", F.lit("\n\n"), "shown").alias("prompt")), "kind-requests")
    ledger.ask(requests, writer, tries=tries, wait=wait)
    pairs = F.from_json(bare(F.col("reply")), f"struct<qa_pairs:array<struct<{k.pair.replace(' string', ':string').replace(' double', ':double')}>>>")["qa_pairs"]
    told = ledger.answered(requests).select(id_col, "topic", F.posexplode(pairs).alias("ordinal", "p")).filter((F.coalesce("p.question", F.lit("")) != "") & (F.coalesce("p.answer", F.lit("")) != ""))
    has = {f.split()[0] for f in k.pair.split(", ")}
    field = lambda c: (F.col(f"p.{c}") if c in has else F.lit(None).cast("double" if c == "confidence" else "string")).alias(c)
    out = told.select(id_col, F.lit(kind).alias("kind"), "topic", F.col("ordinal").cast("bigint").alias("ordinal"), *[field(c) for c in FIELDS])
    return out.withColumn("question_type", F.coalesce("topic", "question_type"))


def enhanced(docs: DataFrame, fallback: DataFrame, writer: Writer, ledger: Ledger, size: int = 10, doc_type: str = "auto", tries: int = 3, wait: float = 1.0) -> DataFrame:
    """doc_id, ordinal, question, answer, tokens_used, source: pairs of several documents from one request.

    docs: doc_id, text, words (array of what to ask about). fallback: doc_id, ordinal, question, answer, which a document
    gets (source "rules") for which the reply has no result, as all of a batch do whose reply does not parse. A
    result belongs to the document at its place. The tokens of a request and its reply are divided over its results.
    """
    placed = numbered_rows(docs.select("doc_id", "text", "words"), ["doc_id"], "place", None)
    placed = staged(placed.withColumn("batch", F.floor(F.col("place") / size)).withColumn("at", (F.col("place") % size).cast("int")), "document-batches")
    shown = F.struct(F.col("at").alias("document_id"), F.substring(F.coalesce("text", F.lit("")), 1, 1000).alias("text"), F.slice(F.coalesce("words", F.array().cast("array<string>")), 1, 5).alias("keywords"))
    head = f". {DOCUMENT_TYPES.get(doc_type, DOCUMENT_TYPES['auto'])} Keep to the facts. Reply as JSON with results, one for each document in order, of document_id and qa_pairs of question, answer (3 to 5 pairs each).\n\n"
    gathered = placed.groupBy("batch").agg(F.count("*").alias("n"), F.to_json(F.array_sort(F.collect_list(shown))).alias("documents"))  # ``size`` documents
    requests = staged(gathered.select("batch", F.concat(F.lit("Write question and answer pairs for these "), F.col("n").cast("string"), F.lit(" documents"), F.lit(head), "documents").alias("prompt")), "document-requests")
    ledger.ask(requests, writer, tries=tries, wait=wait)
    results = F.from_json(bare(F.col("reply")), "struct<results:array<struct<qa_pairs:array<struct<question:string,answer:string>>>>>")["results"]
    told = ledger.answered(requests).select("batch", results.alias("results"), (token_estimate(F.col("prompt")) + token_estimate(F.col("reply"))).alias("tokens"))
    each = told.filter(F.size("results") > 0).select("batch", F.floor(F.col("tokens") / F.size("results")).cast("bigint").alias("tokens_used"), F.posexplode("results").alias("at", "r"))
    met = staged(placed.select("doc_id", "place", "batch", "at").join(each, ["batch", "at"], "left"), "document-results")
    pair = met.filter("r IS NOT NULL").select("doc_id", F.posexplode("r.qa_pairs").alias("ordinal", "p"), "tokens_used")
    written = pair.filter((F.coalesce("p.question", F.lit("")) != "") & (F.coalesce("p.answer", F.lit("")) != "")).select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), "p.question", "p.answer", "tokens_used", F.lit("written").alias("source"))
    left_out = met.filter("r IS NULL").select("doc_id").distinct()
    filled = fallback.join(left_out, "doc_id", "left_semi").select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), "question", "answer", F.lit(0).cast("bigint").alias("tokens_used"), F.lit("rules").alias("source"))
    return written.unionByName(filled)
