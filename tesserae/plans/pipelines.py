"""Whole pipelines: rules, hybrid, registration, evaluation. Each is one lazy plan where it can be."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import keywords as keyword_functions
from tesserae.functions.text import clean_text
from tesserae.operators import chunking, keywords, qa, vectors
from tesserae.operators.ordering import numbered_rows
from tesserae.providers import Embedder, HashedNgrams, Writer, embedded, written
from tesserae.staging import discard, staged

# Chunk size, pairs per chunk and title column of the known data sets.
DATASETS = {"cc_news": (300, 5, "title"), "japanese_text": (200, 2, None), "wikipedia_ja": (250, 3, "title"), "livedoor": (200, 4, "title")}


def chunks_of(docs: DataFrame, limit: int = 200, least: int = 50) -> DataFrame:
    return chunking.chunk_table(docs.withColumn("text", clean_text(F.col("text"))), lambda t: chunking.semantic_chunks(t, limit, least))


def rule_pipeline(docs: DataFrame, per_chunk: int = 4, max_chunks: int = 300, limit: int = 200, further: int = 50) -> DataFrame:
    """Pairs by rules: chunk, sample by stride, generate, keep the first of each question beginning, top up.

    Where chunks were left out and there are fewer pairs than twice all chunks, ``further`` chunks give two pairs more
    each: those whose number follows the number of sampled ones. Chunks are cut and numbered once, and written.
    """
    cut_once = staged(chunks_of(docs, limit), "chunks")
    chunks = staged(numbered_rows(cut_once, ["doc_id", "chunk_idx"], "global_idx"), "numbered-chunks")
    discard(cut_once)
    total = chunks.count()
    step = max(1, total // max_chunks) if total > max_chunks else 1
    n_taken = min(max_chunks, -(-total // step)) if total > max_chunks else total
    taken = chunks.filter((F.col("global_idx") % step == 0) & (F.col("global_idx") < step * n_taken))
    pairs = qa.first_of_prefix(qa.rule_qa_both(taken, per_chunk), ["global_idx", "qa_idx"])
    if n_taken < total:
        pairs = staged(pairs, "rule-pairs")
        if pairs.count() < 2 * total:
            rest = chunks.filter(F.col("global_idx").between(n_taken, n_taken + further - 1))
            pairs = pairs.unionByName(qa.rule_qa_both(rest, 2))
    return pairs.select("doc_id", "chunk_idx", "global_idx", "question", "answer", "type")


def covered(chunks: DataFrame, pairs: DataFrame, embedder: Embedder | None = None, clamp: bool = True) -> DataFrame:
    """id (chunk), other (pair), max_sim: chunks against pairs whose answers count twice in the embedded text."""
    e = embedder or HashedNgrams()
    key = F.xxhash64("doc_id", "chunk_idx").alias("vec_id")
    c = embedded(chunks.select(key, "chunk"), e, "vec_id", "chunk")
    p = pairs.select(F.xxhash64("question", "answer").alias("vec_id"), F.concat_ws(" ", "question", "answer", "answer").alias("t")).dropDuplicates(["vec_id"])
    return vectors.best_match(c, embedded(p, e, "vec_id", "t"), clamp)


def _unknown(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys, nulls included, are not among the known ones."""
    b = known.select(*[F.col(k).alias(f"known_{k}") for k in keys])
    return rows.join(b, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"known_{k}")) for k in keys]), "left_anti")


def lifted(best: DataFrame | None, chunk_vectors: DataFrame, new_pairs: DataFrame, embedder: Embedder) -> DataFrame:
    """id, max_sim (a written table): each chunk's best similarity, lifted by the new pairs, the only ones that are embedded and matched."""
    p = new_pairs.select(F.xxhash64("question", "answer").alias("vec_id"), F.concat_ws(" ", "question", "answer", "answer").alias("t")).dropDuplicates(["vec_id"])
    new_vectors = staged(embedded(p, embedder, "vec_id", "t"), "pair-vectors")
    now = vectors.best_match(chunk_vectors, new_vectors, True).select("id", F.col("max_sim").alias("new_sim"))
    old = chunk_vectors.select(F.col("vec_id").alias("id"), F.lit(0.0).alias("max_sim")) if best is None else best
    out = staged(old.join(now, "id", "left").select("id", F.greatest("max_sim", F.coalesce("new_sim", F.lit(0.0))).alias("max_sim")), "best")
    discard(new_vectors)
    return out


def feedback_state(docs: DataFrame, embedder: Embedder | None = None, threshold: float = 0.7, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Pairs by layers, then at most ``rounds`` times further ones for chunks not yet covered; and each chunk's best similarity.

    Chunks and their vectors are written once. The state of a round is two written tables, pairs and best similarities;
    a round embeds and matches the pairs that are new in it and no others.
    """
    e = embedder or HashedNgrams()
    chunks = staged(chunks_of(docs).withColumn("id", F.xxhash64("doc_id", "chunk_idx")), "chunks")
    chunk_vectors = staged(embedded(chunks.withColumnRenamed("id", "vec_id"), e, "vec_id", "chunk"), "chunk-vectors")
    pairs = staged(qa.hierarchical(docs).select("doc_id", "question", "answer"), "pairs")
    best = lifted(None, chunk_vectors, pairs, e)
    for _ in range(rounds):
        gaps = vectors.uncovered(best, threshold).select("id")
        more = qa.targeted(chunks.join(gaps, "id", "left_semi")).select("doc_id", "question", "answer").distinct()
        new = staged(_unknown(more, pairs, more.columns), "pairs")
        if new.isEmpty():
            break
        lift = lifted(best, chunk_vectors, _unknown(new, pairs, ["question", "answer"]), e)
        discard(best)
        pairs, best = pairs.unionByName(new), lift
    return pairs, best


def feedback(docs: DataFrame, embedder: Embedder | None = None, threshold: float = 0.7, rounds: int = 3) -> DataFrame:
    """The pairs of ``feedback_state``."""
    return feedback_state(docs, embedder, threshold, rounds)[0]


#: Shares of keywords of each difficulty that pairs are made for.
DIFFICULTIES = {"basic": 0.3, "intermediate": 0.5, "advanced": 0.2}


def qa_extraction(docs: DataFrame, mode: str = "auto", n_pairs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What pairs are made from: keywords with their template questions, and the relations of all candidates.

    A document's candidates are its best words by score, as many as suit the text but at least as many as pairs are
    planned and at most three times that; those unfit for questions and those that another says already are left
    out. Of twice the planned number the details are looked up, and of these the planned number is chosen by difficulty.
    """
    planned = qa.planned_count(qa.document_metrics(docs), mode).select("doc_id", (F.lit(n_pairs).cast("bigint") if n_pairs else F.col("optimal_count")).alias("planned"))
    most = docs.select("doc_id", keyword_functions.best_count(F.col("text")).alias("suits")).join(planned, "doc_id")
    most = staged(most.select("doc_id", "planned", F.least(F.col("planned") * 3, F.greatest("planned", "suits")).alias("most")), "planned")
    ranked = keywords.top_by_score(docs, 150).select("doc_id", "word", "first", "rank").join(most, "doc_id").filter(F.col("rank") <= F.col("most"))  # at most 50 pairs are planned
    fit = staged(keywords.without_redundant(keywords.qa_keywords(ranked)), "qa-candidates")
    relations = keywords.relations(fit.select("doc_id", "word", F.col("rank").alias("first")), docs)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank"))
    looked_up = fit.withColumn("place", place).filter(F.col("place") <= F.col("planned") * 2)
    details = keywords.details(looked_up.select("doc_id", "word"), docs).join(most.select("doc_id", "planned"), "doc_id")
    return qa.template_questions(keywords.by_difficulty(details, F.col("planned"), DIFFICULTIES)).drop("planned"), relations


def corpus_chunks(docs: DataFrame, dataset: str, title_col: str | None = None) -> DataFrame:
    """doc_id (set, number, beginning of the title), doc_idx, chunk_idx, chunk, tokens, dataset_type of a known data set."""
    limit, _, title = DATASETS[dataset]
    title = title_col or title
    rows = numbered_rows(docs, ["doc_id"], "doc_idx").withColumnRenamed("doc_id", "original_id")
    named = F.concat_ws("_", F.lit(dataset), F.col("doc_idx"), F.nullif(F.substring(title, 1, 30), F.lit("")) if title in docs.columns else F.lit(None).cast("string"))
    made = chunking.chunk_table(rows.withColumn("doc_id", named), lambda t: chunking.sentence_groups(t, limit)).join(rows.select(named.alias("doc_id"), "doc_idx"), "doc_id")
    return made.select("doc_id", "doc_idx", "chunk_idx", "chunk", "tokens", F.lit(dataset).alias("dataset_type"))


def hybrid_summary(pairs: DataFrame, coverage: DataFrame) -> DataFrame:
    """Documents, pairs, pairs per document, and average, lowest and highest coverage."""
    n = pairs.groupBy("doc_id").agg(F.count("*").alias("n"))
    both = coverage.join(n, "doc_id", "left")
    return both.agg(F.count("*").alias("n_docs"), F.sum(F.coalesce("n", F.lit(0))).alias("n_pairs"), F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("avg_pairs"), F.round(F.avg("rate"), 6).alias("avg_coverage"), F.min("rate").alias("min_coverage"), F.max("rate").alias("max_coverage"))


def batch_statistics(docs: DataFrame, per_call: int = 10, per_embedding: int = 150) -> DataFrame:
    """Calls that batches of documents need, and the share they save of one writer and two embedding calls a document.

    A batch of documents takes one writer call; chunks and pairs are embedded in two calls for each per_embedding documents.
    """
    n = docs.agg(F.count("*").alias("n_docs"))
    up = lambda k: F.ceil(F.col("n_docs") / k)
    calls = n.withColumns({"llm_calls": up(per_call), "embedding_calls": up(per_embedding) * 2})
    saved = lambda used, plain: F.round(1 - F.col(used) / F.greatest(F.lit(1), plain), 6)
    totals = calls.withColumn("total_calls", F.col("llm_calls") + F.col("embedding_calls"))
    return totals.withColumns({"llm_saved": saved("llm_calls", F.col("n_docs")), "total_saved": saved("total_calls", F.col("n_docs") * 3)})


def hybrid(docs: DataFrame, k: int = 5, writer: Writer | None = None, embedder: Embedder | None = None, per_document: int = 5) -> tuple[DataFrame, DataFrame]:
    """Pairs of all documents and their coverage: keywords and template pairs, or a writer's pairs from them.

    Returns pairs (doc_id, question, answer, source) and coverage (doc_id, n_chunks, covered, rate, threshold). With a
    writer each document is one request that names its keywords; what a reply does not give is not made up by rules.
    Documents without keywords have no pairs; a document without pairs has coverage 0 at the higher threshold.
    """
    words = keywords.top_by_frequency(docs, k)
    if writer is None:
        asked = qa.template_questions(keywords.details(words.select("doc_id", "word"), docs))
        made = qa.template_pairs(asked, keywords.relations(words.select("doc_id", "word", "first"), docs))
        pairs = made.select("doc_id", "question", "answer", F.lit("rule-based").alias("source"))
    else:
        named = words.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), ", ").alias("words"))
        ask = F.concat(F.lit(f"Write {per_document} question and answer pairs as JSON with qa_pairs of question, answer, question_type, about: "), "words", F.lit("\n\n"), F.coalesce("text", F.lit("")))
        prompts = docs.select("doc_id", "text").join(named, "doc_id").select("doc_id", ask.alias("prompt"))
        pairs = written(prompts, writer, "doc_id", "prompt").select("doc_id", "question", "answer", F.lit("written").alias("source"))
    e = embedder or HashedNgrams()
    chunks = chunks_of(docs.select("doc_id", "text")).withColumn("vec_id", F.xxhash64("doc_id", "chunk_idx"))
    texts = pairs.select("doc_id", F.concat_ws(" ", "question", "answer").alias("t")).distinct().withColumn("vec_id", F.xxhash64("doc_id", "t"))
    a = chunks.select("doc_id", "vec_id").join(embedded(chunks, e, "vec_id", "chunk"), "vec_id")
    b = texts.select("doc_id", "vec_id").join(embedded(texts, e, "vec_id", "t"), "vec_id")
    limits = a.select("doc_id").distinct().join(qa.coverage_threshold(pairs), "doc_id", "left").select("doc_id", F.coalesce("threshold", F.lit(qa.WRITTEN_THRESHOLD)).alias("threshold"))
    best = vectors.best_per_document(a, b, "doc_id").join(limits, "doc_id")
    covered_n = F.count_if(F.col("max_sim") >= F.col("threshold"))
    return pairs, best.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), covered_n.alias("covered"), F.round(covered_n / F.count("*"), 6).alias("rate"), F.max("threshold").alias("threshold"))


def comprehensive(docs: DataFrame, target: int = 20, least_confidence: float = 0.7, writer: Writer | None = None) -> DataFrame:
    """Validated pairs of each document, best first: definitions and lists, then template pairs, then a writer's up to the target.

    A question that an earlier phase asked is not asked again. doc_id, ordinal, question, answer, phase, quality_score.
    """
    rules = qa.definitions(docs).filter(F.col("confidence") >= least_confidence).select("doc_id", "question", "answer").unionByName(qa.enumerations(docs).select("doc_id", "question", "answer"))
    templates, _ = hybrid(docs)
    phases = [rules.withColumn("phase", F.lit(1)), templates.select("doc_id", "question", "answer").withColumn("phase", F.lit(2))]
    if writer is not None:
        written_pairs, _ = hybrid(docs, writer=writer, per_document=target)
        phases.append(written_pairs.select("doc_id", "question", "answer").withColumn("phase", F.lit(3)))
    every = phases[0]
    for p in phases[1:]:
        every = every.unionByName(p)
    once = every.groupBy("doc_id", "question").agg(F.min(F.struct("phase", "answer")).alias("first")).select("doc_id", "question", "first.*")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("phase", "question"))
    numbered_pairs = once.withColumn("ordinal", place).filter((F.col("phase") < 3) | (F.col("ordinal") <= target))
    good = qa.validated(numbered_pairs, docs).filter("valid")
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("quality_score"), "ordinal"))
    return good.withColumn("place", best).select("doc_id", "place", "question", "answer", "phase", "quality_score")


def accuracy(questions: DataFrame, store: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """question, correct_answer, retrieved_answer, search_score, similarity (percent): one nearest-neighbour join for all.

    questions: question, answer. store: point_id, vector, answer.
    """
    e = embedder or HashedNgrams()
    q = questions.withColumn("qid", F.xxhash64("question", "answer")).dropDuplicates(["qid"])
    hits = vectors.nearest(embedded(q, e, "qid", "question").select(F.col("qid").alias("vec_id"), "embedding"), store.select(F.col("point_id").alias("vec_id"), F.col("vector").alias("embedding")), 1)
    found = q.join(hits.select(F.col("id").alias("qid"), F.col("other").alias("point_id"), F.col("score").alias("search_score")), "qid").join(store.select("point_id", F.col("answer").alias("retrieved_answer")), "point_id")
    a, b = embedded(found, e, "qid", "answer").withColumnRenamed("embedding", "u"), embedded(found, e, "qid", "retrieved_answer").withColumnRenamed("embedding", "v")
    return found.join(a, "qid").join(b, "qid").select("question", F.col("answer").alias("correct_answer"), "retrieved_answer", "search_score", F.round(vectors.cosine(F.col("u"), F.col("v")) * 100, 6).alias("similarity"))


def progressive(docs: DataFrame, sizes: tuple[int, ...] = (5, 5, 10, 10, 10), least_gain: float = 0.05) -> DataFrame:
    """Template questions for further batches of keywords until a batch lifts the average coverage by less than least_gain.

    The coverage after every batch is found in one pass; the driver gets one number for each.
    """
    ranked = staged(keywords.top_by_score(docs, sum(sizes)).select("doc_id", "word", "rank"), "ranked")
    sets = ranked.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("words"))
    met = docs.select("doc_id", "text").join(sets, "doc_id", "left")
    rate = lambda n: F.coalesce(F.try_divide(keyword_functions.covered_chars(F.col("text"), F.slice("words", 1, n)).cast("double"), F.length("text")), F.lit(0.0))
    ends = list(accumulate(sizes))
    averages = met.agg(*[F.avg(F.round(rate(n), 6)) for n in ends]).first()
    taken, before = 0, 0.0
    for n, now in zip(ends, averages):
        taken = n
        if (now or 0.0) - before < least_gain:
            break
        before = now
    return qa.template_questions(keywords.details(ranked.filter(F.col("rank") <= taken).select("doc_id", "word"), docs))
