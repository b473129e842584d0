"""Queries of the chunking, keyword and question-and-answer operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tesserae.functions import keywords as K
from tesserae.functions import text as T
from tesserae.operators import chunking, duplicates, generation, keywords, qa, replies, tables
from tesserae.operators.vectors import length_bucket
from tesserae.plans import pipelines
from tesserae.plans.queries_tables import _QA, docs_of, qa_pairs
from tesserae.plans.registry import CANDIDATE_SQL, TECH_SQL, TERMS_SQL, WS, query, sql_clean, sql_sentences, sql_tokens, table
from tesserae.plans.sql_chunks import MERGE_SMALL, PARAGRAPH_CHUNKS, SEMANTIC, TRANSLATION_SEGMENTS, packed_paragraph_sql
from tesserae.providers import DigestWriter

_S = f"SELECT doc_id, unnest({sql_sentences('text')}) AS s, generate_subscripts({sql_sentences('text')}, 1) - 1 AS i FROM documents"


@query(rf"SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda s: trim(s, {WS})), lambda s: s <> '')) AS para FROM documents")
def paragraphs(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.explode(T.paragraphs(F.col("text"))).alias("para"))


@query(_S)
def sentence_split(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "s"))


@query(rf"SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([。．？！?!])', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, {WS})), lambda s: s <> '')) AS n FROM documents")
def sentence_split_marks(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.size(T.sentences(F.col("text"), "。．？！?!")).cast("bigint").alias("n"))


_PROFILE = f"""WITH s AS (SELECT unnest({sql_sentences('t')}) AS s FROM (SELECT {sql_clean('text')} AS t FROM documents)), k AS (SELECT {sql_tokens('s')} AS n FROM s)
SELECT CASE WHEN n < 100 THEN 'short' WHEN n < 200 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n, round(avg(n), 6) AS avg_tokens FROM k GROUP BY 1"""


@query(_PROFILE)
def chunk_length_profile(spark, sf):
    s = docs_of(spark, sf).select(F.explode(T.sentences(T.clean_text(F.col("text")))).alias("s")).select(T.token_estimate(F.col("s")).alias("n"))
    return s.groupBy(length_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("n"), 6).alias("avg_tokens"))


@query(_PROFILE)
def chunk_length_profile_all(spark, sf):
    return chunk_length_profile(spark, sf)


# the packing of sentences, as a recursion over the sentences of each document
_PACK = f"""
WITH RECURSIVE s AS ({_S}), k AS (SELECT doc_id, i, s, {sql_tokens('s')} AS n FROM s),
p AS (SELECT doc_id, i, n AS size, 0::BIGINT AS grp FROM k WHERE i = 0
  UNION ALL SELECT k.doc_id, k.i, CASE WHEN p.size + k.n > 200 THEN k.n ELSE p.size + k.n END, CASE WHEN p.size + k.n > 200 THEN p.grp + 1 ELSE p.grp END FROM p JOIN k ON k.doc_id = p.doc_id AND k.i = p.i + 1)
"""


@query(_PACK + "SELECT p.doc_id, p.grp AS chunk_idx, md5(string_agg(k.s, ' ' ORDER BY k.i)) AS chunk, min(k.i)::BIGINT AS first, max(k.i)::BIGINT AS last FROM p JOIN k USING (doc_id, i) GROUP BY p.doc_id, p.grp")
def greedy_pack(spark, sf):
    out = chunking.chunk_table(docs_of(spark, sf), chunking.sentence_groups)
    return out.select("doc_id", "chunk_idx", F.md5("chunk").alias("chunk"), F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"))


def _end(size: int) -> str:
    """Where a window of ``size`` characters from ``pos`` ends: after the first kind of mark that stands in its second half."""
    at = f"instr(reverse(substr(text, pos + 1, {size})), '{{m}}')"
    ends = ", ".join(f"CASE WHEN {at.format(m=m)} BETWEEN 1 AND {size // 2 - 1} THEN pos + {size + 1} - {at.format(m=m)} END" for m in "。！？.!?")
    return f"CASE WHEN pos + {size} < length(text) THEN coalesce({ends}, pos + {size}) ELSE pos + {size} END"


_END = _end(1000)


def _chunks(spark, sf):
    return pipelines.chunks_of(docs_of(spark, sf))


@query(PARAGRAPH_CHUNKS)
def paragraph_chunks(spark, sf):
    return chunking.chunk_table(docs_of(spark, sf), chunking.paragraph_chunks)


@query("WITH RECURSIVE " + SEMANTIC + " SELECT doc_id, chunk_idx, kind, tokens FROM semantic")
def semantic_chunks(spark, sf):
    return _chunks(spark, sf).select("doc_id", "chunk_idx", "kind", "tokens")


@query(MERGE_SMALL)
def merge_small(spark, sf):
    return chunking.merge_small(chunking.chunk_table(docs_of(spark, sf), chunking.sentence_groups)).select("doc_id", "chunk_idx", "chunk_span", "tokens", "n_original")


@query(packed_paragraph_sql("en"))
def packed_paragraphs(spark, sf):
    return chunking.chunk_table(docs_of(spark, sf), chunking.as_chunks(chunking.packed_paragraphs, "en", 500)).select("doc_id", "chunk_idx", "tokens")


@query(packed_paragraph_sql("ja"))
def packed_paragraphs_ja(spark, sf):
    return chunking.chunk_table(docs_of(spark, sf), chunking.as_chunks(chunking.packed_paragraphs, "ja", 500)).select("doc_id", "chunk_idx", "tokens")


@query(f"""WITH RECURSIVE w AS (SELECT doc_id, text, 0 AS pos FROM documents WHERE length(text) > 1000 UNION ALL
 SELECT doc_id, text, greatest(pos + 1, e - 100) FROM (SELECT doc_id, text, pos, {{end}} AS e FROM w) WHERE greatest(pos + 1, e - 100) < length(text)),
p AS (SELECT doc_id, pos, trim(substr(text, pos + 1, {{end}} - pos), {WS}) AS piece FROM w)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chunk_idx, length(piece) AS n FROM p WHERE piece <> '' UNION ALL SELECT doc_id, 0, length(text) FROM documents WHERE length(text) <= 1000""".replace("{end}", _END))
def sliding_window(spark, sf):
    return chunking.chunk_table(docs_of(spark, sf), chunking.as_chunks(chunking.sliding, 1000, 100)).select("doc_id", "chunk_idx", F.length("chunk").alias("n"))


@query(TRANSLATION_SEGMENTS)
def translation_segments(spark, sf):
    return chunking.chunk_table(docs_of(spark, sf), chunking.as_chunks(chunking.translation_segments, 400)).select("doc_id", "chunk_idx", "tokens")


def _sliding_sql(size: int) -> str:
    """pieces (doc_id, chunk_idx, piece) of documents (doc_id, text)."""
    return f"""w AS (SELECT doc_id, text, 0 AS pos FROM documents WHERE length(text) > {size} UNION ALL
 SELECT doc_id, text, greatest(pos + 1, e - 100) FROM (SELECT doc_id, text, pos, {_end(size)} AS e FROM w) WHERE greatest(pos + 1, e - 100) < length(text)),
p AS (SELECT doc_id, pos, trim(substr(text, pos + 1, {_end(size)} - pos), {WS}) AS piece FROM w),
pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chunk_idx, piece FROM p WHERE piece <> '' UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= {size})"""


@query(f"""WITH RECURSIVE documents AS (SELECT doc_id, t AS text FROM (SELECT doc_id, {sql_clean('text')} AS t FROM main.documents) WHERE t <> ''), {_sliding_sql(2000)},
e AS (SELECT doc_id, chunk_idx, piece, 'customer_support_faq_' || doc_id || '_' || chunk_idx AS entry_id, count(*) OVER (PARTITION BY doc_id) AS total FROM pieces),
j AS (SELECT doc_id, chunk_idx, entry_id, length(to_json({{'id': entry_id, 'text': piece, 'metadata': {{'dataset': 'customer_support_faq', 'original_line': doc_id, 'chunk_index': chunk_idx, 'total_chunks': total, 'domain': 'customer_support'}}}})::VARCHAR)::BIGINT AS entry_size FROM e),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id, chunk_idx) AS place, sum(entry_size) OVER (ORDER BY doc_id, chunk_idx) AS upto FROM j)
SELECT entry_id, entry_size FROM r WHERE place <= 3000 AND upto - entry_size <= 30 * 1048576""")
def store_entries(spark, sf):
    return chunking.store_entries(docs_of(spark, sf), "customer_support_faq", max_chunks=3000).select("entry_id", F.col("entry_size").cast("bigint").alias("entry_size"))


@query(f"""WITH RECURSIVE documents AS (SELECT doc_id, lang, t AS text FROM (SELECT doc_id, lang, {sql_clean('text')} AS t FROM main.documents) WHERE t <> ''), {_sliding_sql(1000)},
e AS (SELECT lang, doc_id, chunk_idx, piece, 'unified_all_' || lang || '_' || doc_id || '_' || chunk_idx AS entry_id, count(*) OVER (PARTITION BY doc_id) AS total FROM pieces JOIN documents USING (doc_id)),
j AS (SELECT *, length(to_json({{'id': entry_id, 'text': piece, 'metadata': {{'dataset': lang, 'original_line': doc_id, 'chunk_index': chunk_idx, 'total_chunks': total}}}})::VARCHAR) AS entry_size, row_number() OVER (ORDER BY lang DESC, doc_id, chunk_idx) - 1 AS place FROM e)
SELECT entry_id, entry_size::BIGINT AS entry_size, place FROM j WHERE place < (SELECT CASE WHEN sum(entry_size) > 0.3::DOUBLE * 1048576 THEN floor(count(*) * 0.9::DOUBLE * (0.3::DOUBLE * 1048576) / sum(entry_size)) ELSE count(*) END FROM j)""")
def unified_store_entries(spark, sf):
    """One store of four sets, the documents of each language, cut at a limit that the smallest table passes."""
    d = docs_of(spark, sf)
    out = chunking.unified_entries({k: d.filter(F.col("lang") == k) for k in ("fr", "es", "en", "de")}, 1000, 100, 0.3)
    return out.select("entry_id", F.col("entry_size").cast("bigint").alias("entry_size"), "place")


@query("""WITH r AS (SELECT doc_id, length(text) AS size, sum(length(text)) OVER (ORDER BY doc_id) AS sum_size, row_number() OVER (ORDER BY doc_id) AS k FROM documents)
SELECT doc_id, size::BIGINT AS size FROM r WHERE k <= 5000 AND sum_size - size <= 1000000""")
def size_limited_prefix(spark, sf):
    return chunking.running_cut(docs_of(spark, sf).select("doc_id", F.length("text").cast("bigint").alias("size")), ["doc_id"], "size", 5000, 1_000_000).select("doc_id", "size")


@query("""WITH w AS (SELECT doc_id, text, unnest(range(0, length(text), 400)) AS a FROM documents WHERE length(text) > 0) SELECT doc_id, count(*) AS n, sum(length(substr(text, a + 1, 500)))::BIGINT AS total FROM w GROUP BY doc_id""")
def hierarchy_windows(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.explode(T.windows(F.col("text"))).alias("w")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("w")).alias("total"))


# keywords

_STOP = ", ".join(f"'{w}'" for w in K.STOPWORDS)
_IMPORTANT = ", ".join(f"'{w}'" for w in K.IMPORTANT)


def _words_sql(pattern: str = CANDIDATE_SQL) -> str:
    x = f"regexp_extract_all(text, '{pattern}')"
    return f"e AS (SELECT doc_id, unnest({x}) AS word, generate_subscripts({x}, 1) AS pos FROM documents), w AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM e WHERE length(word) >= 2 AND word NOT IN ({_STOP}) GROUP BY doc_id, word)"


def _top_sql(score: str, k: int = 5, extra: str = "w") -> str:
    return f"SELECT doc_id, word, rank FROM (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY {score} DESC, first) AS rank FROM {extra}) WHERE rank <= {k}"


def _form_sql(a: float, b: float, c: float) -> str:
    return f"CASE WHEN regexp_full_match(word, '[ァ-ヴー]{{3,}}') THEN {a}::DOUBLE WHEN regexp_full_match(word, '[A-Z]{{2,}}') THEN {b}::DOUBLE WHEN regexp_full_match(word, '[一-龥]{{4,}}') THEN {c}::DOUBLE ELSE 0::DOUBLE END"


@query(f"WITH {_words_sql()} {_top_sql('n')}")
def keyword_topn(spark, sf):
    return keywords.top_by_frequency(docs_of(spark, sf)).select("doc_id", "word", "rank")


_SCORE = f"round(least(n / 3.0::DOUBLE, 1) * 0.3::DOUBLE + least(length(word) / 8.0::DOUBLE, 1) * 0.3::DOUBLE + CASE WHEN word IN ({_IMPORTANT}) THEN 0.5::DOUBLE ELSE 0 END + {_form_sql(.2, .3, .2)}, 9)"


@query(f"WITH {_words_sql()} " + _top_sql(_SCORE))
def keyword_scored(spark, sf):
    return keywords.top_by_score(docs_of(spark, sf)).select("doc_id", "word", "rank")


_OCC = "(length(d.text) - length(replace(d.text, w.word, ''))) // length(w.word)"


@query(f"WITH {_words_sql()}, x AS (SELECT w.doc_id, w.word, w.first, round(least(1, least({_OCC} / 3.0::DOUBLE, 1) * 0.3::DOUBLE + least(length(w.word) / 8.0::DOUBLE, 1) * 0.2::DOUBLE + CASE WHEN w.word IN ({_IMPORTANT}) THEN 0.4::DOUBLE ELSE 0 END + {_form_sql(.15, .2, .15)}), 9) AS s FROM w JOIN documents d USING (doc_id)) {_top_sql('s', 5, 'x')}")
def keyword_text_scores(spark, sf):
    return keywords.text_scores(docs_of(spark, sf)).select("doc_id", "word", "rank")


@query("WITH " + _words_sql(r"[ァ-ヴー]+|[一-龥]{2,}|[A-Za-z]+[A-Za-z0-9]*") + ", x AS (SELECT w.doc_id, w.word, w.first, round(w.n * (1 + least(length(w.word) / 10.0::DOUBLE, 1) + (1 - (instr(d.text, w.word) - 1)::DOUBLE / length(d.text) * 0.3::DOUBLE) + CASE WHEN regexp_matches(w.word, '[A-Za-z]') THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(w.word, '[ァ-ヴー]') THEN 0.3::DOUBLE ELSE 0 END), 9) AS s FROM w JOIN documents d USING (doc_id)) " + _top_sql("s", 5, "x"))
def keyword_qa_scores(spark, sf):
    return keywords.qa_scores(docs_of(spark, sf)).select("doc_id", "word", "rank")


_W30 = " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS word, {x}::DOUBLE AS weight, generate_subscripts(regexp_extract_all(text, '{p}'), 1) + {b * 1000000} AS pos FROM documents" for b, (p, x) in enumerate(((r"[A-Z][A-Za-z0-9]*", 2.0), (r"[ァ-ヴー]{3,}", 1.5), (r"[一-龥]{3,}", 1.0))))


@query(f"WITH m AS ({_W30}), x AS (SELECT doc_id, word, sum(weight) AS s, min(pos) AS first FROM m WHERE length(word) > 1 GROUP BY doc_id, word) {_top_sql('s', 5, 'x')}")
def keyword_weighted_patterns(spark, sf):
    return keywords.weighted_patterns(docs_of(spark, sf)).select("doc_id", "word", "rank")


_SCORE = f"round(least(n / 3.0::DOUBLE, 1) * 0.3::DOUBLE + least(length(word) / 8.0::DOUBLE, 1) * 0.3::DOUBLE + CASE WHEN word IN ({_IMPORTANT}) THEN 0.5::DOUBLE ELSE 0 END + {_form_sql(.2, .3, .2)}, 9)"


@query(f"""WITH {_words_sql()}, a AS (SELECT doc_id, list(word) AS a FROM ({_top_sql('n', 10)}) GROUP BY doc_id), b AS (SELECT doc_id, list(word) AS b FROM ({_top_sql(_SCORE, 10)}) GROUP BY doc_id)
SELECT doc_id, len(a) AS n_frequency, len(b) AS n_score, len(list_intersect(a, b)) AS n_common, len(a) - len(list_intersect(a, b)) AS n_only_frequency, len(b) - len(list_intersect(a, b)) AS n_only_score FROM a JOIN b USING (doc_id)""")
def keyword_methods_compared(spark, sf):
    return keywords.methods_compared(docs_of(spark, sf))


_WEIGHT = "greatest(CASE WHEN regexp_full_match(word, '[ァ-ヴー]{3,}') THEN 1.0 ELSE 0 END::DOUBLE, CASE WHEN regexp_full_match(word, '[A-Z]{2,}[A-Z0-9]*') THEN 1.2 ELSE 0 END::DOUBLE, CASE WHEN regexp_full_match(word, '[一-龥]{4,}') THEN 0.9 ELSE 0 END::DOUBLE, CASE WHEN regexp_full_match(word, '[A-Za-z]+[A-Za-z0-9]*') THEN 0.8 ELSE 0 END::DOUBLE)"


def _quality_sql(t: str) -> str:
    """The quality figures f of keyword sets t (doc_id, word, rank, and what else is told of the set) by document and method."""
    return f"""t AS ({t}), x AS (SELECT t.doc_id, method, t.word, t.rank, contains(d.text, t.word)::INT::DOUBLE AS inside, {_WEIGHT} AS weight, list_distinct(list_transform(range(1, length(t.word)), lambda i: substr(t.word, i, 2))) AS grams FROM t JOIN documents d USING (doc_id)),
l AS (SELECT a.doc_id, a.method, count(*) FILTER (list_has_any(a.grams, b.grams)) AS linked FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.method = b.method AND a.rank < b.rank GROUP BY a.doc_id, a.method),
g AS (SELECT doc_id, method, count(*) AS n, avg(inside) AS coverage, stddev_samp(length(word)) AS sd, least(1, avg(weight)) AS technicality, avg((length(word) BETWEEN 2 AND 8)::INT::DOUBLE) AS length_balance FROM x GROUP BY doc_id, method),
f AS (SELECT *, round(least(1, coverage * 0.25::DOUBLE + diversity * 0.15::DOUBLE + technicality * 0.25::DOUBLE + coherence * 0.2::DOUBLE + length_balance * 0.15::DOUBLE), 6) AS total FROM (
 SELECT g.*, CASE WHEN n > 1 THEN least(1, CASE WHEN sd < 3 THEN sd / 3 ELSE (6 - sd) / 3 END) ELSE 0.5::DOUBLE END AS diversity, CASE WHEN n > 1 THEN coalesce(linked, 0) / (n * (n - 1) / 2.0::DOUBLE) ELSE 0 END AS coherence FROM g LEFT JOIN l USING (doc_id, method)))"""


@query(f"""WITH {_words_sql()}, {_quality_sql(_top_sql(_SCORE, 10).replace("SELECT doc_id", "SELECT 0 AS method, doc_id", 1))}
SELECT doc_id, round(coverage, 6) AS coverage, round(diversity, 6) AS diversity, round(technicality, 6) AS technicality, round(coherence, 6) AS coherence, round(length_balance, 6) AS length_balance, total FROM f""")
def keyword_quality(spark, sf):
    return keywords.set_quality(keywords.top_by_score(docs_of(spark, sf), 10), docs_of(spark, sf))


_METHODS = " UNION ALL ".join(_top_sql(score, 10, rows).replace("SELECT doc_id", f"SELECT {i} AS method, doc_id", 1) for i, (score, rows) in enumerate((("n", "w"), (_SCORE, "w"), ("s", "weighed"))))


@query(f"""WITH {_words_sql()}, matched AS ({_W30}), weighed AS (SELECT doc_id, word, sum(weight) AS s, min(pos) AS first FROM matched WHERE length(word) > 1 GROUP BY doc_id, word), {_quality_sql(_METHODS)}
SELECT doc_id, CASE method WHEN 0 THEN 'frequency' WHEN 1 THEN 'score' ELSE 'weighted' END AS method, total FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, method) AS k FROM f) WHERE k = 1""")
def keyword_best_method(spark, sf):
    d = docs_of(spark, sf)
    methods = (("frequency", keywords.top_by_frequency(d, 10)), ("score", keywords.top_by_score(d, 10)), ("weighted", keywords.weighted_patterns(d, 10)))
    scores = None
    for i, (name, rows) in enumerate(methods):
        one = keywords.set_quality(rows, d).select("doc_id", F.lit(name).alias("method"), F.lit(i).alias("place"), "total")
        scores = one if scores is None else scores.unionAll(one)
    return keywords.best_method(scores)


_N100 = f"CASE WHEN len(regexp_extract_all(text, '{TERMS_SQL}')) / greatest(length(text) / 100.0::DOUBLE, 1) > 2 THEN 2 ELSE 0 END"


@query(f"""SELECT doc_id, CASE WHEN length(text) < 100 THEN 3 WHEN length(text) < 300 THEN 5 WHEN length(text) < 500 THEN 7 + {_N100} WHEN length(text) < 1000 THEN 10 + CASE WHEN len(string_split_regex(text, '[。！？.!?]+')) > 10 THEN 2 ELSE 0 END
 WHEN length(text) < 2000 THEN 15 ELSE least(30, 20 + floor(log2(length(text) / 2000.0::DOUBLE))) END::BIGINT AS k FROM documents""")
def keyword_auto_count(spark, sf):
    return docs_of(spark, sf).select("doc_id", K.best_count(F.col("text")).alias("k"))


@query(f"""WITH {_words_sql()}, t AS ({_top_sql('n', 15)}), c AS (SELECT t.doc_id, t.rank, sum((length(d.text) - length(replace(d.text, t.word, '')))::DOUBLE / greatest(length(d.text), 1)) OVER (PARTITION BY t.doc_id ORDER BY t.rank) AS share FROM t JOIN documents d USING (doc_id))
SELECT doc_id, coalesce(min(rank) FILTER (share >= 0.2), max(rank)) AS enough, round(max(share), 6) AS reach FROM c GROUP BY doc_id""")
def keyword_enough(spark, sf):
    d = docs_of(spark, sf)
    return keywords.enough(keywords.top_by_frequency(d, 15), d, 0.2)


@query(f"""WITH {_words_sql()}, r AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM w), s AS (SELECT doc_id, rank, sum(n) OVER (PARTITION BY doc_id ORDER BY rank)::DOUBLE AS share FROM r WHERE rank <= 15),
g AS (SELECT doc_id, rank, share / lag(share) OVER (PARTITION BY doc_id ORDER BY rank) - 1 AS gain FROM s) SELECT doc_id, coalesce(min(rank) FILTER (gain < 0.05::DOUBLE) - 1, max(rank)) AS stop FROM g GROUP BY doc_id""")
def keyword_diminishing(spark, sf):
    rows = keywords.top_by_frequency(docs_of(spark, sf), 15).withColumn("share", F.sum("n").over(Window.partitionBy("doc_id").orderBy("rank")).cast("double"))
    return keywords.diminishing(rows)


@query(f"WITH {_words_sql()}, t AS ({_top_sql('n', 10)}) SELECT doc_id, count(*) AS n FROM t WHERE word NOT LIKE '第%' AND word NOT LIKE '%等' AND word NOT LIKE '%的' AND word NOT IN ({', '.join(repr(w) for w in K.QA_STOPWORDS)}) GROUP BY doc_id")
def keyword_qa_filter(spark, sf):
    return keywords.qa_keywords(keywords.top_by_frequency(docs_of(spark, sf), 10)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {_words_sql()}, t AS ({_top_sql('n', 10)}) SELECT a.doc_id, a.word FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.doc_id = a.doc_id AND b.word <> a.word AND contains(b.word, a.word))")
def redundancy_removed(spark, sf):
    return keywords.without_redundant(keywords.top_by_frequency(docs_of(spark, sf), 10)).select("doc_id", "word")


_T = f"{_words_sql()}, t AS ({_top_sql('n', 5)})"
_IMP = (
    "least(1, (CASE WHEN length(s) > 0 THEN 1 - (instr(s, word) - 1)::DOUBLE / length(s) ELSE 0 END) * 0.2::DOUBLE + least(len(regexp_extract_all(s, '" + TERMS_SQL + "')) / 5.0::DOUBLE, 1) * 0.3::DOUBLE + ("
    + " + ".join(f"contains(s, '{p}')::INT" for p in K.EXPLAINING) + ")::DOUBLE / 5 * 0.3::DOUBLE + greatest(0, 1 - abs(length(s) - 50) / 50.0::DOUBLE) * 0.2::DOUBLE)"
)


_TOLD = "(contains(d.text, t.word || 'とは') OR (contains(d.text, t.word || 'は') AND contains(d.text, 'である')) OR contains(d.text, t.word || '（'))"


def _details_sql(k: int) -> str:
    """The tables of details of each text's k most frequent words, the last named details."""
    return f"""WITH {_words_sql()}, t AS ({_top_sql('n', k)}), x AS (SELECT doc_id, unnest(string_split_regex(text, '[。！？.!?]')) AS s, generate_subscripts(string_split_regex(text, '[。！？.!?]'), 1) AS place FROM documents),
m AS (SELECT t.doc_id, t.word, x.place, x.s, round({_IMP}, 9) AS importance FROM t JOIN x ON t.doc_id = x.doc_id AND contains(x.s, t.word)),
b AS (SELECT doc_id, word, first(trim(s) ORDER BY importance DESC, place) AS best_context, max(importance) AS context_importance, first(importance ORDER BY place) AS first_importance FROM m GROUP BY doc_id, word),
details AS (SELECT t.doc_id, t.word, {_OCC.replace('w.word', 't.word')} AS frequency, md5(b.best_context) AS best_context, b.context_importance, b.first_importance,
 CASE WHEN {_TOLD} AND {_OCC.replace('w.word', 't.word')} >= 3 THEN 'basic' WHEN regexp_matches(t.word, '^[A-Z]{{2,}}[A-Z0-9]*$') AND NOT {_TOLD} THEN 'advanced' WHEN length(t.word) >= 8 OR {_OCC.replace('w.word', 't.word')} = 1 THEN 'advanced' WHEN {_OCC.replace('w.word', 't.word')} >= 5 THEN 'basic' ELSE 'intermediate' END AS difficulty,
 CASE WHEN t.word IN ('BERT', 'GPT', 'CNN', 'RNN', 'LSTM') THEN 'specific_name' WHEN regexp_matches(t.word, '^[A-Z]{{2,}}[A-Z0-9]*$|^[ァ-ヴー]{{4,}}$') THEN 'technical_term' ELSE 'other' END AS category
FROM t JOIN documents d USING (doc_id) JOIN b USING (doc_id, word))"""


@query(_details_sql(5) + " SELECT doc_id, word, frequency, best_context, context_importance, difficulty, category FROM details")
def keyword_details(spark, sf):
    d = docs_of(spark, sf)
    out = keywords.details(keywords.top_by_frequency(d, 5).select("doc_id", "word"), d)
    return out.select("doc_id", "word", "frequency", F.md5("best_context").alias("best_context"), "context_importance", "difficulty", "category")


#: The test tables have no Japanese; these words stand in for the particles, so that every relation's pattern fits somewhere.
_PARTICLES = ((" of ", "は"), (" to ", "を"), (" in ", "により"), (" is ", "が"), (" that ", "のため"), (" with ", "を用いて"), (" was ", "から"), (" on ", "へ"), (" as ", "における"), (" by ", "による"), ("ing ", "である"), ("ed ", "する"))


def _particles_sql() -> str:
    out = "text"
    for a, b in _PARTICLES:
        out = f"replace({out}, '{a}', '{b}')"
    return f"documents AS (SELECT doc_id, {out} AS text FROM main.documents)"


def _with_particles(spark, sf):
    text = F.col("text")
    for a, b in _PARTICLES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return docs_of(spark, sf).select("doc_id", text.alias("text"))


def _relation_case(s: str) -> str:
    """The relation of a sentence by its patterns, as regular expressions, in their order."""
    fits = [(".+?" + ".+?".join(words) + (".+?" if after else ""), name) for words, after, name in keywords.RELATIONS]
    return "CASE " + " ".join(f"WHEN regexp_matches({s}, '{p}') THEN '{n}'" for p, n in fits) + f" ELSE '{keywords.CO_OCCURS}' END"


#: From kw (doc_id, word, first): the relations of each document's keywords, with the place of their first sentence and pair.
_RELATIONS = f"""said AS (SELECT doc_id, unnest(string_split_regex(text, '[。！？.!?]')) AS s, generate_subscripts(string_split_regex(text, '[。！？.!?]'), 1) AS place FROM documents),
held AS (SELECT kw.doc_id, place, s, kw.word, row_number() OVER (PARTITION BY kw.doc_id, place ORDER BY kw.first) AS k, count(*) OVER (PARTITION BY kw.doc_id, place) AS n_held FROM kw JOIN said ON kw.doc_id = said.doc_id AND contains(said.s, kw.word)),
kinds AS (SELECT doc_id, place, any_value({_relation_case('s')}) AS kind FROM held WHERE n_held > 1 GROUP BY doc_id, place),
pairs AS (SELECT a.doc_id, a.place, a.s, kind, a.k AS i, b.k AS j, CASE WHEN kind = '{keywords.CO_OCCURS}' OR instr(a.s, a.word) < instr(a.s, b.word) THEN a.word ELSE b.word END AS source,
 CASE WHEN kind = '{keywords.CO_OCCURS}' OR instr(a.s, a.word) < instr(a.s, b.word) THEN b.word ELSE a.word END AS target
 FROM held a JOIN held b ON a.doc_id = b.doc_id AND a.place = b.place AND a.k < b.k JOIN kinds ON kinds.doc_id = a.doc_id AND kinds.place = a.place WHERE kind = '{keywords.CO_OCCURS}' OR b.k = a.k + 1),
relations AS (SELECT doc_id, source, target, kind AS relation_type, first(trim(s, {WS}) ORDER BY place, i, j) AS context, min((place, i, j)) AS pos FROM pairs GROUP BY doc_id, source, target, kind)"""


@query(f"WITH {_particles_sql()}, {_words_sql()}, t AS ({_top_sql('n', 5)}), kw AS (SELECT t.doc_id, t.word, w.first FROM t JOIN w USING (doc_id, word)), {_RELATIONS} SELECT doc_id, source, target, relation_type, md5(context) AS context FROM relations")
def keyword_relations(spark, sf):
    d = _with_particles(spark, sf)
    return keywords.relations(keywords.top_by_frequency(d, 5).select("doc_id", "word", "first"), d).withColumn("context", F.md5("context")).drop("place")


@query(_details_sql(10) + """, q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, difficulty ORDER BY first_importance DESC, word) <= CASE difficulty WHEN 'intermediate' THEN 2 ELSE 1 END AS in_quota FROM details),
p AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY in_quota DESC, first_importance DESC, word) AS place FROM q) SELECT * FROM p WHERE place <= 5""")
def keyword_by_difficulty(spark, sf):
    d = docs_of(spark, sf)
    return keywords.by_difficulty(keywords.details(keywords.top_by_frequency(d, 10).select("doc_id", "word"), d), 5, {"basic": 0.3, "intermediate": 0.5, "advanced": 0.2}).select("doc_id", "word", "place")


@query(f"""WITH {_T} SELECT t.doc_id, round(avg(contains(d.text, t.word)::INT::DOUBLE), 6) AS coverage, round(avg((length(t.word) >= 4)::INT::DOUBLE), 6) AS compound,
 round(avg(regexp_matches(t.word, '{keywords.TECHNICAL_WORD}')::INT::DOUBLE), 6) AS technical FROM t JOIN documents d ON d.doc_id = t.doc_id + 1 GROUP BY t.doc_id""")
def keyword_coverage_potential(spark, sf):
    """The next document stands in for the text that a document's keywords do not cover yet."""
    d = docs_of(spark, sf)
    return keywords.coverage_potential(keywords.top_by_frequency(d, 5).select("doc_id", "word"), d.select((F.col("doc_id") - 1).alias("doc_id"), "text"))


_WIDE = r"[ァ-ヴー]+|[一-龥]{2,}|[A-Za-z]+[A-Za-z0-9]*"


@query(f"""WITH {_words_sql(_WIDE)}, top AS ({_top_sql('n')}), best AS (SELECT doc_id, list(word ORDER BY rank) AS best FROM top GROUP BY doc_id),
more AS (SELECT d.doc_id, coalesce(best, []) AS best, list_filter(regexp_extract_all(d.text, '{_WIDE}'), lambda x: NOT list_contains(coalesce(best, []), x)) AS rest FROM documents d LEFT JOIN best USING (doc_id)),
every AS (SELECT doc_id, list_concat(best, rest[1 : greatest(3 - len(best), 0)]) AS l FROM more)
SELECT doc_id, generate_subscripts(l, 1) - 1 AS place, unnest(l) AS word FROM every""")
def keyword_frequent_or_first(spark, sf):
    return keywords.frequent_or_first(docs_of(spark, sf))


_COVERED = f"""WITH RECURSIVE {_T}, f AS (SELECT t.doc_id, t.word, 0 AS p, d.text AS rest FROM t JOIN documents d USING (doc_id)
 UNION ALL SELECT doc_id, word, p + instr(rest, word), substr(rest, instr(rest, word) + 1) FROM f WHERE instr(rest, word) > 0),
o AS (SELECT doc_id, p AS s, p + length(word) AS e FROM f WHERE p > 0), m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o),
n AS (SELECT doc_id, sum(greatest(0, e - greatest(s, coalesce(before, 0))))::BIGINT AS covered FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.covered, 0) AS covered, round(coalesce(n.covered, 0)::DOUBLE / length(d.text), 6) AS coverage FROM documents d LEFT JOIN n USING (doc_id)"""


@query(_COVERED)
def keyword_char_coverage(spark, sf):
    d = docs_of(spark, sf)
    return keywords.char_coverage(keywords.top_by_frequency(d, 5), d)


@query(_COVERED)
def keyword_char_coverage_all(spark, sf):
    return keyword_char_coverage(spark, sf)


_GAPW = " + ".join(f"contains(text, '{w}')::INT" for w in K.GAP_WORDS)


@query(rf"""SELECT doc_id, round(least(100, (least(length(text) / 200.0::DOUBLE, 1) * 0.3::DOUBLE + least(len(regexp_extract_all(text, '[ァ-ヴー]+|[A-Z][a-z]*|[一-龥]{{3,}}'))::DOUBLE / greatest(len(list_filter(string_split_regex(text, '\s+'), lambda s: s <> '')), 1) * 10, 1) * 0.4::DOUBLE
 + CASE WHEN regexp_matches(text, '[0-9]') THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(text, '[％%＄$€¥]') THEN 0.15::DOUBLE ELSE 0 END + least(({_GAPW}) / 3.0::DOUBLE, 1) * 0.3::DOUBLE) * 100), 6) AS priority FROM documents""")
def gap_priority(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.round(K.gap_priority(F.col("text")), 6).alias("priority"))


@query("SELECT vec_id, CASE WHEN label >= 8 THEN 'excellent' WHEN label >= 6 THEN 'good' WHEN label >= 4 THEN 'fair' ELSE 'poor' END AS level FROM embeddings")
def coverage_levels_named(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", K.coverage_level(F.col("label") / 10.0).alias("level"))


@query(f"""WITH {_words_sql()}, t AS ({_top_sql('n', 3)}), y(a, b) AS (VALUES {', '.join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in K.SYNONYMS)}),
k AS (SELECT doc_id + 1 AS doc_id, word FROM w UNION SELECT doc_id + 1, b FROM w JOIN y ON y.a = w.word) SELECT doc_id, word FROM t ANTI JOIN k USING (doc_id, word)""")
def new_keywords(spark, sf):
    """What a document's keywords add to the words of the document before it."""
    d = docs_of(spark, sf)
    return keywords.new_words(keywords.top_by_frequency(d, 3).select("doc_id", "word"), keywords.words(d).select((F.col("doc_id") + 1).alias("doc_id"), "word"))


# questions and answers


@query(f"SELECT doc_id, least(8, CASE WHEN n < 50 THEN 2 WHEN n < 100 THEN 3 WHEN n < 200 THEN 6 WHEN n < 300 THEN 7 ELSE 8 END + CASE WHEN doc_id % 10 >= 5 THEN 1 ELSE 0 END)::BIGINT AS quota FROM (SELECT doc_id, {sql_tokens('text')} AS n FROM documents)")
def qa_quota(spark, sf):
    return docs_of(spark, sf).select("doc_id", qa.chunk_quota(T.token_estimate(F.col("text")), F.col("doc_id") % 10).alias("quota"))


_CON = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"


def _con(x: str) -> str:
    return f"regexp_extract({x}, '{_CON}')"


def _held(words: tuple[str, ...]) -> str:
    return " + ".join(f"contains(substr(text, 1, 200), '{w}')::INT" for w in words)


_EN = f"(({_held(T.EN_MARKERS)}) > ({_held(T.JA_MARKERS)}))"
def _rule_sql(source: str) -> str:
    """every: the pairs that the rules make of source (doc_id, text), English and others, each with its place o."""
    return rf"""c AS (SELECT doc_id, text AS t, list_filter(list_transform(string_split(text, '. '), lambda s: trim(s, {WS})), lambda s: length(s) > 20) AS p FROM {source} WHERE {_EN}),
s AS (SELECT doc_id, t, p, unnest(range(1, least(len(p), 3) + 1)) AS i FROM c WHERE len(p) > 0),
q AS (
  SELECT doc_id, 0 AS o, 'What information is discussed in this section?' AS question, substr(t, 1, 500) AS answer, 'comprehensive' AS type FROM c WHERE len(p) > 0 AND length(t) > 50
  UNION ALL SELECT doc_id, i * 10 + 1, CASE WHEN {_con('substr(p[i], 1, 50)')} <> '' THEN 'What specific information is provided about ' || {_con('substr(p[i], 1, 50)')} || '?' ELSE 'What information is provided in the following context: ' || substr(p[i], 1, 50) || '?' END, p[i] || CASE WHEN i < len(p) THEN ' ' || p[i + 1] ELSE '' END, 'factual_detailed' FROM s
  UNION ALL SELECT doc_id, i * 10 + 2, CASE WHEN {_con('substr(p[i], 1, 30)')} <> '' AND {_con('substr(p[i - 1], 1, 30)')} <> '' THEN 'How does ' || {_con('substr(p[i], 1, 30)')} || ' relate to ' || {_con('substr(p[i - 1], 1, 30)')} || '?' ELSE 'How does the information ''' || substr(p[i], 1, 30) || '...'' connect to the previous context?' END, p[i - 1] || ' ' || p[i], 'contextual' FROM s WHERE i > 1
  UNION ALL SELECT doc_id, i * 10 + 3, 'What is mentioned about ' || {_con('p[i]')} || '?', p[i], 'keyword_based' FROM s WHERE {_con('p[i]')} <> ''
  UNION ALL SELECT doc_id, 1000, CASE WHEN {_con('substr(p[1], 1, 50)')} <> '' THEN 'What is the main theme related to ' || {_con('substr(p[1], 1, 50)')} || '?' ELSE 'What is the main theme discussed in this content?' END, substr(t, 1, 400), 'thematic' FROM c WHERE len(p) > 0 AND length(t) > 100),
cj AS (SELECT doc_id, text AS t, list_filter(list_transform(string_split(text, '。'), lambda s: trim(s, {WS})), lambda s: length(s) > 20) AS p FROM {source} WHERE NOT {_EN}),
sj AS (SELECT doc_id, p, unnest(range(1, least(len(p), 3) + 1)) AS i FROM cj WHERE len(p) > 0),
found AS (SELECT doc_id, i, p[i] AS x, p[i] AS said FROM sj UNION ALL SELECT doc_id, 0, substr(t, 1, 200), '' FROM cj WHERE len(p) > 0),
words AS (SELECT doc_id, i, said, unnest(regexp_extract_all(x, '{CANDIDATE_SQL}')) AS word, generate_subscripts(regexp_extract_all(x, '{CANDIDATE_SQL}'), 1) AS pos FROM found),
best AS (SELECT doc_id, i, said, word, row_number() OVER (PARTITION BY doc_id, i ORDER BY count(*) DESC, min(pos)) AS k FROM words WHERE length(word) > 1 GROUP BY doc_id, i, said, word),
j AS (
  SELECT doc_id, 0 AS o, 'このセクションにはどのような情報が含まれていますか？' AS question, substr(t, 1, 500) AS answer, 'comprehensive' AS type FROM cj WHERE len(p) > 0 AND length(t) > 50
  UNION ALL SELECT doc_id, i * 10 + 1, '「' || substr(p[i], 1, 30) || '」について詳しく説明してください。', p[i] || CASE WHEN i < len(p) THEN '。' || p[i + 1] ELSE '' END, 'factual_detailed' FROM sj
  UNION ALL SELECT doc_id, i * 10 + 1 + k, '「' || word || '」について何が述べられていますか？', said, 'keyword_based' FROM best WHERE i > 0 AND k <= 2
  UNION ALL SELECT cj.doc_id, 1000, CASE WHEN b.word IS NOT NULL THEN '「' || b.word || '」に関する主要テーマは何ですか？' ELSE 'この内容の主要テーマは何ですか？' END, substr(t, 1, 400), 'thematic'
    FROM cj LEFT JOIN best b ON b.doc_id = cj.doc_id AND b.i = 0 AND b.k = 1 WHERE len(p) > 0 AND length(t) > 100),
every AS (SELECT * FROM q UNION ALL SELECT * FROM j)"""


_RULE = f"WITH {_rule_sql('documents')}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS qa_idx FROM every), kept AS (SELECT * FROM r WHERE qa_idx < 4) "


def _rules(spark, sf):
    return qa.rule_qa_both(docs_of(spark, sf).select("doc_id", F.col("text").alias("chunk")), 4)


_RULE_PAIRS = _RULE + "SELECT doc_id, qa_idx, question, md5(answer) AS answer, type FROM kept"
_RULE_TYPES = _RULE + "SELECT type, count(*) AS n FROM kept GROUP BY type"
_RULE_FIRST = _RULE + "SELECT doc_id, qa_idx, question FROM (SELECT *, row_number() OVER (PARTITION BY substr(question, 1, 30) ORDER BY doc_id, qa_idx) AS k FROM kept) WHERE k = 1"


@query(_RULE_PAIRS)
def rule_qa(spark, sf):
    return _rules(spark, sf).select("doc_id", "qa_idx", "question", F.md5("answer").alias("answer"), "type")


@query(_RULE_TYPES)
def rule_qa_types(spark, sf):
    return _rules(spark, sf).groupBy("type").agg(F.count("*").alias("n"))


@query(_RULE_FIRST)
def qa_prefix_dedup(spark, sf):
    return qa.first_of_prefix(_rules(spark, sf).select("doc_id", "qa_idx", "question"), ["doc_id", "qa_idx"])


@query(_RULE_PAIRS)
def rule_qa_all(spark, sf):
    return rule_qa(spark, sf)


@query(_RULE_TYPES)
def rule_qa_types_all(spark, sf):
    return rule_qa_types(spark, sf)


@query(_RULE_FIRST)
def qa_prefix_dedup_all(spark, sf):
    return qa_prefix_dedup(spark, sf)


@query("WITH n AS (SELECT greatest(1, count(*) // 300) AS step, count(*) AS c FROM documents) SELECT doc_id FROM documents, n WHERE c <= 300 OR (doc_id % step = 0 AND doc_id < step * 300)")
def stride_sample(spark, sf):
    return qa.strided(docs_of(spark, sf), "doc_id", 300).select("doc_id")


@query(f"""WITH RECURSIVE {SEMANTIC}, num AS (SELECT row_number() OVER (ORDER BY doc_id, chunk_idx) - 1 AS g, chunk, count(*) OVER () AS total FROM semantic),
size AS (SELECT any_value(total) AS total, CASE WHEN any_value(total) > 300 THEN any_value(total) // 300 ELSE 1 END AS step FROM num), n AS (SELECT *, least(CASE WHEN total > 300 THEN 300 ELSE total END, (total + step - 1) // step) AS n_taken FROM size),
chosen AS (SELECT g AS doc_id, chunk AS text FROM num, n WHERE (g % step = 0 AND g < step * n_taken) OR (n_taken < n.total AND g BETWEEN n_taken AND n_taken + 49)), {_rule_sql('chosen')},
taken AS (SELECT every.*, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS k FROM every, n WHERE doc_id % step = 0 AND doc_id < step * n_taken),
firsts AS (SELECT type FROM (SELECT *, row_number() OVER (PARTITION BY substr(question, 1, 30) ORDER BY doc_id, k) AS p FROM taken WHERE k <= 4) WHERE p = 1),
further AS (SELECT type FROM (SELECT every.*, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS k FROM every, n WHERE n_taken < total AND doc_id BETWEEN n_taken AND n_taken + 49 AND (o < 20 OR o = 1000)) WHERE k <= 2 AND (SELECT count(*) FROM firsts) < 2 * (SELECT total FROM n))
SELECT type, count(*) AS n FROM (SELECT * FROM firsts UNION ALL SELECT * FROM further) GROUP BY type""")
def rule_pipeline_types(spark, sf):
    return pipelines.rule_pipeline(docs_of(spark, sf)).groupBy("type").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT doc_id // 5 AS batch, doc_id AS place, 1 + doc_id % 3 AS quota FROM documents), r AS (SELECT *, sum(quota) OVER (PARTITION BY batch ORDER BY place) AS until FROM q),
m AS (SELECT batch, unnest(range(0, 12)) AS ordinal FROM (SELECT DISTINCT batch FROM q)) SELECT m.batch, m.ordinal, r.place FROM m JOIN r ON m.batch = r.batch AND m.ordinal >= r.until - r.quota AND m.ordinal < r.until""")
def qa_redistribution(spark, sf):
    d = docs_of(spark, sf).select(F.floor(F.col("doc_id") / 5).alias("batch"), F.col("doc_id").alias("place"), (1 + F.col("doc_id") % 3).alias("quota"))
    made = d.select("batch").distinct().select("batch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(11).cast("bigint"))).alias("ordinal"))
    return qa.redistribute(d, made).select("batch", "ordinal", "place")


#: Documents as chunks of their own, three to a request.
_BATCHES = f"""WITH c AS (SELECT doc_id, text, {sql_tokens('text')} AS tokens, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents),
q AS (SELECT *, place // 3 AS batch, least(8, CASE WHEN tokens < 50 THEN 2 WHEN tokens < 100 THEN 3 WHEN tokens < 200 THEN 6 WHEN tokens < 300 THEN 7 ELSE 8 END) AS quota, row_number() OVER (PARTITION BY place // 3 ORDER BY place) AS k FROM c),
r AS (SELECT batch, count(*) AS n_chunks, sum(quota)::BIGINT AS wanted, 'Write ' || sum(quota)::BIGINT || ' question and answer pairs about the numbered texts below, as JSON with qa_pairs of question, answer, question_type (fact, reason, comparison or application).'
 || string_agg(chr(10) || chr(10) || '[' || k || ']' || chr(10) || CASE WHEN length(text) > CASE WHEN n = 1 THEN 2000 ELSE 1000 END THEN substr(text, 1, CASE WHEN n = 1 THEN 2000 ELSE 1000 END) || '...' ELSE text END, '' ORDER BY place) AS prompt
 FROM (SELECT *, count(*) OVER (PARTITION BY batch) AS n FROM q) GROUP BY batch)"""


def _document_chunks(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.lit(0).cast("bigint").alias("chunk_idx"), F.col("text").alias("chunk"), T.token_estimate(F.col("text")).alias("tokens"))


@query(_BATCHES + " SELECT batch, n_chunks, wanted, md5(prompt) AS prompt FROM r WHERE n_chunks > 1")
def batch_requests(spark, sf):
    asked = generation.requests_of(generation.batches(_document_chunks(spark, sf), 3))
    return asked.filter("n_chunks > 1").select("batch", F.col("n_chunks").cast("bigint").alias("n_chunks"), "wanted", F.md5("prompt").alias("prompt"))


@query(_BATCHES + """, u AS (SELECT q.*, r.n_chunks, r.prompt, sum(q.quota) OVER (PARTITION BY q.batch ORDER BY q.place) AS until FROM q JOIN r USING (batch)),
m AS (SELECT *, unnest(range((until - quota)::BIGINT, until::BIGINT)) AS ordinal FROM u)
SELECT doc_id, place, ordinal::BIGINT AS ordinal, 'question ' || ordinal || ' of ' || md5(prompt) AS question, 'answer ' || ordinal AS answer, CASE WHEN n_chunks > 1 THEN 'batch' ELSE 'single' END AS how FROM m""")
def batch_pairs(spark, sf):
    """Pairs of all documents from a stand-in writer, three documents to a request, dealt back by quota."""
    made = generation.generate(_document_chunks(spark, sf), DigestWriter(), generation.Ledger(spark), 3)
    return made.select("doc_id", "place", "ordinal", "question", "answer", "how")


_SENT = "list_filter(list_transform(string_split_regex(text, '[。！？.!?]+'), lambda s: trim(s, " + WS + ")), lambda s: s <> '')"
_METRICS = f"""
WITH b AS (SELECT doc_id, text, {_SENT} AS s, regexp_extract_all(text, '{TECH_SQL}') AS terms FROM documents),
m AS (SELECT doc_id, length(text) AS doc_length, {sql_tokens('text')} AS token_count, len(s) AS sentence_count, len(list_distinct(terms)) AS keyword_count, round(len(terms) / greatest(1, length(text) / 100.0::DOUBLE), 9) AS keyword_density,
 CASE WHEN len(s) > 1 THEN least(1, sqrt(greatest(0, list_sum(list_transform(s, lambda x: (length(x) * length(x))::DOUBLE)) / len(s) - pow(list_sum(list_transform(s, lambda x: length(x)::DOUBLE)) / len(s), 2))) / (list_sum(list_transform(s, lambda x: length(x)::DOUBLE)) / len(s))) * 0.3::DOUBLE ELSE 0 END AS shape,
 len(regexp_extract_all(text, '[、；：「」『』（）\\[\\]]')) AS marks FROM b),
f AS (SELECT *, round(least(1, shape + least(1, keyword_density / 5) * 0.4::DOUBLE + least(1, marks::DOUBLE / greatest(1, sentence_count)) * 0.3::DOUBLE), 9) AS complexity FROM m)
"""


@query(_METRICS + "SELECT doc_id, doc_length, token_count, sentence_count, keyword_count, round(keyword_density, 6) AS keyword_density, round(complexity, 6) AS complexity FROM f")
def document_metrics(spark, sf):
    return qa.document_metrics(docs_of(spark, sf)).withColumns({"keyword_density": F.round("keyword_density", 6), "complexity": F.round("complexity", 6)})


_LADDER = "CASE WHEN doc_length < 500 THEN 3 WHEN doc_length < 1000 THEN 5 WHEN doc_length < 2000 THEN 8 WHEN doc_length < 5000 THEN 12 WHEN doc_length < 10000 THEN 18 ELSE least(30, 18 + floor(log2(doc_length / 10000.0::DOUBLE) * 3)) END"


@query(_METRICS + f""", p AS (SELECT doc_id, token_count, ({_LADDER})::BIGINT AS base_count, CASE WHEN keyword_density > 4 AND complexity > 0.7 THEN 1.5::DOUBLE WHEN keyword_density > 2.5 OR complexity > 0.5 THEN 1.2::DOUBLE WHEN keyword_density < 1 AND complexity < 0.3 THEN 0.7::DOUBLE ELSE 1 END AS k FROM f),
a AS (SELECT *, greatest(3, floor(base_count * k))::BIGINT AS adjusted_count FROM p)
SELECT doc_id, base_count, adjusted_count, greatest(3, least(50, floor((adjusted_count + floor(token_count // 150 * 0.7::DOUBLE / 2.5::DOUBLE)) / 2)))::BIGINT AS optimal_count FROM a""")
def qa_planned_count(spark, sf):
    return qa.planned_count(qa.document_metrics(docs_of(spark, sf))).select("doc_id", "base_count", "adjusted_count", "optimal_count")


@query("SELECT doc_id, floor(greatest(0, 0.7::DOUBLE - least(1, (doc_id % 4) * 2.5::DOUBLE / greatest(1, length(text) // 200))) * length(text) / 500)::BIGINT AS more FROM documents")
def qa_missing_count(spark, sf):
    return docs_of(spark, sf).select("doc_id", qa.missing_count(F.length("text"), F.col("doc_id") % 4).alias("more"))


@query(f"SELECT doc_id, least(15, floor(floor(CASE WHEN d > 10 THEN 8 WHEN d > 5 THEN 6 ELSE 4 END * 1.5::DOUBLE) + 3 * 0.5::DOUBLE))::BIGINT AS n FROM (SELECT doc_id, len(list_distinct(regexp_extract_all(text, '{TERMS_SQL}')))::DOUBLE / (length(text) / 1000.0::DOUBLE) AS d FROM documents)")
def qa_hybrid_count(spark, sf):
    return docs_of(spark, sf).select("doc_id", qa.hybrid_count(F.col("text"), F.lit(3), True).alias("n"))


def _template_sql(k: int) -> str:
    """A word's k-th template question; the particle words never make a core concept."""
    of = {(d, c): q for d, c, *q in qa.TEMPLATES}
    return f"CASE WHEN difficulty = 'basic' THEN '{of['basic', None][k]}' WHEN difficulty = 'intermediate' THEN '{of['intermediate', None][k]}' WHEN category = 'technical_term' THEN '{of['advanced', 'technical_term'][k]}' ELSE '{of['advanced', None][k]}' END"


@query(_details_sql(5).replace("WITH ", f"WITH {_particles_sql()}, ", 1).replace("md5(b.best_context)", "b.best_context") + f""", kw AS (SELECT t.doc_id, t.word, w.first FROM t JOIN w USING (doc_id, word)), {_RELATIONS},
ends AS (SELECT doc_id, source AS word, target AS other, pos, relation_type FROM relations UNION ALL SELECT doc_id, target, source, pos, relation_type FROM relations),
near AS (SELECT doc_id, word, list(other ORDER BY pos, relation_type)[1:2] AS related FROM ends GROUP BY doc_id, word),
asked AS (SELECT d.doc_id, d.word, difficulty, category, best_context AS hint, related, unnest([1, 2]) AS k FROM details d LEFT JOIN near USING (doc_id, word))
SELECT doc_id, word, word || CASE k WHEN 1 THEN {_template_sql(0)} ELSE {_template_sql(1)} END AS question, difficulty,
 md5(CASE WHEN len(coalesce(related, [])) > 0 AND hint <> '' THEN hint || ' ' || CASE WHEN difficulty <> 'basic' THEN '関連する概念として、' || array_to_string(related, '、') || 'があります。' ELSE '' END WHEN hint <> '' THEN hint ELSE word || 'に関する説明' END) AS answer FROM asked""")
def qa_template_pairs(spark, sf):
    d = _with_particles(spark, sf)
    top = keywords.top_by_frequency(d, 5)
    asked = qa.template_questions(keywords.details(top.select("doc_id", "word"), d))
    return qa.template_pairs(asked, keywords.relations(top.select("doc_id", "word", "first"), d)).select("doc_id", "word", "question", F.md5("answer").alias("answer"), "difficulty")


@query(_details_sql(8) + """, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY context_importance DESC, word) AS place FROM details)
SELECT doc_id, word, word || CASE WHEN difficulty = 'basic' THEN 'とは何ですか？' WHEN difficulty = 'intermediate' THEN 'はどのように使われますか？' WHEN category = 'technical_term' THEN 'の技術的な詳細を説明してください。' ELSE 'の応用例を挙げてください。' END AS question FROM p WHERE place <= 5""")
def qa_hint_pairs(spark, sf):
    d = docs_of(spark, sf)
    return qa.hint_pairs(qa.template_questions(keywords.details(keywords.top_by_frequency(d, 8).select("doc_id", "word"), d))).select("doc_id", "word", "question")


# a Latin letter beyond ASCII is no word border here, as it would be in DuckDB's patterns
_GAP = "chr(10) || chr(10)"


@query(rf"""WITH c AS (SELECT doc_id, CASE WHEN contains(text, {_GAP}) THEN string_split(text, {_GAP}) ELSE list_transform(range(0, length(text), 400), lambda i: substr(text, i + 1, 500)) END AS p, regexp_extract_all(regexp_replace(text, '[ªµºÀ-ÖØ-öø-ɏ]', '_', 'g'), '{_CON}|[A-Z]{{2,}}') AS n, string_split_regex(text, '[。.!?]') AS s FROM documents),
d AS (SELECT doc_id, list_filter(p[1:4], lambda x: length(trim(x)) > 50) AS parts, list_filter(list_filter(n, lambda e, i: list_position(n, e) = i)[1:6], lambda e: len(list_filter(s, lambda x: contains(x, e))) > 0) AS names FROM c),
q AS (SELECT doc_id, 0 AS o, 'What is the main content of this document?' AS question, 'comprehensive' AS type, 1 AS layer FROM d
 UNION ALL SELECT doc_id, generate_subscripts(parts, 1), 'Explain the following: ''' || substr(unnest(parts), 1, 30) || '...''', 'paragraph_detail', 2 FROM d
 UNION ALL SELECT doc_id, 10 + generate_subscripts(names, 1), 'What is mentioned about ' || unnest(names) || '?', 'entity_specific', 3 FROM d)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS qa_idx, question, type, layer FROM q""")
def hierarchical_qa(spark, sf):
    return qa.hierarchical(docs_of(spark, sf)).select("doc_id", "qa_idx", "question", "type", "layer")


#: What words are made of, accented letters too, and the space between them.
_LETTER, _SPACE = r"\p{L}\p{N}_", r"\s+"


@query("WITH RECURSIVE " + SEMANTIC + f", c AS (SELECT doc_id, chunk_idx, regexp_extract(chunk, '(^|[^{_LETTER}])([A-Z][a-z]+(?:{_SPACE}[A-Z][a-z]+)*)($|[^{_LETTER}])', 2) AS concept, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS k FROM semantic) SELECT doc_id, chunk_idx, 'What does the text say about ' || concept || '?' AS question FROM c WHERE k <= 5 AND concept <> ''")
def qa_targeted(spark, sf):
    return qa.targeted(_chunks(spark, sf)).select("doc_id", "chunk_idx", "question")


@query(_QA + ", o AS (SELECT * FROM qa ORDER BY ordinal LIMIT 5) SELECT replace(question, '何ですか', '何ではありませんか') AS question, answer || 'ではないものを指します。' AS answer, 'adversarial_negation' AS type FROM o UNION ALL SELECT * FROM (VALUES ('この文書に書かれていない情報は何ですか？', '文書には含まれていない情報です。', 'out_of_context'), ('それは何を指していますか？', '文脈により異なります。', 'ambiguous_reference'))")
def qa_adversarial(spark, sf):
    return qa.adversarial(qa_pairs(spark, sf), "ordinal")


@query("SELECT * FROM (VALUES ('phase1', 'rule_based', 'high_confidence_facts', 10, 0.0::DOUBLE), ('phase2', 'template_based', 'entities_and_concepts', 15, 0.0::DOUBLE), ('phase3', 'llm_cheap', 'gap_filling', 20, 30.0::DOUBLE), ('phase4', 'llm_quality', 'complex_reasoning', 10, 50.0::DOUBLE), ('phase5', 'human_validation', 'quality_assurance', NULL, 20.0::DOUBLE)) t(phase, method, target, expected_qa, cost)")
def qa_budget_plan(spark, sf):
    return qa.budget_plan(spark, 100.0)


@query(_QA + """SELECT ordinal, round(least(1, CASE WHEN regexp_matches(question, '何|なぜ|どのように|いつ|どこ|だれ|どちら') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN length(answer) BETWEEN 20 AND 200 THEN 0.2::DOUBLE WHEN length(answer) BETWEEN 10 AND 300 THEN 0.1::DOUBLE ELSE 0 END
 + 0.2::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE + CASE WHEN length(answer) <= 100 THEN 0.1::DOUBLE ELSE 0 END), 6) AS score FROM qa""")
def qa_quality(spark, sf):
    pairs = qa_pairs(spark, sf).withColumns({"difficulty": F.lit("basic"), "keywords": F.array(F.lit("a")), "category": F.lit("other"), "suggested_length": F.lit("1-2文")})
    return pairs.select("ordinal", F.round(qa.quality(pairs), 6).alias("score"))


_SET = r"list_distinct(list_filter(string_split_regex(question, '\s+'), lambda s: s <> ''))"


@query(_QA + f""", t AS (SELECT min(ordinal) AS id, question, {_SET} AS s FROM qa GROUP BY question) SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard
FROM t a JOIN t b ON a.id < b.id WHERE len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) > 0.7::DOUBLE""")
def qa_jaccard_dups(spark, sf):
    return qa.similar_questions(qa_pairs(spark, sf), "ordinal")


@query(f"WITH {_words_sql()}, t AS ({_top_sql('n', 3)}) SELECT doc_id, word, word || q.e AS question, q.k AS type FROM t, (VALUES ('とは何ですか？', 'definition'), ('の特徴を教えてください', 'feature')) q(e, k)")
def qa_examples(spark, sf):
    return qa.example_questions(keywords.top_by_frequency(docs_of(spark, sf), 3).select("doc_id", "word"))


#: The test tables have no Japanese; these words stand in for the particles, so that the patterns find something.
_STAND_INS = ((" of ", "とは"), (" to ", "は"), (". ", "です。"), (" is ", "と呼ばれ"), (" in ", "には、"), (" and ", "、"), (" was ", "がある"))


def _stand_in_sql() -> str:
    out = "text"
    for a, b in _STAND_INS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"j AS (SELECT doc_id, {out} AS text FROM documents)"


def _groups_sql(pattern: str) -> str:
    return f"SELECT doc_id, trim(unnest(regexp_extract_all(text, '{pattern}', 1))) AS a, trim(unnest(regexp_extract_all(text, '{pattern}', 2))) AS b FROM j"


@query(f"""WITH {_stand_in_sql()}
SELECT doc_id, a || 'とは何ですか？' AS question, md5(a || 'とは' || b || 'です。') AS answer, 'definition' AS type, 0.9::DOUBLE AS confidence FROM ({_groups_sql(qa.DEFINED[0])})
UNION ALL SELECT doc_id, a || 'は何と呼ばれますか？', md5(b || 'と呼ばれます。'), 'terminology', 0.85::DOUBLE FROM ({_groups_sql(qa.CALLED[0])})
UNION ALL SELECT doc_id, a || 'には何がありますか？', md5(a || 'には、' || array_to_string(list_transform(string_split(b, '、'), lambda x: trim(x)), '、') || 'があります。'), 'enumeration', 0.8::DOUBLE FROM (SELECT doc_id, trim(unnest(regexp_extract_all(text, '{qa.LISTED[0]}', 1))) AS a, unnest(regexp_extract_all(text, '{qa.LISTED[0]}', 2)) AS b FROM j)""")
def qa_definitions(spark, sf):
    text = F.col("text")
    for a, b in _STAND_INS:
        text = F.replace(text, F.lit(a), F.lit(b))
    d = docs_of(spark, sf).withColumn("text", text)
    found = qa.definitions(d).unionByName(qa.enumerations(d).select("doc_id", "question", "answer", F.lit("enumeration").alias("type"), F.lit(0.8).alias("confidence")))
    return found.withColumn("answer", F.md5("answer"))


@query(_QA + "SELECT q.conv_id AS doc_id, question, answer FROM qa q")
def qa_flattened(spark, sf):
    from tesserae.sinks.writers import flattened

    nested = qa_pairs(spark, sf).groupBy("conv_id").agg(F.collect_list(F.struct("question", "answer")).alias("qa_pairs")).select(F.col("conv_id").alias("doc_id"), F.lit("").alias("doc_title"), F.lit(0).alias("text_length"), "qa_pairs")
    return flattened(nested).select("doc_id", "question", "answer")


@query(_QA + "SELECT min(ordinal) AS first, count(*) AS n FROM qa GROUP BY question")
def qa_question_groups(spark, sf):
    pairs = qa_pairs(spark, sf)
    return tables.qa_table(pairs, "ordinal").select("question").distinct().join(pairs.groupBy("question").agg(F.min("ordinal").alias("first"), F.count("*").alias("n")), "question").select("first", "n")


@query(_QA + f""", v AS (SELECT ordinal, question FROM qa UNION ALL SELECT ordinal + 500000, question || ' please' FROM qa WHERE conv_id % 2 = 0), s AS (SELECT ordinal, question, {_SET} AS s FROM v),
l AS (SELECT a.ordinal AS a, b.ordinal AS b FROM s a JOIN s b ON a.ordinal <> b.ordinal AND (a.question = b.question OR len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) > 0.7::DOUBLE)),
c AS (WITH RECURSIVE r AS (SELECT ordinal AS a, ordinal AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT a, min(b) AS class_id FROM r GROUP BY a)
SELECT s.ordinal, c.class_id, (SELECT count(*) FROM l WHERE l.a = s.ordinal) AS n_links FROM s JOIN c ON c.a = s.ordinal""")
def qa_duplicate_classes(spark, sf):
    """Near copies made for the purpose, as in qa_jaccard_variants."""
    asked = qa_pairs(spark, sf)
    again = asked.filter("conv_id % 2 = 0").select((F.col("ordinal") + 500000).alias("ordinal"), F.concat("question", F.lit(" please")).alias("question"))
    return duplicates.duplicate_classes(asked.select("ordinal", "question").unionByName(again))


@query(_QA + f""", v AS (SELECT ordinal, question FROM qa UNION ALL SELECT ordinal + 500000, question || ' please' FROM qa WHERE conv_id % 2 = 0), t AS (SELECT min(ordinal) AS id, question, {_SET} AS s FROM v GROUP BY question)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM t a JOIN t b ON a.id < b.id WHERE len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) > 0.7::DOUBLE""")
def qa_jaccard_variants(spark, sf):
    """Near copies made for the purpose: the questions of every second conversation again, with one word more."""
    asked = qa_pairs(spark, sf)
    again = asked.filter("conv_id % 2 = 0").select((F.col("ordinal") + 500000).alias("ordinal"), F.concat("question", F.lit(" please")).alias("question"))
    return qa.similar_questions(asked.select("ordinal", "question").unionByName(again), "ordinal")


@query(r"""WITH n AS (SELECT count(*) AS n_docs, ceil(count(*) / 10)::BIGINT AS llm_calls, 2 * ceil(count(*) / 150)::BIGINT AS embedding_calls FROM documents)
SELECT *, llm_calls + embedding_calls AS total_calls, round(1 - llm_calls::DOUBLE / greatest(1, n_docs), 6) AS llm_saved, round(1 - (llm_calls + embedding_calls)::DOUBLE / greatest(1, n_docs * 3), 6) AS total_saved FROM n""")
def batch_statistics(spark, sf):
    return pipelines.batch_statistics(docs_of(spark, sf))


_BAG = r"list_distinct(list_filter(string_split_regex(lower({}), '[\s.,;:!?。、！？]+'), lambda w: w <> ''))"


@query(_QA + f""", c AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id), p AS (SELECT q.ordinal, q.conv_id, question, answer, {_BAG.format('answer')} AS w, {_BAG.format('text')} AS t, first(answer) OVER (PARTITION BY q.conv_id, question ORDER BY q.ordinal) AS earlier FROM qa q JOIN c USING (conv_id)),
k AS (SELECT ordinal, len(w) > 0 AND len(list_intersect(w, t)) * 2 >= len(w) AS answer_found, length(question) >= 5 AND (contains(question, '?') OR regexp_matches(question, '？|何|なぜ|どのように|いつ|どこ|だれ|どちら')) AS question_clear, earlier = answer AS no_contradiction, length(answer) BETWEEN 10 AND 1000 AS appropriate_length FROM p)
SELECT *, (answer_found::INT + question_clear::INT + no_contradiction::INT + appropriate_length::INT) / 4 AS quality_score, answer_found AND question_clear AND no_contradiction AND appropriate_length AS valid FROM k""")
def qa_validated(spark, sf):
    """Each pair held against the whole text of its conversation."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    texts = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("x")).select("conv_id", F.array_join(F.transform("x", lambda t: t["text"]), " ").alias("text"))
    return qa.validated(qa_pairs(spark, sf), texts, "conv_id").select("ordinal", "answer_found", "question_clear", "no_contradiction", "appropriate_length", "quality_score", "valid")


@query("""SELECT conv_id, turn, 'r' || conv_id AS reply_id, 'stand-in' AS model, CASE WHEN turn % 3 = 0 THEN [text] ELSE [text, role] END AS texts, length(text)::BIGINT AS prompt_tokens, turn AS completion_tokens, CASE WHEN turn % 3 <> 0 THEN 'f' || conv_id END AS file_id, CASE WHEN turn % 3 = 0 THEN NULL ELSE 'file_search_call' END AS call_type FROM conversations""")
def reply_fields(spark, sf):
    """Replies made of the turns, with their texts in messages or, in each third, as plain output text, read back."""
    t = table(spark, sf, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    cite = F.array(F.struct(F.lit("file_citation").alias("type"), F.concat(F.lit("f"), "conv_id").alias("file_id"), F.lit("a.txt").alias("filename")))
    none = F.array().cast("array<struct<type:string,file_id:string,filename:string>>")
    said = lambda c, a: F.struct(F.lit("output_text").alias("type"), F.col(c).alias("text"), a.alias("annotations"))
    message = F.struct(F.lit("m").alias("id"), F.lit("message").alias("type"), F.array(said("text", cite), said("role", none)).alias("content"))
    call = F.struct(F.lit("c").alias("id"), F.lit("file_search_call").alias("type"), F.lit(None).cast("array<struct<type:string,text:string,annotations:array<struct<type:string,file_id:string,filename:string>>>>").alias("content"))
    plain = F.col("turn") % 3 == 0
    reply = F.struct(F.concat(F.lit("r"), "conv_id").alias("id"), F.lit("stand-in").alias("model"), F.when(~plain, F.array(call, message)).alias("output"), F.when(plain, F.col("text")).alias("output_text"), F.struct(F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens")).alias("usage"))
    stored = t.select("conv_id", "turn", "id", F.to_json(reply).alias("reply"))
    cited, calls = replies.citations(stored).select("id", "file_id"), replies.tool_calls(stored).select("id", F.col("type").alias("call_type"))
    every = stored.select("conv_id", "turn", "id").join(replies.fields(stored), "id").join(cited, "id", "left").join(calls, "id", "left")
    return every.select("conv_id", "turn", "reply_id", "model", "texts", "prompt_tokens", "completion_tokens", "file_id", "call_type")


@query(f"""WITH {_words_sql()}, t AS ({_top_sql(_SCORE, 30)}), k AS (SELECT doc_id, CASE WHEN length(text) < 100 THEN 3 WHEN length(text) < 300 THEN 5 WHEN length(text) < 500 THEN 7 + {_N100} WHEN length(text) < 1000 THEN 10 + CASE WHEN len(string_split_regex(text, '[。！？.!?]+')) > 10 THEN 2 ELSE 0 END
 WHEN length(text) < 2000 THEN 15 ELSE least(30, 20 + floor(log2(length(text) / 2000.0::DOUBLE))) END::BIGINT AS most FROM documents) SELECT t.doc_id, word, rank FROM t JOIN k USING (doc_id) WHERE rank <= most""")
def keyword_extracted(spark, sf):
    return keywords.extract(docs_of(spark, sf), "auto").select("doc_id", "word", "rank")


#: Stand-ins for what a tagger finds: each text's two most frequent words, a person and something else.
_ENTITY_TYPES = ("PERSON", "PLACE")


@query(f"""WITH {_words_sql()}, t AS ({_top_sql('n', 2)}), s AS (SELECT t.*, list_filter(list_transform(string_split_regex(text, '[。！？.!?]'), lambda x: trim(x, {WS})), lambda x: x <> '' AND contains(x, t.word)) AS held FROM t JOIN documents USING (doc_id))
SELECT doc_id, word AS entity, word || unnest(CASE rank WHEN 1 THEN {list(qa.ENTITY_QUESTIONS['PERSON'])} ELSE {list(qa.OTHER_QUESTIONS)} END) AS question, md5(held[1]) AS answer, 'entity_based' AS type FROM s WHERE len(held) > 0""")
def qa_entity_pairs(spark, sf):
    d = docs_of(spark, sf)
    found = keywords.top_by_frequency(d, 2).select("doc_id", F.col("word").alias("entity"), F.when(F.col("rank") == 1, _ENTITY_TYPES[0]).otherwise(_ENTITY_TYPES[1]).alias("entity_type"))
    return qa.entity_pairs(found, d).withColumn("answer", F.md5("answer"))


@query(f"""WITH {_words_sql()}, matched AS ({_W30}), weighed AS (SELECT doc_id, word, sum(weight) AS s, min(pos) AS first FROM matched WHERE length(word) > 1 GROUP BY doc_id, word), t AS ({_METHODS})
SELECT doc_id, word, string_agg(CASE method WHEN 0 THEN 'frequency' WHEN 1 THEN 'score' ELSE 'weighted' END, ',' ORDER BY method) AS methods FROM t GROUP BY doc_id, word""")
def keyword_methods_integrated(spark, sf):
    return keywords.methods_integrated(docs_of(spark, sf)).withColumn("methods", F.array_join("methods", ","))


@query(_PACK + f""", c AS (SELECT p.doc_id, p.grp AS chunk_idx, string_agg(k.s, ' ' ORDER BY k.i) AS chunk FROM p JOIN k USING (doc_id, i) GROUP BY p.doc_id, p.grp), d AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS doc_idx FROM documents)
SELECT 'livedoor_' || doc_idx || CASE WHEN coalesce(source, '') = '' THEN '' ELSE '_' || substr(source, 1, 30) END AS doc_id, doc_idx, chunk_idx, md5(chunk) AS chunk, {sql_tokens('chunk')} AS tokens FROM c JOIN d USING (doc_id)""")
def corpus_chunk_ids(spark, sf):
    """The source stands in for a title."""
    return pipelines.corpus_chunks(docs_of(spark, sf), "livedoor", "source").withColumn("chunk", F.md5("chunk")).drop("dataset_type")


@query(f"""WITH {_words_sql()}, t AS ({_top_sql('n', 4)}), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), c AS (SELECT doc_id, (doc_id % 5) / 4.0::DOUBLE AS rate FROM documents)
SELECT count(*) AS n_docs, sum(coalesce(n, 0))::BIGINT AS n_pairs, round(avg(coalesce(n, 0)), 6) AS avg_pairs, round(avg(rate), 6) AS avg_coverage, min(rate) AS min_coverage, max(rate) AS max_coverage FROM c LEFT JOIN n USING (doc_id)""")
def hybrid_figures(spark, sf):
    """The summary of a hybrid run, with keywords in place of pairs and a rate that follows from the id."""
    d = docs_of(spark, sf)
    return pipelines.hybrid_summary(keywords.top_by_frequency(d, 4), d.select("doc_id", (F.col("doc_id") % 5 / 4.0).alias("rate")))
