"""DuckDB SQL with the meaning of the chunking operators: folds as recursions over a document's parts."""

from __future__ import annotations

from tesserae.plans.registry import WS, sql_clean, sql_sentences, sql_tokens


def sql_wide(c: str) -> str:
    """Characters beyond ASCII."""
    return rf"length(regexp_replace({c}, '[\x00-\x7F]', '', 'g'))"


def _fits(s: str, limit: int) -> str:
    """Characters of the longest beginning of at most ``limit`` estimated tokens."""
    return f"list_max(list_filter(range(1, least(length({s}), {4 * limit + 4}) + 1), lambda x: 0.25::DOUBLE * x + 0.25::DOUBLE * {sql_wide(f'substr({s}, 1, x)')} < {limit + 1}))"


def packed_parts(limit: int) -> str:
    """From parts (doc_id, u: place from 0, pi, kind: whole, part or long, s, n): packs (doc_id, u, grp) and pieces (doc_id, u, j, piece) of the long ones.

    Parts of one ``pi`` are packed in order up to the limit; whole and long ones stand alone.
    """
    same = f"parts.kind = 'part' AND packs.size IS NOT NULL AND packs.pi = parts.pi AND packs.size + parts.n <= {limit}"
    return f"""packs AS (SELECT doc_id, u, pi, CASE WHEN kind = 'part' THEN n END AS size, 0::BIGINT AS grp FROM parts WHERE u = 0
 UNION ALL SELECT parts.doc_id, parts.u, parts.pi, CASE WHEN parts.kind <> 'part' THEN NULL WHEN {same} THEN packs.size + parts.n ELSE parts.n END, CASE WHEN {same} THEN packs.grp ELSE packs.grp + 1 END
 FROM packs JOIN parts ON parts.doc_id = packs.doc_id AND parts.u = packs.u + 1),
rests AS (SELECT doc_id, u, 0 AS j, s AS rest, {_fits('s', limit)} AS fit FROM parts WHERE kind = 'long'
 UNION ALL SELECT doc_id, u, j + 1, rest, {_fits('rest', limit)} FROM (SELECT doc_id, u, j, substr(rest, fit + 1) AS rest FROM rests WHERE length(rest) > fit)),
pieces AS (SELECT doc_id, u, j, substr(rest, 1, fit) AS piece FROM rests)"""


def _parts(rows: str, limit: int) -> str:
    """parts of single paragraphs from rows (doc_id, list)."""
    return f"""listed AS ({rows}), parts AS (SELECT doc_id, u - 1 AS u, 0 AS pi, CASE WHEN {sql_tokens('s')} > {limit} THEN 'long' ELSE 'part' END AS kind, s, {sql_tokens('s')} AS n
 FROM (SELECT doc_id, unnest(list) AS s, generate_subscripts(list, 1) AS u FROM listed))"""


def paragraph_chunks_sql(source: str = "documents", limit: int = 200) -> str:
    """chunks (doc_id, chunk_idx, chunk, kind) of source (doc_id, text)."""
    return rf"""paras AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS pi FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: trim(x, {WS})), lambda x: x <> '') AS l FROM {source})),
cutup AS (SELECT doc_id, pi, 0 AS si, 'whole' AS kind, p AS s FROM paras WHERE {sql_tokens('p')} <= {limit}
 UNION ALL SELECT doc_id, pi, si, CASE WHEN {sql_tokens('s')} > {limit} THEN 'long' ELSE 'part' END, s FROM (SELECT doc_id, pi, unnest({sql_sentences('p')}) AS s, generate_subscripts({sql_sentences('p')}, 1) AS si FROM paras WHERE {sql_tokens('p')} > {limit})),
parts AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pi, si) - 1 AS u, pi, kind, s, {sql_tokens('s')} AS n FROM cutup),
{packed_parts(limit)},
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp, j) - 1 AS chunk_idx, chunk, kind FROM (
 SELECT doc_id, grp, 0 AS j, string_agg(s, '' ORDER BY u) AS chunk, CASE WHEN any_value(kind) = 'whole' THEN 'paragraph' ELSE 'sentence_group' END AS kind FROM packs JOIN parts USING (doc_id, u) WHERE kind <> 'long' GROUP BY doc_id, grp
 UNION ALL SELECT doc_id, grp, j, piece, 'forced_split' FROM pieces JOIN packs USING (doc_id, u)))"""


PARAGRAPH_CHUNKS = f"""WITH RECURSIVE {paragraph_chunks_sql()}
SELECT doc_id, chunk_idx, chunk, kind, 0 AS first, 0 AS last, {sql_tokens('chunk')} AS tokens FROM chunks"""

#: The semantic chunks of cleaned texts: semantic (doc_id, chunk_idx, chunk, kind, tokens).
SEMANTIC = f"""cleaned AS (SELECT doc_id, {sql_clean('text')} AS text FROM documents), {paragraph_chunks_sql('cleaned')},
sized AS (SELECT *, length(chunk) AS len, {sql_wide('chunk')} AS wide, {sql_tokens('chunk')} AS n FROM chunks),
runs AS (SELECT doc_id, chunk_idx, kind, len, wide, 0::BIGINT AS grp FROM sized WHERE chunk_idx = 0
 UNION ALL SELECT doc_id, chunk_idx, CASE WHEN NOT join_it THEN kind WHEN kind = kind0 THEN kind ELSE 'merged' END, CASE WHEN join_it THEN len0 + 1 + len ELSE len END, CASE WHEN join_it THEN wide0 + wide ELSE wide END, grp0 + (NOT join_it)::INT
 FROM (SELECT s.*, r.kind AS kind0, r.len AS len0, r.wide AS wide0, r.grp AS grp0, s.n < 50 AND greatest(1, floor(0.25::DOUBLE * (r.len + 1 + s.len + r.wide + s.wide))) < 300 AS join_it FROM runs r JOIN sized s ON s.doc_id = r.doc_id AND s.chunk_idx = r.chunk_idx + 1)),
semantic AS (SELECT *, {sql_tokens('chunk')} AS tokens FROM (SELECT doc_id, grp AS chunk_idx, string_agg(chunk, ' ' ORDER BY chunk_idx) AS chunk, arg_max(runs.kind, chunk_idx) AS kind FROM runs JOIN sized USING (doc_id, chunk_idx) GROUP BY doc_id, grp))"""

#: Packs of sentences over whole texts, then the merge of small ones.
MERGE_SMALL = f"""WITH RECURSIVE s AS (SELECT doc_id, unnest({sql_sentences('text')}) AS s, generate_subscripts({sql_sentences('text')}, 1) - 1 AS i FROM documents), k AS (SELECT doc_id, i, s, {sql_tokens('s')} AS n FROM s),
p AS (SELECT doc_id, i, n AS size, 0::BIGINT AS grp FROM k WHERE i = 0
 UNION ALL SELECT k.doc_id, k.i, CASE WHEN p.size + k.n > 200 THEN k.n ELSE p.size + k.n END, CASE WHEN p.size + k.n > 200 THEN p.grp + 1 ELSE p.grp END FROM p JOIN k ON k.doc_id = p.doc_id AND k.i = p.i + 1),
c AS (SELECT doc_id, chunk_idx, {sql_tokens('chunk')} AS n FROM (SELECT p.doc_id, p.grp AS chunk_idx, string_agg(k.s, ' ' ORDER BY k.i) AS chunk FROM p JOIN k USING (doc_id, i) GROUP BY p.doc_id, p.grp)),
m AS (SELECT doc_id, chunk_idx, n, n AS total, n < 150 AS open, 0::BIGINT AS g FROM c WHERE chunk_idx = 0
 UNION ALL SELECT c.doc_id, c.chunk_idx, c.n, CASE WHEN c.n < 150 AND m.open AND m.total + c.n <= 400 THEN m.total + c.n ELSE c.n END, c.n < 150, CASE WHEN c.n < 150 AND m.open AND m.total + c.n <= 400 THEN m.g ELSE m.g + 1 END FROM m JOIN c ON c.doc_id = m.doc_id AND c.chunk_idx = m.chunk_idx + 1)
SELECT doc_id, min(chunk_idx) AS chunk_idx, CASE WHEN count(*) = 1 THEN min(chunk_idx)::VARCHAR ELSE min(chunk_idx) || '-' || max(chunk_idx) END AS chunk_span, sum(n)::BIGINT AS tokens, count(*) AS n_original FROM m GROUP BY doc_id, g"""


def packed_paragraph_sql(lang: str, limit: int = 500) -> str:
    """For texts of one paragraph, which the test tables' all are."""
    marks, glue = {"en": (r"'([.!?])\s+([A-Z])', '\1' || chr(1) || '\2'", " "), "ja": (r"'([。！？\n])', '\1' || chr(1)", "")}[lang]
    rows = f"SELECT doc_id, CASE WHEN {sql_tokens('t')} <= {limit} THEN [t] ELSE list_filter(string_split(regexp_replace(t, {marks}, 'g'), chr(1)), lambda x: x <> '') END AS list FROM (SELECT doc_id, trim(text, {WS}) AS t FROM documents) WHERE t <> ''"
    return f"""WITH RECURSIVE {_parts(rows, limit)}, {packed_parts(limit)}, ends AS (SELECT doc_id, max(u) AS last_u FROM parts GROUP BY doc_id),
made AS (SELECT doc_id, grp, 0 AS j, CASE WHEN max(u) = any_value(last_u) THEN string_agg(s, '{glue}' ORDER BY u) ELSE trim(string_agg(s, '{glue}' ORDER BY u), {WS}) END AS chunk FROM packs JOIN parts USING (doc_id, u) JOIN ends USING (doc_id) WHERE kind <> 'long' GROUP BY doc_id, grp
 UNION ALL SELECT doc_id, grp, j, trim(piece, {WS}) FROM pieces JOIN packs USING (doc_id, u) WHERE trim(piece, {WS}) <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp, j) - 1 AS chunk_idx, {sql_tokens('chunk')} AS tokens FROM made"""


TRANSLATION_SEGMENTS = f"""WITH RECURSIVE {_parts("SELECT doc_id, regexp_extract_all(text, '[^" + chr(92) + "n]*" + chr(92) + "n|[^" + chr(92) + "n]+') AS list FROM documents", 400)}, {packed_parts(400)},
made AS (SELECT doc_id, grp, 0 AS j, string_agg(s, '' ORDER BY u) AS chunk FROM packs JOIN parts USING (doc_id, u) WHERE kind <> 'long' GROUP BY doc_id, grp UNION ALL SELECT doc_id, grp, j, piece FROM pieces JOIN packs USING (doc_id, u))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp, j) - 1 AS chunk_idx, {sql_tokens('chunk')} AS tokens FROM made"""
