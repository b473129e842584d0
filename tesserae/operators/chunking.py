"""Cutting texts into chunks.

The folds that look back at their own output (packing, merging, sliding) are small per-text helpers run in
Arrow batches; everything that a built-in function can express stays in the JVM (``functions.text``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import clean_text, domain_of, token_estimate
from tesserae.operators.ordering import numbered_rows
from tesserae.session import small_batches

Chunk = tuple[str, str]  # text, kind
CHUNKS = "array<struct<text:string,kind:string,first:int,last:int>>"
_JA = re.compile(r"[぀-ヿ一-鿿]")
_BREAKS = (re.compile(r"(?<=[。．.!?])\s*"), re.compile(r"(?<=[。．？！?!])"))


def tokens(text: str) -> int:
    """The token estimate of ``functions.text``, for one text."""
    wide = sum(c > "\x7f" for c in text)
    return max(1, int(0.5 * wide + 0.25 * (len(text) - wide))) if text else 0


def in_japanese(text: str) -> bool:
    return _JA.search(text) is not None


def sentences(text: str, tagged: bool = False) -> list[str]:
    """Sentences by end marks; ``tagged`` uses the end marks of the tagger for texts that begin in Japanese."""
    ja = tagged and _JA.search(text[:100])
    return [s for s in (p.strip() for p in _BREAKS[bool(ja)].split(text)) if s]


def forced(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` estimated tokens, each as long as can be."""
    out, cost, begin = [], 0.0, 0
    for i, c in enumerate(text):
        step = 0.5 if c > "\x7f" else 0.25
        if cost + step >= limit + 1:
            out.append(text[begin:i])
            begin, cost = i, 0.0
        cost += step
    return [*out, text[begin:]] if text else []


def packed(parts: Iterable[str], limit: int) -> Iterator[tuple[list[str], int]]:
    """Groups of consecutive parts whose token estimates sum to the limit at most, with the place of each first part."""
    group: list[str] = []
    size = first = 0
    for i, p in enumerate(parts):
        n = tokens(p)
        if group and size + n > limit:
            yield group, first
            group, size = [], 0
        if not group:
            first = i
        group.append(p)
        size += n
    if group:
        yield group, first


def paragraph_chunks(text: str, limit: int = 200, tagged: bool = False) -> list[Chunk]:
    """Paragraphs; those over the limit as packs of sentences; sentences over the limit by force."""
    out: list[Chunk] = []
    for para in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text))):
        if tokens(para) <= limit:
            out.append((para, "paragraph"))
            continue
        run: list[str] = []
        for s in [*sentences(para, tagged), None]:
            if s is None or tokens(s) > limit:
                out += [("".join(g), "sentence_group") for g, _ in packed(run, limit)]
                out += [(f, "forced_split") for f in forced(s or "", limit)]
                run = []
            else:
                run.append(s)
    return out


def sentence_groups(text: str, limit: int = 200, tagged: bool = False) -> list[tuple[str, str, int, int]]:
    """Packs of sentences over the whole text, with the numbers of their first and last sentence."""
    return [(" ".join(g), "sentence_group", i, i + len(g) - 1) for g, i in packed(sentences(text, tagged), limit)]


def continued(chunks: list[tuple[str, str, int, int]], least: int = 50, ceiling: int = 300) -> list[tuple[str, str, int, int]]:
    """Chunks under ``least`` tokens join the one before where both stay under ``ceiling``."""
    out: list[tuple[str, str, int, int]] = []
    for text, kind, first, last in chunks:
        if out and tokens(text) < least and tokens(joined := f"{out[-1][0]} {text}") < ceiling:
            _, kind0, first0, _ = out[-1]
            out[-1] = (joined, kind0 if kind0 == kind else "merged", first0, last)
        else:
            out.append((text, kind, first, last))
    return out


def semantic_chunks(text: str, limit: int = 200, least: int = 50, by_paragraph: bool = True, tagged: bool = False) -> list[tuple[str, str, int, int]]:
    if by_paragraph:
        parts = [(t, k, 0, max(0, len(sentences(t, tagged)) - 1)) for t, k in paragraph_chunks(text, limit, tagged)]
    else:
        parts = sentence_groups(text, limit, tagged)
    return continued(parts, least)


#: How each language's long paragraphs are divided, and what joins the parts again.
_DIVIDE = {"ja": (re.compile(r"(?<=[。！？\n])"), ""), "en": (re.compile(r"(?<=[.!?])\s+(?=[A-Z])"), " ")}


def packed_paragraphs(text: str, lang: str, limit: int = 500) -> list[str]:
    """Paragraphs packed up to the limit; one over it by sentences, whose rest goes on with the next paragraph."""
    pattern, glue = _DIVIDE[lang]
    out: list[str] = []
    held, size = "", 0
    for para in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text))):
        n = tokens(para)
        if size + n <= limit:
            held, size = (f"{held}\n\n{para}" if held else para), size + n
            continue
        if held:
            out.append(held)
        held, size = para, n
        if n > limit:
            held, size = "", 0
            for s in pattern.split(para):
                m = tokens(s)
                if held and (m > limit or size + m > limit):
                    out.append(held.strip())
                    held, size = "", 0
                if m > limit:
                    out += [f for f in map(str.strip, forced(s, limit)) if f]
                else:
                    held, size = (held + glue + s if held else s), size + m
    return [*out, held] if held else out


def sliding(text: str, size: int = 1000, overlap: int = 100) -> list[str]:
    """Overlapping windows that end at a sentence mark where one stands in the second half."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            marks = (text.rfind(m, at, end) for m in "。！？.!?")
            end = next((k + 1 for k in marks if k > at + size // 2), end)
        if piece := text[at:end].strip():
            out.append(piece)
        at = max(at + 1, end - overlap)
    return out


def translation_segments(text: str, limit: int) -> list[str]:
    """Lines packed up to the limit; a line over it is cut by its tokens, at a line break past two thirds if any."""
    out: list[str] = []
    run: list[str] = []
    for line in [*text.splitlines(keepends=True), None]:
        if line is None or tokens(line) > limit:
            out += ["".join(g) for g, _ in packed(run, limit)]
            run, rest = [], line or ""
            while rest:
                piece = forced(rest, limit)[0]
                cut = piece.rfind("\n")
                piece = piece[: cut + 1] if cut > len(piece) * 2 // 3 else piece
                out.append(piece)
                rest = rest[len(piece) :]
        else:
            run.append(line)
    return out


def chunk_table(docs: DataFrame, make: Callable[[str], list[tuple]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chunk_idx, chunk, kind, first, last, tokens: every chunk that ``make`` cuts from each text."""

    small_batches(docs.sparkSession)  # a batch's texts and chunks are in a worker's memory together

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [[(*c, "text", 0, 0)[:4] if len(c) == 1 else (*c, 0, 0)[:4] for c in make(t.as_py() or "")] for t in b.column(1)]
            kinds = pa.list_(pa.struct([("text", pa.string()), ("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
            yield pa.record_batch([b.column(0), pa.array([[dict(zip(("text", "kind", "first", "last"), c)) for c in m] for m in made], kinds)], names=["id", "chunks"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, chunks {CHUNKS}")
    out = rows.select(F.col("id").alias(id_col), F.posexplode("chunks").alias("chunk_idx", "c"))
    return out.select(id_col, F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.col("c.text").alias("chunk"), "c.kind", "c.first", "c.last", token_estimate(F.col("c.text")).alias("tokens"))


def as_chunks(texts: Callable[..., list[str]], *args: object) -> Callable[[str], list[tuple]]:
    return lambda t: [(c,) for c in texts(t, *args)]


def merge_small(chunks: DataFrame, least: int = 150, most: int = 400, id_col: str = "doc_id") -> DataFrame:
    """Consecutive small chunks of a document joined by a blank line up to ``most`` tokens; big ones stand alone.

    A document's chunks meet in one group; the fold over them is Python, its state one open chunk.
    """

    def fold(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("chunk_idx").to_pylist(), table.column("chunk").to_pylist(), table.column("tokens").to_pylist()))
        out: list[list] = []
        open_ = False
        for idx, text, n in rows:
            if n >= least:
                out.append([text, n, idx, idx, 1])
                open_ = False
            elif open_ and out[-1][1] + n <= most:
                out[-1] = [f"{out[-1][0]}\n\n{text}", out[-1][1] + n, out[-1][2], idx, out[-1][4] + 1]
            else:
                out.append([text, n, idx, idx, 1])
                open_ = True
        text, n, lo, hi, parts = zip(*out)
        span = [str(a) if a == b else f"{a}-{b}" for a, b in zip(lo, hi)]
        ids = pa.array(table.column(id_col).to_pylist()[:1] * len(out), table.schema.field(id_col).type)
        return pa.table([ids, pa.array(lo, pa.int64()), pa.array(span), pa.array(text), pa.array(n, pa.int64()), pa.array(parts, pa.int64())], names=[id_col, "chunk_idx", "chunk_span", "chunk", "tokens", "n_original"])

    kind = dict(chunks.dtypes)[id_col]
    return chunks.groupBy(id_col).applyInArrow(fold, f"{id_col} {kind}, chunk_idx bigint, chunk_span string, chunk string, tokens bigint, n_original bigint")


def store_entries(lines: DataFrame, dataset: str, size: int = 2000, overlap: int = 100, max_chunks: int = 4000, max_mb: float = 30.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Entries for a vector store, cut where the number or the running size of entries reaches its limit.

    The running size is summed in two steps, within ranges and over the ranges, so that no task sees all
    rows. The entry that crosses the size limit is the last one kept.
    """
    cleaned = lines.select(id_col, clean_text(F.col(text_col), False).alias("text")).filter("text <> ''")
    parts = chunk_table(cleaned, as_chunks(sliding, size, overlap), id_col, "text")
    total = parts.groupBy(id_col).agg(F.count("*").alias("total_chunks"))
    name = F.concat_ws("_", F.lit(dataset), F.col(id_col), F.col("chunk_idx"))
    meta = F.struct(F.lit(dataset).alias("dataset"), F.col(id_col).alias("original_line"), "chunk_index", "total_chunks", domain_of(F.lit(dataset)).alias("domain"))
    out = parts.join(total, id_col).withColumn("chunk_index", F.col("chunk_idx")).select(id_col, "chunk_idx", name.alias("entry_id"), F.col("chunk").alias("text"), meta.alias("metadata"))
    out = out.withColumn("entry_size", F.length(F.to_json(F.struct(F.col("entry_id").alias("id"), "text", "metadata"))))
    return running_cut(out, [id_col, "chunk_idx"], "entry_size", max_chunks, int(max_mb * (1 << 20)))


def unified_entries(sets: dict[str, DataFrame], size: int = 2000, overlap: int = 100, max_mb: float = 100.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Entries of several sets for one store: place, source_dataset, entry_id, text, metadata, entry_size.

    sets: name -> id, text, in the order in which they go in. If all entries together are over ``max_mb``, as many of the
    first ones stay as make up 90 % of it by the entries' average size.
    """
    every = None
    for no, (name, lines) in enumerate(sets.items()):
        cleaned = lines.select(id_col, clean_text(F.col(text_col), False).alias("text")).filter("text <> ''")
        parts = chunk_table(cleaned, as_chunks(sliding, size, overlap), id_col, "text")
        total = F.count("*").over(Window.partitionBy(id_col))  # the chunks of one line
        one = parts.withColumn("total_chunks", total).select(F.lit(no).alias("set_no"), F.lit(name).alias("source_dataset"), id_col, "chunk_idx", F.col("chunk").alias("text"), "total_chunks")
        every = one if every is None else every.unionByName(one)
    meta = F.struct(F.col("source_dataset").alias("dataset"), F.col(id_col).alias("original_line"), F.col("chunk_idx").alias("chunk_index"), "total_chunks")
    entries = every.select("set_no", "source_dataset", id_col, "chunk_idx", F.concat_ws("_", F.lit("unified_all"), "source_dataset", F.col(id_col), "chunk_idx").alias("entry_id"), "text", meta.alias("metadata"))
    entries = entries.withColumn("entry_size", F.length(F.to_json(F.struct(F.col("entry_id").alias("id"), "text", "metadata"))))
    placed = numbered_rows(entries, ["set_no", id_col, "chunk_idx"], "place")
    n, bytes_ = placed.agg(F.count("*"), F.coalesce(F.sum("entry_size"), F.lit(0))).first()
    limit = max_mb * (1 << 20)
    kept = placed.filter(F.col("place") < int(n * 0.9 * limit / bytes_)) if bytes_ > limit else placed
    return kept.select("place", "source_dataset", "entry_id", "text", "metadata", "entry_size")


def running_cut(rows: DataFrame, order: list[str], size_col: str, max_rows: int, max_size: int) -> DataFrame:
    """The first rows in order until max_rows are kept or their sizes pass max_size; the row that passes it is the last one."""
    placed = numbered_rows(rows, order, "place", size_col=size_col)
    return placed.filter((F.col("place") < max_rows) & (F.col("sum_size") - F.col(size_col) <= max_size)).drop("place")
