"""Classes of near-equal questions: a set-similarity join that counts links in place of listing pairs.

Two different questions are linked if the Jaccard similarity of their word sets is over ``least``. Sets that similar
share one of the first few words of each, rarest first, so questions meet by those words. A pair is looked at only
under the first word that both have there. Lengths, the places of the shared word and the difference of two 64-bit
word signatures (which no two sets can exceed that differ in fewer words) rule pairs out before any sets are
compared. A word with very many questions is a triangle of cells, each two blocks of questions.

A cell answers with numbers of links and a spanning forest of them, so that a cluster of n variants costs n rows, and
rows with the same question are one row with a count throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.graph import connected_components
from tesserae.operators.skew import join_skewed
from tesserae.staging import discard, staged

#: Questions of a block, and rows that one shard of cells should hold.
BLOCK, SHARD_ROWS = 1024, 20_000
#: Words whose membership is multiplied at a time.
STEP = 4096


def _members(rows: np.ndarray, words: np.ndarray, n: int, n_words: int) -> np.ndarray:
    out = np.zeros((n, n_words), np.float32)
    out[rows, words] = 1
    return out


def _shared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], na: int, nb: int) -> np.ndarray:
    """How many words each row of a shares with each row of b; a and b as (row, word) lists."""
    words, at = np.unique(np.concatenate((a[1], b[1])), return_inverse=True)
    wa, wb = at[: len(a[1])], at[len(a[1]) :]
    total = np.zeros((na, nb), np.float32)
    for k in range(0, len(words), STEP):
        ia, ib = (wa >= k) & (wa < k + STEP), (wb >= k) & (wb < k + STEP)
        total += _members(a[0][ia], wa[ia] - k, na, STEP) @ _members(b[0][ib], wb[ib] - k, nb, STEP).T
    return total


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places is linked to over links a-b."""
    labels = np.arange(n)
    while True:
        low = np.minimum(labels[a], labels[b])
        then = labels.copy()
        np.minimum.at(then, labels[a], low)
        np.minimum.at(then, labels[b], low)
        then = then[then]
        if (then == labels).all():
            return labels
        labels = then


def _cell(words: pa.ListArray, pos: np.ndarray, sig: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (places in left, places in right) of a cell; words are hashes in the common order, pos the shared word's place."""
    size = words.value_lengths().to_numpy().astype(np.int64)
    na, nb, pa_, pb = size[left, None], size[None, right], pos[left, None], pos[None, right]
    need = least / (1 + least) * (na + nb)  # words shared by two sets of these sizes that are similar enough
    may = (np.minimum(na, nb) > least * np.maximum(na, nb)) & (np.minimum(na - pa_, nb - pb) > need - 1e-9)
    may &= np.bitwise_count(sig[left, None] ^ sig[None, right]) < na + nb - 2 * need + 1e-9
    i, j = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
    if not len(i):
        return i, j
    offsets, flat = words.offsets.to_numpy(), words.values.to_numpy()

    def listed(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first n words of each row as (place of the row, word)."""
        row = np.repeat(np.arange(len(rows)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return row, flat[np.repeat(offsets[rows], n) + within]

    ri, rj = left[i], right[j]
    both = _shared(listed(ri, size[ri]), listed(rj, size[rj]), len(i), len(j))
    earlier = _shared(listed(ri, pos[ri]), listed(rj, pos[rj]), len(i), len(j))
    linked = may[np.ix_(i, j)] & (both / (size[ri, None] + size[None, rj] - both).astype(np.float64) > least) & (earlier == 0)
    x, y = np.nonzero(linked)
    return i[x], j[y]


def _search(rows: DataFrame, least: float) -> DataFrame:
    """rows: shard, w, bi, bj, mine (the row's block), t, copies, words, pos, sig. -> t, links, to (the smallest of those it hangs together with here)."""

    def run(table: pa.Table) -> pa.Table:
        w, bi, bj, mine, t, copies, pos = (table.column(c).to_numpy() for c in ("w", "bi", "bj", "mine", "t", "copies", "pos"))
        sig, words = table.column("sig").to_numpy().view(np.uint64), table.column("words").combine_chunks()
        order = np.lexsort((t, bj, bi, w))
        new = np.concatenate(([True], (np.diff(w[order]) != 0) | (np.diff(bi[order]) != 0) | (np.diff(bj[order]) != 0)))
        edges = np.append(np.flatnonzero(new), len(order))
        out_t, out_links, out_to = [], [], []
        for lo, hi in zip(edges[:-1], edges[1:]):
            g = order[lo:hi]
            same = bi[g[0]] == bj[g[0]]
            left, right = (g, g) if same else (g[mine[g] == bi[g[0]]], g[mine[g] == bj[g[0]]])
            if not len(left) or not len(right):
                continue
            x, y = _cell(words, pos.astype(np.int64), sig, left, right, least)
            if same:
                x, y = x[x < y], y[x < y]
            if not len(x):
                continue
            a, b = left[x], right[y]
            who, at = np.unique(np.concatenate((a, b)), return_inverse=True)
            links = np.bincount(at, weights=np.concatenate((copies[b], copies[a]))).astype(np.int64)
            label = _forest(len(who), at[: len(a)], at[len(a) :])
            out_t.append(t[who])
            out_links.append(links)
            out_to.append(t[who][label])
        cat = lambda v: np.concatenate(v) if v else np.empty(0, np.int64)
        return pa.table({"t": cat(out_t), "links": cat(out_links), "to": cat(out_to)})

    return rows.groupBy("shard").applyInArrow(run, "t bigint, links bigint, to bigint")


def duplicate_classes(qa: DataFrame, id_col: str = "ordinal", text_col: str = "question", least: float = 0.7) -> DataFrame:
    """id, class_id (smallest id that links reach, itself included), n_links (other rows with an equal or a linked question).

    Words are what white space divides; a null question is an empty one. Questions without words are linked to equal ones
    only. Word hashes of 64 bits stand for words. ``id`` is a whole number; rows with the same id are rows of their own.
    """
    question = F.coalesce(F.col(text_col), F.lit(""))
    rows = qa.select(F.col(id_col).cast("bigint").alias("id"), F.sha2(question, 256).alias("sha"), question.alias("q"))
    words = F.array_distinct(F.filter(F.split("q", r"(?U)\s+"), lambda w: w != ""))
    texts = staged(rows.groupBy("sha", "q").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("words", F.transform(words, lambda w: F.xxhash64(w))).drop("q"), "questions")
    said = texts.select(F.xxhash64("sha").alias("t"), F.explode("words").alias("w"))
    freq = staged(said.groupBy("w").agg(F.count("*").alias("f")), "question-words")
    total = freq.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    ordered = join_skewed(said, freq, ["w"], "f", total, "t").groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "w"))), lambda x: x["w"]).alias("words"))
    keyed = staged(texts.drop("words").withColumn("t", F.xxhash64("sha")).join(ordered, "t"), "question-sets")
    bits = F.aggregate("words", F.lit(0).cast("bigint"), lambda a, w: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(w, F.lit(64)).cast("int"))))
    first = F.slice("words", F.lit(1), (F.size("words") - F.floor(F.size("words") * least)).cast("int"))
    prefix = keyed.withColumn("sig", bits).select("t", "copies", "words", "sig", F.posexplode(first).alias("pos", "w"))
    met = staged(prefix.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1"), "question-meetings")
    total_met = met.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = join_skewed(prefix, met, ["w"], "n", total_met, "t").filter("n IS NOT NULL").withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("mine", F.pmod(F.xxhash64("t"), F.col("blocks")))
    cells = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda k: F.struct(F.least("mine", k).alias("bi"), F.greatest("mine", k).alias("bj")))
    each = dealt.withColumn("cell", F.explode(cells)).select("w", "cell.bi", "cell.bj", "mine", "t", "copies", "words", "pos", "sig")
    shards = max(1, total_met // SHARD_ROWS)
    # a cell has at most about two blocks of rows, so cells of one word lie in different shards
    found = staged(_search(each.withColumn("shard", F.pmod(F.xxhash64("w", "bi", "bj"), F.lit(shards))), least), "question-links")
    linked = found.groupBy("t").agg(F.sum("links").alias("links"))
    nodes = texts.select(F.xxhash64("sha").alias("t"), "sha", "rep", "copies")
    classes = connected_components(found.filter(F.col("t") != F.col("to")).select(F.col("t").alias("a"), F.col("to").alias("b")), nodes.select(F.col("t").alias("node"), F.col("rep").alias("id")))
    told = nodes.join(linked, "t", "left").join(classes.withColumnRenamed("node", "t"), "t", "left")
    told = staged(told.select("sha", F.coalesce("component", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), "copies"), "question-classes")
    n_rows = told.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    out = join_skewed(rows.select("id", "sha"), told, ["sha"], "copies", n_rows, "id")
    discard(freq, met)
    return out.select(F.col("id").alias(id_col), "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
