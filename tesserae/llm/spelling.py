"""Spelling variants: words one edit apart, found by two-dimensional range reporting over wavelet trees.

Sort the words of one length forwards and backwards. A word is then a point (forward rank, backward rank), the words
that begin like a given one are an interval of the first order, those that end like it an interval of the second.
An edit at a position leaves what stands before it and what stands after it, so the words that an edit there can give
are the points in the rectangle of two intervals, which a wavelet tree over the points reports in logarithmic time
each. All words and positions of a shard go through the tree's levels together, as arrays; positions at which no
interval changes are asked once.

An edit at a position of range a..b leaves the word's first a and its last letters from b on, so near words meet
by hash of those; with two ranges (the word's halves) every word is sent to four places at most. Meeting places with
very many words have their ranges halved, again and again if need be; at a single position a place has at most one
word for each letter (and for each letter a longer one), which bounds it at any size of input.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, drop_table, small_batches

#: Words kept: code points at least, occurrences at least; a form has at least so many times a word's occurrences.
LEAST_LETTERS, LEAST_SEEN, TIMES = 7, 2, 10
#: One in so many runs of letters (by a hash of document and run) loses a letter: typing errors planted in the text.
PLANTED = 31
#: Different words that a task counts before it passes counts on; rows and bytes that a shard should hold; rows beyond
#: which a meeting place is divided (more on large inputs, so that fewer than 100,000 places can be).
COUNTED, SHARD_ROWS, SHARD_BYTES, HOT = 500_000, 100_000, 16 << 20, 20_000


def _planted(run: bytes, id_crc: int) -> bytes:
    """The lower-cased run (Latin-1), without one letter where the hash of its document and itself says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), id_crc)
    return run if h % PLANTED else run[: (at := h % len(run))] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the runs of letters A-Z, a-z, U+00C0 to U+00FF of whole texts, A-Z lower-cased, after planted errors.

    Only words of LEAST_LETTERS or more seen LEAST_SEEN times or more. Null texts have none, a null id counts as the
    empty string, repeated rows count again. Every task adds up what it sees, COUNTED words at a time.
    """
    small_batches(docs.sparkSession)
    letters = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST_LETTERS)  # shorter runs stay short whatever is deleted

    def flush(seen: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        seen.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for i in range(b.num_rows):
                # what Latin-1 does not have becomes '?', which like it is no letter
                text = (b.column(1)[i].as_py() or "").encode("latin-1", "replace").lower()
                id_crc = zlib.crc32(f"{b.column(0)[i].as_py() or ''}:".encode())
                for found, n in Counter(letters.findall(text)).items():
                    word = _planted(found, id_crc)
                    if len(word) >= LEAST_LETTERS:
                        seen[word] += n
                if len(seen) >= COUNTED:
                    yield flush(seen)
        yield flush(seen)

    narrow = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_SEEN)


class WaveletTree:
    """A permutation's wavelet tree, stored level by level as counts of the zeros before each place."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros, self.n_zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            low = (values >> level & 1) == 0
            self.zeros.append(np.concatenate(([0], np.cumsum(low))))
            self.n_zeros.append(int(self.zeros[-1][-1]))
            values = np.concatenate((values[low], values[~low]))

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query i the values in [least, past) at places [lo, hi): (i, value) of every one."""
        query, value = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for level, (zeros, n_zeros) in enumerate(zip(self.zeros, self.n_zeros)):
            half = 1 << (self.bits - 1 - level)
            lo0, hi0 = zeros[lo], zeros[hi]
            left = (lo0 < hi0) & (value < past[query]) & (value + half > least[query])
            lo1, hi1 = n_zeros + lo - lo0, n_zeros + hi - hi0
            up = value + half
            right = (lo1 < hi1) & (up < past[query]) & (up + half > least[query])
            query, value = np.concatenate((query[left], query[right])), np.concatenate((value[left], up[right]))
            lo, hi = np.concatenate((lo0[left], lo1[right])), np.concatenate((hi0[left], hi1[right]))
        return query, value


class _Order:
    """The rows of a matrix of letters in order, and for any length the interval of indexed rows that share that many first letters."""

    def __init__(self, rows: np.ndarray, indexed: np.ndarray):
        width = rows.shape[1]
        self.order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
        ranked = rows[self.order]
        differ = ranked[1:] != ranked[:-1]
        self.shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        self.place = np.empty(len(rows), np.int64)
        self.place[self.order] = np.arange(len(rows))
        self.before = np.concatenate(([0], np.cumsum(indexed[self.order])))

    def intervals(self, length: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the rows ``of``: ranks [lo, hi) among the indexed rows."""
        edges = np.concatenate(([0], np.flatnonzero(self.shared < length) + 1, [len(self.order)]))
        at = np.searchsorted(edges, self.place[of], "right")
        return self.before[edges[at - 1]], self.before[edges[at]]


def _matrix(words: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(-1, width)


def _shared_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def near_words(index: list[bytes], longer: list[bytes], first: int, past: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of index words that differ in one letter at a position in [first, past), and pairs (k, j) of a
    longer word and the index word that it becomes without its letter at such a position.

    index: distinct words of one length; longer: distinct words of one letter more. Pairs of the first kind come in
    both directions. A longer word that loses any of several equal letters has its edit at the last of them.
    """
    none = np.empty(0, np.int64)
    if not index:
        return none, none, none, none
    width, n = len(index[0]), len(index)
    x = _matrix(index, width)
    y = _matrix(longer, width + 1) if longer else np.empty((0, width + 1), np.uint8)
    is_index = np.arange(n + len(y)) < n
    forward = _Order(np.concatenate((x, y[:, :width])), is_index)
    backward = _Order(np.concatenate((x[:, ::-1], y[:, :0:-1])), is_index)
    by_forward, by_backward = (o.order[o.order < n] for o in (forward, backward))
    backward_rank = np.empty(n, np.int64)
    backward_rank[by_backward] = np.arange(n)
    tree = WaveletTree(backward_rank[by_forward])

    def asked(of: np.ndarray, rest: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """rest: letters of the suffix at position 0. Positions between which no interval changes are asked once."""
        turns = np.concatenate(([first], forward.shared + 1, rest - backward.shared))
        left, right = [none], [none]
        for p in np.unique(turns[(turns >= first) & (turns < past) & (turns <= rest)]):
            lo, hi = forward.intervals(p, of)
            low, high = backward.intervals(rest - p, of)
            some = np.flatnonzero((hi - lo >= least) & (high - low >= least))
            if len(some):
                q, value = tree.report(lo[some], hi[some], low[some], high[some])
                left.append(some[q])
                right.append(by_backward[value])
        return np.concatenate(left), np.concatenate(right)

    i, j = asked(np.arange(n), width - 1, 2)  # a word is always found itself
    apart = i != j
    i, j = i[apart], j[apart]
    k, m = asked(np.arange(n, n + len(y)), width, 1)
    k, m = np.unique(np.stack((k, m)), axis=1) if len(k) else (k, m)
    keep = np.ones(len(k), bool)
    step = max(1, SHARD_BYTES // (width + 1))
    for s in range(0, len(k), step):
        at = _shared_prefix(y[k[s : s + step], :width], x[m[s : s + step]])
        keep[s : s + step] = (at >= first) & (at < past)
    return i, j, k[keep], m[keep]


def _best(own: np.ndarray, other: np.ndarray, words: list[str], seen: np.ndarray) -> Iterator[tuple[str, int, int, str]]:
    """For each word of ``own`` its partners: how many, and the one seen most (the first in order among equals)."""
    by_word = np.empty(len(words), np.int64)
    by_word[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(words))
    order = np.lexsort((by_word[other], -seen[other], own))
    own, other = own[order], other[order]
    heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else own
    for a, size in zip(heads, np.diff(np.append(heads, len(own)))):
        yield words[own[a]], int(size), int(seen[other[a]]), words[other[a]]


def _search(table: pa.Table) -> pa.Table:
    """One shard: every range of every word length through a wavelet tree of its own."""
    words, seen = table.column("word").to_pylist(), table.column("n").to_numpy()
    kinds: dict[tuple[int, int, int], tuple[list[int], list[int]]] = {}
    for at, (w, width, a, b) in enumerate(zip(words, *(table.column(c).to_pylist() for c in ("width", "a", "b")))):
        kinds.setdefault((width, a, b), ([], []))[len(w) > width].append(at)
    out: list[tuple[str, int, int, str]] = []
    for (width, a, b), (index, longer) in kinds.items():
        coded = [[words[k].encode("latin-1") for k in rows] for rows in (index, longer)]
        i, j, k, m = near_words(*coded, a, b + (b == width))
        index_at, longer_at = np.array(index, np.int64), np.array(longer, np.int64)
        own = np.concatenate((index_at[i], longer_at[k], index_at[m]))
        other = np.concatenate((index_at[j], index_at[m], longer_at[k]))
        local = np.unique(np.concatenate((own, other)))
        put = lambda v: np.searchsorted(local, v)
        out += _best(put(own), put(other), [words[v] for v in local], seen[local])
    cols = list(zip(*out)) or [[], [], [], []]
    return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("word", "n_near", "form_n", "form"), cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))})


def _meeting(rows: DataFrame) -> DataFrame:
    """With ``key``: a hash of what an edit in the row's range leaves of its word."""
    after = F.col("b") + (F.length("word") - F.col("width"))
    left = F.substring(F.col("word"), F.lit(1), F.col("a"))
    return rows.withColumn("key", F.xxhash64("width", "a", "b", left, F.substring(F.col("word"), after + 1, F.length("word"))))


def _ranges(*cuts: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")) for a, b in cuts])


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, form_n, form: how many words differ from a word by one inserted, deleted or replaced letter, and
    which of them is seen most (ties: the first by code point). words: word (letters below U+0100), n; distinct.
    """
    small_batches(words.sparkSession)
    size = F.length("word")
    both = F.array(size, size - 1)  # among words as long as itself, and as a word with one letter too many
    rows = words.select("word", "n", F.explode(both).alias("width")).withColumn("h", (F.col("width") / 2).cast("int"))
    rows = rows.withColumn("r", F.explode(_ranges((F.lit(0), F.col("h")), (F.col("h"), F.col("width"))))).select("word", "n", "width", "r.a", "r.b")
    found, made = None, []
    while True:
        rows = _meeting(rows)
        total, n_bytes = rows.agg(F.count("*"), F.sum(F.length("word"))).first()
        hot_n = max(HOT, (total or 0) // 100_000)
        hot = rows.groupBy("key").agg(F.count("*").alias("members"), F.max(F.col("b") - F.col("a")).alias("span")).filter((F.col("members") > hot_n) & (F.col("span") > 1)).select("key")
        hot = cut(hot, "spelling-hot")  # fewer than 100,000 keys: each holds over a 100,000th of the rows
        made.append(hot)
        any_hot = bool(hot.take(1))
        cold = rows.join(F.broadcast(hot), "key", "left_anti") if any_hot else rows
        shards = max(1, (total or 0) // SHARD_ROWS, (n_bytes or 0) // SHARD_BYTES)
        here = cold.select("word", "n", "width", "a", "b", F.pmod("key", F.lit(shards)).alias("shard")).groupBy("shard").applyInArrow(_search, "word string, n_near bigint, form_n bigint, form string")
        found = here if found is None else found.unionAll(here)
        if not any_hot:
            break
        middle = F.expr("(a + b) div 2")
        divided = rows.join(F.broadcast(hot), "key", "left_semi").drop("key").withColumn("r", F.explode(_ranges((F.col("a"), middle), (middle, F.col("b")))))
        rows = cut(divided.select("word", "n", "width", "r.a", "r.b"), "spelling-divided")
        made.append(rows)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    out = cut(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form"), "spelling-near")
    for table in made:
        drop_table(table)
    return out


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts (see ``word_counts``).

    A word's form is the near word seen most (ties: the first by code point) if that is seen at least TIMES as often
    as itself, else null; its root is reached by following forms to the last. Each step multiplies what is seen, so
    paths are short; they are followed by doubling. No word: an empty result.
    """
    words = cut(word_counts(docs, id_col, text_col), "spelling-words")
    near = neighbours(words)
    formed = F.col("form_n") >= TIMES * F.col("n")
    every = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n"))
    every = cut(every, "spelling-forms")
    links = cut(every.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = links.join(onward, "root", "left")
        then = cut(met.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        drop_table(links)
        links = then.select("word", "root")
        if not then.filter("moved").take(1):
            break
    return every.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
