"""Language-model scores by logistic context mixing, beside a smoothed unigram base.

Five bit predictors look at a text's UTF-8 bytes. Three know how often each byte followed a context in the
whole training fold: the last byte, a hash of the last three, and a hash of the current word so far. From the
counts every node of the byte's binary tree (eight bits, first bit first) has a log-odds, the predictor's
answer. The fourth remembers the text itself: which byte last followed a hash of the last five. The fifth
remembers the corpus: at places that the text alone decides (about one in 257 bytes) it looks up, by a 64-bit
hash of the 24 bytes before, how the training fold went on from there, and foretells that byte by byte until
it is wrong once. Its table has a row for each such place, so it grows with the input.

The answers are summed with the weights that a gate, the bit's place in its byte, selects, and squashed to a
probability. The weights start from common values and are refined online while a text is read, block by block
(32 bytes, then doubling), by the gradient of its own bits; the fourth predictor's memory is refined with them.
Each text starts anew and is worked on in widths that follow from its own length, so that scores do not depend
on order, neighbours or partitions. Before each byte, and at the end, the model also says whether the text ends.

A training text does not foretell itself: the fifth predictor tells it only how other texts went on.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import compress, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, drop_table, id_crc, small_batches

#: Contexts of a hashed predictor of fixed size; of the last byte there are 256.
BITS = 15
SLOTS = 1 << BITS
#: Start of each such predictor's rows in the common table: last byte, last three bytes, word so far.
BASES = (0, 256, 256 + SLOTS)
ROWS = 256 + 2 * SLOTS
#: Letters of a word that its context tells apart; further on in a word, all share one context.
WORD_BYTES = 64
#: Bytes before a window of a long text that its contexts can depend on.
LOOK = WORD_BYTES + 1
#: Log-odds are kept in steps of 1/UNIT in one signed byte.
UNIT = 14
#: Each predictor's weight before a text is read, and the step of its refinement; the weights' bounds.
START = np.array([0.1, 0.6, 0.5, 0.3, 1.0], np.float32)
RATE, CALM = 0.7, 64
LEAST, MOST = -0.5, 2.0
#: Bytes of a text's first block; each block is twice as long as the one before, up to the last figure.
FIRST_BLOCK, LAST_BLOCK = 32, 1024
#: Blocks of a long text, and bytes of short texts together, that are held at a time.
WINDOW_BLOCKS, GROUP = 128, 1 << 17
#: Bytes that are worked on at a time in all texts together.
AT_ONCE = 1 << 14
#: Slots of the memory of the text itself.
OWN_BITS = 12
#: Bytes of context at a place of the corpus predictor, distance within which a place is the only one, and the
#: bytes it foretells at most.
ORDER, APART, AHEAD = 24, 128, 1024
#: Log-odds of its answer by the bytes foretold rightly so far (below 8, below 32, more), and what two agreeing
#: occurrences add.
TRUST = (1.5, 3.0, 4.5)
AGREED = 1.5
#: The most frequent training tokens, HEAVY different ones at most (about 50 MB), are looked up in a broadcast table;
#: the others meet their counts in a shuffle.
HEAVY = 300_000
#: A place over 1/HOT of all places is looked up by broadcast, in a table of fewer than HOT rows.
HOT = 1000
#: Tokens a worker counts before it passes the counts on.
FLUSH = 300_000
#: End costs are summed as whole numbers of 1/EXACT bits.
EXACT = 1 << 32
_APART = b"\0" * 5
_GAP = np.zeros(256, bool)
_GAP[[0, 9, 10, 11, 12, 13, 32]] = True
_M1, _M2 = np.uint32(2654435761), np.uint32(0x9E3779B1)
_K = np.uint64(0x9E3779B97F4A7C15)


class Contexts:
    """For each byte of x (texts apart by five zero bytes) what the predictors look at; zeros stand before it."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        u = np.zeros(n + 5, np.uint32)
        u[5:] = x
        p1, p2, p3 = u[4 : n + 4], u[3 : n + 3], u[2 : n + 2]
        three = p1 | (p2 << 8) | (p3 << 16)
        #: the last four bytes, and a hash of the last five
        self.tag = three | (u[1 : n + 1] << 24)
        self.own = (((self.tag * _M1) ^ (u[:n] * _M2)) * _M2 >> (32 - OWN_BITS)).astype(np.int32)
        three *= _M1
        three >>= 32 - BITS
        # the word so far: a sum of scrambled (letter, place in word), which restarts after white space
        gap = _GAP.take(p1, mode="clip")
        at = np.arange(n, dtype=np.uint32)
        start = np.maximum.accumulate(at * gap)
        at -= start
        far = at > WORD_BYTES
        at *= _M2
        at ^= p1 * _M1
        at *= _M2
        at *= ~gap
        run = np.cumsum(at, dtype=np.uint32)
        run -= run.take(start, mode="clip")
        run *= _M1
        run >>= 32 - BITS
        run[far] = 0
        #: rows of the common table
        self.rows = [p1.astype(np.int32), three.astype(np.int32) + BASES[1], run.astype(np.int32) + BASES[2]]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end with _APART after each, and where each begins."""
    sizes = np.array([len(t) + len(_APART) for t in texts])
    return np.frombuffer(_APART.join([*texts, b""]), np.uint8), np.cumsum(sizes) - sizes


def _windows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, whether a byte is only context) of all texts: short ones together, long ones in overlapping windows."""
    group: list[bytes] = []
    held = 0
    for t in [*(t for t in texts if 0 < len(t) <= GROUP), None]:
        if group and (t is None or held + len(t) > GROUP):
            x, begin = _joined(group)
            skip = np.zeros(len(x), bool)
            ends = begin + [len(g) for g in group]
            for k in range(len(_APART)):
                skip[ends + k] = True
            yield x, skip
            group, held = [], 0
        if t is not None:
            group.append(t)
            held += len(t)
    for t in (t for t in texts if len(t) > GROUP):
        for a in range(0, len(t), GROUP):
            b = max(0, a - LOOK)
            yield (x := np.frombuffer(t, np.uint8, min(GROUP, len(t) - a) + a - b, b)), np.arange(len(x)) < a - b


#: How often a byte was seen in a context, as a task notes it.
_SEEN = np.dtype([("byte", np.uint8), ("n", "<u4")])


def corpus_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Of the training fold (token, c), and a written table of what each task saw: row, seen (bytes and their counts, as _SEEN).

    A document's tokens are its lower-cased words and one end, written as the empty string. A row is one of the common
    table; after all of these comes one with the ends of texts, by the last byte.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        counts, one = np.zeros((ROWS + 1) * 256, np.uint32), np.uint32(1)
        ends, new = np.zeros(256, np.int64), 0
        names = ["token", "c", "row", "seen"]

        def tokens() -> pa.RecordBatch:
            k = [w.decode("utf-8", "replace") for w in words]
            b = pa.record_batch([pa.array(k, pa.string()), pa.array(words.values(), pa.int64()), pa.nulls(len(k), pa.int32()), pa.nulls(len(k), pa.binary())], names=names)
            words.clear()
            return b

        def seen() -> Iterator[pa.RecordBatch]:
            counts[ROWS * 256 :] = ends
            for a in range(0, ROWS + 1, 1 << 14):
                part = counts[a * 256 : (a + (1 << 14)) * 256]
                hit = np.flatnonzero(part)
                told = np.empty(len(hit), _SEEN)
                told["byte"], told["n"] = hit & 255, part[hit]
                rows, first = np.unique(hit >> 8, return_index=True)
                offsets = pa.py_buffer((np.append(first, len(hit)) * _SEEN.itemsize).astype(np.int32))
                cells = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(told.tobytes())])
                yield pa.record_batch([pa.nulls(len(rows), pa.string()), pa.nulls(len(rows), pa.int64()), pa.array((rows + a).astype(np.int32)), cells], names=names)
            counts[:] = 0
            ends[:] = 0

        for b in batches:
            texts = b.column(0).cast(pa.binary()).fill_null(b"").to_pylist()
            for t in texts:
                words.update(t.lower().split())
                ends[t[-1] if t else 0] += 1
                if len(words) >= FLUSH:
                    yield tokens()
            words[b""] += len(texts)
            for x, skip in _windows(texts):
                new += len(x)
                for rows in Contexts(x).rows:
                    rows[skip] = ROWS
                    np.add.at(counts, (rows << 8) | x, one)
            if new >= 1 << 31:  # so that no count outgrows its four bytes
                new = 0
                yield from seen()
        yield tokens()
        yield from seen()

    parts = docs.filter(id_crc(id_col) % 7 != 2).select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "token string, c bigint, row int, seen binary")
    parts = cut(parts, "lm-parts")
    return cut(parts.filter("token IS NOT NULL").groupBy("token").agg(F.sum("c").alias("c")), "lm-tokens"), parts


def log_odds(counts: np.ndarray) -> np.ndarray:
    """counts: (contexts, 256). Of each context and tree node the log-odds in steps of 1/UNIT; 0 where nothing was seen."""
    tree = np.zeros((len(counts), 512), np.float32)
    tree[:, 256:] = counts
    for node in range(255, 0, -1):
        tree[:, node] = tree[:, 2 * node] + tree[:, 2 * node + 1]
    out = np.zeros((len(counts), 256), np.int8)
    out[:, 1:] = np.clip(np.rint(np.log((tree[:, 3::2] + 0.2) / (tree[:, 2::2] + 0.2)) * UNIT), -127, 127)
    return out


def common_table(seen: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-odds by row and node, cost of going on and cost of ending in bits by last byte) from what the tasks saw.

    The counts of a row come to its task one after the other, are summed as they come, and made into log-odds; the
    driver gets ROWS rows of 256 bytes, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
            own = table * (rows[:, None] < ROWS)
            told = [(o if r < ROWS else n).tobytes() for r, o, n in zip(rows, log_odds(own), table)]
            return pa.record_batch([pa.array(rows.astype(np.int32)), pa.array(told, pa.binary()), pa.array(own.sum(axis=1))], names=["row", "odds", "n"])

        held_row, held = np.empty(0, np.int64), np.zeros((0, 256), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            rows, at = np.unique(np.concatenate((held_row, b.column(0).to_numpy())), return_inverse=True)
            size = pa.compute.binary_length(b.column(1)).to_numpy() // _SEEN.itemsize
            told = np.frombuffer(b"".join(b.column(1).to_pylist()), _SEEN)
            table = np.zeros((len(rows), 256), np.int64)
            table[at[: len(held)]] = held
            np.add.at(table.reshape(-1), np.repeat(at[len(held) :], size) * 256 + told["byte"], told["n"])
            if len(rows) > 1:
                yield made(rows[:-1], table[:-1])
            held_row, held = rows[-1:], table[-1:]  # the next batch may go on with it
        if len(held):
            yield made(held_row, held)

    got = seen.filter("row IS NOT NULL").select("row", "seen").repartition("row").sortWithinPartitions("row").mapInArrow(run, "row int, odds binary, n bigint").toArrow()
    table, rows, told = np.zeros((ROWS + 1, 256), np.int8), got.column("row").to_numpy(), got.column("odds").to_pylist()
    went, ended = np.zeros(256), np.zeros(256)
    for r, o, n in zip(rows.tolist(), told, got.column("n").to_pylist()):
        if r < ROWS:
            table[r] = np.frombuffer(o, np.int8)
            if r < 256:
                went[r] = n
        else:
            ended[:] = np.frombuffer(o, np.int64)
    p = (ended + 0.01) / (went + ended + 1)
    return table, -np.log2(1 - p), -np.log2(p)


_NODES = (1 << np.arange(8)) | (np.arange(256)[:, None] >> (8 - np.arange(8)))
_BITS_OF = (np.arange(256)[:, None] >> (7 - np.arange(8))) & 1


def paths(table: np.ndarray) -> np.ndarray:
    """For each row and byte the eight answers on the way to the byte, positive where they speak for it, as one word."""
    out = np.empty((len(table), 256, 8), np.int8)
    sign = (2 * _BITS_OF - 1).astype(np.int8)
    for a in range(0, len(table), 1024):
        np.multiply(table[a : a + 1024, _NODES], sign, out=out[a : a + 1024])
    return out.view(np.uint64).reshape(-1)


def _guesses() -> np.ndarray:
    """Words as in ``paths`` for a foretold byte: level (0: none; the last: the text's own memory), byte, byte that came."""
    differs = _BITS_OF[:, None, :] != _BITS_OF[None, :, :]
    before = np.cumsum(differs, axis=2) - differs
    sure = np.where(before > 0, 0, np.where(differs, -1, 1))
    levels = (0, *TRUST, *(t + AGREED for t in TRUST), 1)
    return np.stack([np.rint(sure * v * UNIT) for v in levels]).astype(np.int8).view(np.uint64).reshape(-1)


GUESSES = _guesses()
OWN_LEVEL = 2 * len(TRUST) + 1
#: Level of a foretold byte by the bytes foretold rightly before it, without and with agreement.
_LEVELS = [(np.searchsorted((8, 32), np.arange(AHEAD), side="right") + 1 + more).astype(np.int32) << 8 for more in (0, len(TRUST))]


def _eights(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    w = x.astype(np.uint64)
    for k in (1, 2, 4):
        w = w[:-k] | (w[k:] << np.uint64(8 * k))
    return w


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _K
    return h ^ (h >> np.uint64(29))


def places_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes of the ORDER bytes before them) that the corpus predictor looks up in a text.

    A place's eight bytes before it have the smallest hash of all places at most APART away; of equal hashes there is none.
    """
    places, hashes = [], []
    for a in range(ORDER, len(data), GROUP):
        lo, hi = max(ORDER, a - APART), min(len(data), a + GROUP + APART)
        eights = _eights(np.frombuffer(data, np.uint8, hi - lo + ORDER - 1, lo - ORDER))
        v = _mixed(eights[ORDER - 8 :] * _K)
        n = len(v)  # places lo to hi - 1
        least = np.full(n + 2 * APART, ~np.uint64(0))
        least[APART : n + APART] = v
        k = 1
        while k < APART:  # least[i] becomes the minimum of APART values from i on
            least[: len(least) - k] = np.minimum(least[: len(least) - k], least[k:])
            k *= 2
        at = np.flatnonzero((v < least[:n]) & (v < least[APART + 1 : n + APART + 1]))
        at = at[(at + lo >= a) & (at + lo < a + GROUP)]
        h = _mixed(_mixed(_mixed(eights[at]) + eights[at + 8]) + eights[at + 16])
        places.append(at + lo)
        hashes.append(h.view(np.int64))
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.empty(0, np.int64), np.empty(0, np.int64))


def _all_places(docs: DataFrame) -> DataFrame:
    """docs: doc_id, tag, held_out, text. One row for each place: doc_id, tag, held_out, place, h; of training texts what follows and its hash c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, at, hashes, own, tails = [], [], [], [], []
            for i, (t, held) in enumerate(zip(b.column(3).cast(pa.binary()).fill_null(b"").to_pylist(), b.column(2).to_pylist())):
                places, h = places_of(t)
                which.append(np.full(len(places), i))
                at.append(places)
                hashes.append(h)
                if held:
                    tails += [None] * len(places)
                else:
                    ends = np.minimum(np.append(places[1:], len(t)), places + AHEAD)
                    tails += [t[p:q] for p, q in zip(places.tolist(), ends.tolist())]
            own = np.fromiter((0 if x is None else xxhash.xxh64_intdigest(x) for x in tails), np.uint64, len(tails))
            row = pa.array(np.concatenate(which) if which else np.empty(0, np.int64))
            cols = [*(b.column(k).take(row) for k in range(3)), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(hashes)), pa.array(own.view(np.int64)), pa.array(tails, pa.binary())]
            yield pa.record_batch(cols, names=["doc_id", "tag", "held_out", "place", "h", "c", "next"])

    return docs.mapInArrow(run, "doc_id bigint, tag bigint, held_out boolean, place int, h bigint, c bigint, next binary")


def _name() -> Column:
    """Names a text, to tell which occurrences are its own; rows that repeat whole are one text."""
    return F.xxhash64("doc_id", "tag")


def _ends(table: DataFrame) -> DataFrame:
    """h, k, and of both ends the text's name, the continuation's hash and the continuation."""
    return table.select("h", "k", *[F.col(f"{end}.{c}").alias(f"{end}_{c}") for end in ("lo", "hi") for c in ("o", "c", "next")])


def foretold(docs: DataFrame) -> DataFrame:
    """docs: doc_id, tag, held_out, text. Per doc_id and tag a list of (place, agreed, bytes) that the training fold foretells.

    Of all occurrences of a place's hash in the training fold two are kept, those of the texts with the smallest and
    the largest name hash. A text is told the first's continuation, a training text whose own the first is the
    second's, and nothing where both are its own: which one it is told follows from names alone, never from how it
    goes on itself. Two continuations of other texts that go on alike agree.
    """
    every = cut(_all_places(docs), "lm-places")
    places, trained = every.select("doc_id", "tag", "held_out", "place", "h"), every.filter(~F.col("held_out"))
    hot = places.groupBy("h").agg(F.count("*").alias("k")).filter(F.col("k") > places.count() / HOT).select("h")
    hot = cut(hot, "lm-hot")
    at = F.struct(_name().alias("o"), "place", "c", "next")
    table = lambda rows: _ends(rows.groupBy("h").agg(F.count("*").alias("k"), F.min(at).alias("lo"), F.max(at).alias("hi")))
    # few keys with very many rows: their table is broadcast; of the others both sides are dealt by h once
    rest = places.join(F.broadcast(hot), "h", "left_anti").join(table(trained.join(F.broadcast(hot), "h", "left_anti")), "h")
    met = rest.unionByName(places.join(F.broadcast(cut(table(trained.join(F.broadcast(hot), "h", "left_semi")), "lm-hot-table")), "h"))
    own = lambda end: ~F.col("held_out") & (_name() == F.col(f"{end}_o"))
    told = F.when(~own("lo"), F.col("lo_next")).when(~own("hi"), F.col("hi_next"))
    agreed = (F.col("k") > 1) & ~own("lo") & ~own("hi") & (F.col("lo_c") == F.col("hi_c"))
    out = cut(met.filter(told.isNotNull()).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("place", agreed.alias("agreed"), told.alias("next"))).alias("told")), "lm-told")
    drop_table(every)
    return out


def guess_of(data: bytes, told: list[tuple[int, bool, bytes]], out: np.ndarray) -> None:
    """Write level and foretold byte (level << 8 | byte) into ``out``, as far as each continuation holds and one byte on."""
    x = np.frombuffer(data, np.uint8)
    for place, agreed, tail in told:
        y = np.frombuffer(tail, np.uint8)[: len(x) - place]
        wrong = np.flatnonzero(y != x[place : place + len(y)])
        n = int(wrong[0]) + 1 if len(wrong) else len(y)
        out[place : place + n] = _LEVELS[bool(agreed)][:n] | y[:n]


class State:
    """What is refined while texts are read: weights by bit, text and predictor, and each text's memory of itself."""

    def __init__(self, n: int):
        self.weights = np.repeat(np.repeat(START[None, None], n, 1), 8, 0)
        self.tags, self.bytes = np.zeros(n << OWN_BITS, np.uint32), np.full(n << OWN_BITS, -1, np.int32)


def block_size(k: int) -> int:
    return min(FIRST_BLOCK << min(k, 30), LAST_BLOCK)


def read(x: np.ndarray, begin: np.ndarray, lengths: np.ndarray, guess: np.ndarray, words: np.ndarray, state: State, block: int = 0) -> np.ndarray:
    """Bits for ``lengths`` bytes from ``begin`` of each text in x, longest first, without ends; refines the state.

    words is the result of ``paths``, whose last row answers nothing.
    """
    ctx, total, at = Contexts(x), np.zeros(len(lengths)), 0
    while (live := int(np.searchsorted(-lengths, -at, side="left"))) > 0:
        size = block_size(block)
        left = np.minimum(lengths[:live] - at, size)
        widths = -(-left // (size // 8)) * (size // 8)  # of eight kinds, so that neighbours do not matter
        cuts = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), live]
        for a, b, width in ((i, min(j, i + step), w) for s, j in zip(cuts, cuts[1:]) for w in (int(widths[s]),) for step in (max(1, AT_ONCE // w),) for i in range(s, j, step)):
            _read_block(x, ctx, begin[a:b, None] + at, left[a:b, None], width, slice(a, b), guess, words, state, total)
        at += size
        block += 1
    return total


def _read_block(x: np.ndarray, ctx: Contexts, first: np.ndarray, left: np.ndarray, width: int, d: slice, guess: np.ndarray, words: np.ndarray, state: State, total: np.ndarray) -> None:
    places = np.arange(width)
    used = places < left
    places = np.minimum(places + first, len(x) - 1)
    byte = x.take(places)
    word = np.empty((len(START), *places.shape), np.uint64)
    for k in range(3):
        words.take((ctx.rows[k].take(places) << 8) | byte, out=word[k], mode="clip")
    tag, slot = ctx.tag.take(places), ctx.own.take(places) + (np.arange(d.start, d.stop)[:, None] << OWN_BITS)
    held = np.where(state.tags.take(slot) == tag, state.bytes.take(slot), -1)
    GUESSES.take(np.where(held < 0, 0, held << 8 | OWN_LEVEL << 16) | byte, out=word[3], mode="clip")
    GUESSES.take((guess.take(places) << 8) | byte, out=word[4], mode="clip")
    state.tags[slot], state.bytes[slot] = tag, byte
    word *= used
    answers = word.view(np.int8).reshape(*word.shape, 8).swapaxes(0, 1)  # text, predictor, byte, bit
    came, st = np.ones(places.shape, np.float32), np.empty(answers.shape[:3], np.float32)
    share = np.float32(RATE / UNIT) / (left + CALM).astype(np.float32)
    for bit in range(8):
        st[:] = answers[..., bit]
        mix = np.matmul(state.weights[bit, d, None] * np.float32(-1 / UNIT), st)[:, 0]
        np.clip(mix, -10, 10, out=mix)
        np.exp(mix, out=mix)
        odds = mix + 1  # one over the probability of the bit that came
        came *= odds
        mix /= odds  # the probability of the other bit
        state.weights[bit, d] += share * np.matmul(st, mix[:, :, None])[:, :, 0]
    total[d] += np.where(used, np.log2(came), 0).sum(axis=1, dtype=np.float64)
    np.clip(state.weights[:, d], LEAST, MOST, out=state.weights[:, d])


def total_bits(texts: list[bytes], told: list[list[tuple[int, bool, bytes]]], words: np.ndarray, go: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bits that the mixed model needs for each text and its end. A text's result does not depend on its neighbours."""
    out = np.zeros(len(texts))
    steps = np.rint(go * EXACT).astype(np.int64)
    for i, t in enumerate(texts):
        last = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        if t:
            last[t[-1]] -= 1
            last[0] += 1
        out[i] = int(last @ steps) / EXACT * bool(t) + end[t[-1] if t else 0]
    group: list[int] = []
    held = 0
    for i in [*sorted((i for i in range(len(texts)) if 0 < len(texts[i]) <= GROUP), key=lambda i: -len(texts[i])), -1]:
        if group and (i < 0 or held + len(texts[i]) > GROUP):
            x, begin = _joined([texts[k] for k in group])
            guess = np.zeros(len(x), np.int32)
            for b, k in zip(begin, group):
                guess_of(texts[k], told[k], guess[b : b + len(texts[k])])
            out[group] += read(x, begin, np.array([len(texts[k]) for k in group]), guess, words, State(len(group)))
            group, held = [], 0
        if i >= 0:
            group.append(i)
            held += len(texts[i])
    for i in (i for i in range(len(texts)) if len(texts[i]) > GROUP):
        t, a, block, state = texts[i], 0, 0, State(1)
        guess = np.zeros(len(t), np.int32)
        guess_of(t, told[i], guess)
        while a < len(t):
            n = min(sum(map(block_size, range(block, block + WINDOW_BLOCKS))), len(t) - a)
            b = max(0, a - LOOK)
            out[i] += read(np.frombuffer(t, np.uint8, n + a - b, b), np.array([a - b]), np.array([n]), guess[b : a + n], words, state, block)[0]
            a, block = a + n, block + WINDOW_BLOCKS
    return out


_PATHS: dict[str, np.ndarray] = {}


def _paths_once(key: str, table: np.ndarray) -> np.ndarray:
    """``paths`` of a table, made once in a worker."""
    if key not in _PATHS:
        _PATHS.clear()
        _PATHS[key] = paths(table)
    return _PATHS[key]


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Scores are log10 probabilities of the whole text and its end. A null or empty text has the end alone. With no
    training documents nothing is known: base_score is 0 and, but for what a text tells of itself, a bit costs one bit.
    Repeated rows are answered one by one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tokens, seen = corpus_counts(docs, id_col, text_col)
    train, distinct = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # counts in steps of an eighth of their logarithm: the lowest step from which on there are HEAVY tokens at most
    step = F.floor(F.log2("c") * 8)
    n_above, least = 0, 1 << 30
    for r in tokens.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        if (n_above := n_above + r["n"]) > HEAVY:
            break
        least = r["step"]
    heavy = {r["token"].encode(): r["c"] for r in tokens.filter(step >= least).toLocalIterator()}
    shipped = spark.sparkContext.broadcast((heavy, *common_table(seen), uuid.uuid4().hex))
    drop_table(seen)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    narrow = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(F.lit(7), F.col(f"`{id_col}`"), text).alias("tag"), (id_crc(id_col) % 7 == 2).alias("held_out"), text.alias("text")
    )
    told = foretold(narrow)
    same = [narrow["doc_id"].eqNullSafe(told["doc_id"]), narrow["tag"] == told["tag"]]
    ready = narrow.join(told, same, "left").select(narrow["doc_id"], "held_out", "text", "told")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table, go, end, key = shipped.value
        words = _paths_once(key, table)
        for b in batches:
            texts = b.column(2).cast(pa.binary()).to_pylist()
            each = zip(*(v.to_pylist() for v in b.column(3).flatten().flatten()))
            guesses = [[*islice(each, n or 0)] for n in b.column(3).value_lengths().to_pylist()]
            bits = total_bits(texts, guesses, words, go, end)
            n_tokens, n_known, logs, names, times, ends = [], [], [], [], [], [0]
            for t in texts:
                c = Counter(t.lower().split())
                c[b""] = 1
                n = np.fromiter(c.values(), np.int64, len(c))
                k = np.fromiter(map(known.get, c, repeat(0)), np.int64, len(c))
                hit = k > 0
                n_known.append(int(n[hit].sum()))
                logs.append(float(np.dot(n[hit], np.log10(k[hit] + 1.0))))
                names += compress(c, (~hit).tolist())
                times += n[~hit].tolist()
                ends.append(len(names))
                n_tokens.append(int(n.sum()))
            rare = pa.StructArray.from_arrays([pa.array(names, pa.binary()).cast(pa.string()), pa.array(times, pa.int32())], names=["token", "n"])
            yield pa.record_batch(
                [
                    b.column(0), b.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(logs, pa.float64()), pa.array(bits, pa.float64()),
                    pa.array(map(len, texts), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare),
                ],
                names=["doc_id", "held_out", "n_tokens", "known", "logs", "bits", "n_bytes", "rare"],
            )

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, known bigint, logs double, bits double, n_bytes bigint, rare array<struct<token:string,n:int>>"
    # written before it is numbered: the number then follows from the files, not from a run
    scored = cut(ready.mapInArrow(run, schema), "lm-scored").withColumn("row", F.monotonically_increasing_id())
    # rare tokens meet their counts in a shuffle by token; only their sums come back to the rows
    light = tokens.filter(step < least)
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.n").join(light, "token")
    rare = rare.groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    n_known = F.col("known") + F.coalesce("more", F.lit(0))
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(train + distinct + 1)))
    return scored.drop("rare").join(rare, "row", "left").select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens", n_known.cast("bigint").alias("n_known"), F.lit(int(train)).cast("bigint").alias("train_tokens"),
        base.alias("base_score"), (-F.col("bits") * float(np.log10(2))).alias("score"), "n_bytes",
        F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes")).otherwise(F.col("bits")).alias("bits_per_byte"),
    )
