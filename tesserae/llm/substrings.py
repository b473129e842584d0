"""Removal of long repeated byte strings by suffix arrays.

Every byte covered by a string of SPAN bytes that also starts elsewhere goes. Strings that can match are first
brought together: each SPAN-byte window belongs to one anchor, the smallest hashed GRAM inside it, so equal
windows have equal anchors. Neighbouring windows of one anchor form a context, the bytes they cover. Only
contexts whose anchor occurs twice or more can hold a repeat. Equal contexts collapse to one with a count
before anything is shipped; the others travel, by anchor, to shards of bounded size.

In a shard the contexts are put end to end; Larsson-Sadakane refinement sorts the suffixes (each round sorts
only the groups not yet told apart, by the rank of what follows, and doubles the depth), Kasai's walk gives
the common prefixes, and neighbours in the array that share SPAN bytes are one repeated string. An anchor
with very many different contexts is dealt over several shards; each passes on one row for each different window
of such an anchor, named by its digest, and an aggregate over the digests finds what two or more shards hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, drop_table, join_skewed, small_batches

SPAN, GRAM = 200, 40
_W = SPAN - GRAM + 1
#: Bytes of contexts that a shard should hold; distinct contexts of one anchor beyond which it is dealt out.
SHARD_BYTES, HOT = 2 << 20, 2048
#: Bytes hashed at a time.
PIECE = 1 << 20
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(int(_RNG.integers(1, 2**62)) * 2 + 1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and those of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PIECE + 4 * SPAN)
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _scramble(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _prefix_sums(x: np.ndarray) -> np.ndarray:
    """p with (p[j] - p[i]) * base**i a hash of the bytes from i to j alone."""
    p = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_BYTE.take(x) * _powers(len(x))[1], out=p[1:])
    return p


def _span_hash(p: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return _scramble((p[j] - p[i]) * _powers(len(p))[0][i] + (j - i).astype(np.uint64))


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values: the later part of one block and the first part of the next."""
    n = len(v)
    rows = np.full(-(-n // w) * w, v.max(), v.dtype)
    rows[:n] = v
    rows = rows.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def contexts_of(x: np.ndarray, text_ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """x: texts end to end. (anchor hash, context hash, first window, windows) of every context, by place.

    Windows that would cross a text's end belong to none.
    """
    if len(x) < SPAN:
        return (np.empty(0, np.int64),) * 4
    p = _prefix_sums(x)
    n = len(x) - GRAM + 1
    grams = _scramble((p[GRAM:] - p[:n]) * _powers(n)[0])
    room = np.uint64(24)
    ranked = (grams >> room << room) | np.arange(n, dtype=np.uint64)  # ties go to the leftmost
    owner = (_sliding_min(ranked, _W) & np.uint64((1 << 24) - 1)).astype(np.int64)
    starts = np.concatenate(([0], text_ends[:-1]))
    valid = np.zeros(len(owner) + 1, np.int8)
    long = text_ends - starts >= SPAN
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, text_ends[long] - SPAN + 1, -1)
    owner[np.cumsum(valid[:-1]) == 0] = -1
    cuts = np.concatenate(([0], np.flatnonzero((owner[1:] != owner[:-1])) + 1, [len(owner)]))
    first, count = cuts[:-1], np.diff(cuts)
    keep = owner[first] >= 0
    first, count = first[keep], count[keep]
    return grams[owner[first]].view(np.int64), _span_hash(p, first, first + count + SPAN - 1).view(np.int64), first, count


def _anchors(docs: DataFrame) -> DataFrame:
    """docs: doc_id, tag, text. One row per context: doc_id, tag, a (anchor), c (context), s (its start), n (windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags = b.column(0), b.column(1)  # Arrow arrays: numpy would turn an id column with nulls into floats
            held: list[tuple[int, int, bytes]] = []  # row, offset of the piece in its text, bytes
            size = 0
            for i, t in enumerate(b.column(2)):
                data = (t.as_py() or "").encode()
                for a in range(0, max(1, len(data) - SPAN + 1), PIECE):
                    part = data[a : a + PIECE + SPAN - 1]
                    if len(part) < SPAN:
                        continue
                    if size + len(part) > PIECE + SPAN and held:
                        yield out(ids, tags, held)
                        held, size = [], 0
                    held.append((i, a, part))
                    size += len(part)
            if held:
                yield out(ids, tags, held)

    def out(ids: pa.Array, tags: pa.Array, held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        ends = np.cumsum([len(d) for _, _, d in held])
        a, c, first, n = contexts_of(np.frombuffer(b"".join(d for _, _, d in held), np.uint8), ends)
        which = np.searchsorted(ends, first, side="right")
        row = pa.array(np.array([r for r, _, _ in held])[which])
        begin = (np.array([o for _, o, _ in held]) - np.concatenate(([0], ends[:-1])))[which]
        return pa.record_batch([ids.take(row), tags.take(row), pa.array(a), pa.array(c), pa.array((first + begin).astype(np.int32)), pa.array(n.astype(np.int16))], names=["doc_id", "tag", "a", "c", "s", "n"])

    return docs.mapInArrow(run, "doc_id bigint, tag bigint, a bigint, c bigint, s int, n smallint")


def suffix_array(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each suffix), told apart by their first ``depth`` bytes at least.

    The first sort takes eight bytes at once; each further round sorts only the groups that are still together,
    by the rank of the suffix that starts where the compared part ends.
    """
    n = len(x)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = x
    key = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n].copy().view(">u8").astype(np.uint64).reshape(-1)
    sa = np.argsort(key)
    ordered = key[sa]
    head = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    del key, ordered
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    together = ~(head & np.concatenate((head[1:], [True])))
    slots = np.flatnonzero(together)
    h = 8
    while len(slots):
        suffix = sa[slots]
        follow = np.where(suffix + h < n, rank[np.minimum(suffix + h, n - 1)] + 1, 0)
        key = (rank[suffix] << 32) | follow
        order = np.argsort(key)
        suffix, key = suffix[order], key[order]
        sa[slots] = suffix
        head = np.concatenate(([True], key[1:] != key[:-1]))
        rank[suffix] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        slots = slots[~(head & np.concatenate((head[1:], [True])))]
        h *= 2
    return sa, rank


def common_prefixes(x: np.ndarray, sa: np.ndarray, rank: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """Kasai's walk: bytes that each suffix shares with the one before it in order, up to ``most``.

    The contexts (their starts in x) are walked side by side: one step to the right loses at most one byte.
    """
    n = len(x)
    out = np.zeros(n, np.int16)
    slot = np.arange(n)
    slot = rank.copy()
    slot[sa] = np.arange(n)
    lengths = np.diff(np.concatenate((starts, [n])))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    held = np.zeros(len(starts), np.int64)
    padded = np.concatenate((x.astype(np.int16), np.full(most + 1, -1, np.int16)))
    for step in range(int(lengths[0]) if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -step, side="left"))
        i = starts[:live] + step
        at = slot[i]
        j = sa[at - 1]
        h = np.maximum(held[:live] - 1, 0)
        h[at == 0] = most
        todo = np.flatnonzero(h < most)
        while len(todo):
            a, b = i[todo] + h[todo], j[todo] + h[todo]
            same = (padded[a] == padded[b]) & (b < n) & (a < n)
            todo = todo[same]
            h[todo] += 1
            todo = todo[h[todo] < most]
        h[at == 0] = 0
        out[at] = h
        held[:live] = h
    return out


def repeated_windows(contexts: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, window, repeated) of every window of distinct contexts, which occur ``counts`` times each."""
    x = np.frombuffer(b"".join(contexts), np.uint8)
    lengths = np.array([len(c) for c in contexts])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    sa, rank = suffix_array(x, SPAN)
    shared = common_prefixes(x, sa, rank, starts, SPAN)
    group = np.cumsum(shared < SPAN) - 1  # of each place in the array: neighbours that share SPAN bytes
    which = np.repeat(np.arange(len(contexts)), lengths)
    window = np.arange(len(x)) - starts[which]
    real = window <= lengths[which] - SPAN
    weight = np.where(real, counts[which], 0)[sa]
    often = np.bincount(group, weights=weight)
    repeated = np.zeros(len(x), bool)
    repeated[sa] = (often[group] >= 2)
    return which[real], window[real], repeated[real]


def _runs(which: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows of a context as (context, first, end)."""
    if not len(which):
        return which, window, window
    new = np.concatenate(([True], (which[1:] != which[:-1]) | (window[1:] != window[:-1] + 1)))
    head = np.flatnonzero(new)
    last = np.concatenate((head[1:], [len(which)])) - 1
    return which[head], window[head], window[last] + 1


def _search_shards(rows: DataFrame) -> DataFrame:
    """rows: shard, a, c, m (times it occurs), hot, bytes. Runs of repeated windows: a, c, lo, hi; of hot anchors also
    one row for each different window's digest (f, g), with lo its place and hi -1 where it is not repeated inside the shard."""

    def run(table: pa.Table) -> pa.Table:
        a, c = table.column("a").to_numpy(), table.column("c").to_numpy()
        hot = table.column("hot").to_numpy()
        shard = table.column("shard").to_numpy()[:1]
        data = table.column("bytes").to_pylist()
        which, window, repeated = repeated_windows(data, table.column("m").to_numpy())
        w, lo, hi = _runs(which[repeated], window[repeated])
        none = np.zeros(len(w), np.int64)
        cols = [[a[w]], [c[w]], [lo], [hi], [none], [none]]
        open_ = hot[which]
        if open_.any():
            w, at, known = which[open_], window[open_], repeated[open_]
            sizes = np.array([len(d) for d in data])
            begin = np.cumsum(sizes) - sizes
            p = _prefix_sums(x := np.frombuffer(b"".join(data), np.uint8))
            q = _prefix_sums(x ^ 0x5A)
            i = begin[w] + at
            f, g = _span_hash(p, i, i + SPAN).view(np.int64), _span_hash(q, i, i + SPAN).view(np.int64)
            # equal windows are all known as repeated already, so the first of them speaks for the shard
            order = np.lexsort((g, f))
            one = order[np.concatenate(([True], (np.diff(f[order]) != 0) | (np.diff(g[order]) != 0)))]
            for k, v in enumerate((a[w], c[w], at, np.where(known, 0, -1), f, g)):
                cols[k].append(v[one])
        cat = [np.concatenate(v).astype(np.int64) for v in cols]
        digest = np.concatenate((np.zeros(len(none), bool), np.ones(len(cat[0]) - len(none), bool)))
        return pa.table([pa.array(np.repeat(shard, len(cat[0]))), *map(pa.array, cat), pa.array(digest)], names=["shard", "a", "c", "lo", "hi", "f", "g", "digest"])

    return rows.groupBy("shard").applyInArrow(run, "shard bigint, a bigint, c bigint, lo bigint, hi bigint, f bigint, g bigint, digest boolean")


def _merge_shards(windows: DataFrame) -> DataFrame:
    """Windows of hot anchors, each once a shard. Those that another shard has too and their own repeats not yet: a, c, lo, hi.

    A digest has at most one row for each shard, and the aggregate adds up before it ships.
    """
    shared = windows.groupBy("f", "g").agg(F.count("*").alias("k")).filter("k > 1").select("f", "g")
    return windows.filter("hi < 0").join(shared, ["f", "g"], "left_semi").select("a", "c", "lo", (F.col("lo") + 1).alias("hi"))


def _joined(pairs: np.ndarray) -> np.ndarray:
    """Spans (start, end) merged where they meet, by start."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate(([True], pairs[1:, 0] > reach[:-1]))
    head = np.flatnonzero(new)
    return np.stack((pairs[head, 0], reach[np.concatenate((head[1:], [len(pairs)])) - 1]), 1)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` the kept bytes and spans.

    Texts are UTF-8 bytes; a null text is empty. Strings are judged on the input; matches never cross rows, and
    rows that repeat whole are documents of their own, so long ones remove each other. Removal can split a
    character, so what is kept is binary.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    narrow = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(F.lit(7), F.col(f"`{id_col}`"), text).alias("tag"), text.alias("text"))
    places = cut(_anchors(narrow.filter(F.octet_length("text") >= SPAN)), "repeat-places")
    # anchors that very many contexts share meet their counts by broadcast, the others by shuffle
    twice = places.groupBy("a").agg(F.count("*").alias("k")).filter(F.col("k") > 1)
    met = cut(join_skewed(places, twice, ["a"], "k", places.count(), "c").filter("k IS NOT NULL").drop("k", "join_key"), "repeat-met")
    drop_table(places)
    distinct = met.groupBy("a", "c").agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "tag", "s", "n")).alias("at"))
    heavy = F.count("*").alias("kinds")
    distinct = cut(distinct, "repeat-contexts")
    kinds = distinct.groupBy("a").agg(heavy).filter(F.col("kinds") > HOT)
    size, total = distinct.agg(F.coalesce(F.sum(F.col("at.n") + SPAN - 1), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-size // SHARD_BYTES))
    spread = F.when(F.col("kinds").isNotNull(), F.pmod(F.xxhash64("c"), F.ceil(F.col("kinds") / HOT))).otherwise(F.lit(0))
    dealt = join_skewed(distinct, kinds, ["a"], "kinds", total, "c").select(
        "at.doc_id", "at.tag", F.struct("a", "c", "m", F.col("kinds").isNotNull().alias("hot"), F.pmod(F.xxhash64("a", spread), F.lit(shards)).alias("shard"), "at.s", "at.n").alias("w")
    )
    wanted = dealt.groupBy("doc_id", "tag").agg(F.collect_list("w").alias("w"))
    same = [narrow["doc_id"].eqNullSafe(wanted["doc_id"]), narrow["tag"] == wanted["tag"]]
    # repeated rows have the same tag: one of them gives the bytes, which the distinct step below sees to
    fetched = narrow.join(wanted, same).select("text", "w")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, wl in zip(b.column(0), b.column(1)):
                data, w = t.as_py().encode(), wl.values.flatten()
                s, n = w[5].to_numpy(), w[6].to_numpy()
                for k in range(0, len(s), 4096):
                    parts = [data[i : i + m + SPAN - 1] for i, m in zip(s[k : k + 4096].tolist(), n[k : k + 4096].tolist())]
                    yield pa.record_batch([*(c.slice(k, 4096) for c in (w[4], w[0], w[1], w[2], w[3])), pa.array(parts, pa.binary())], names=["shard", "a", "c", "m", "hot", "bytes"])

    rows = fetched.mapInArrow(fetch, "shard bigint, a bigint, c bigint, m bigint, hot boolean, bytes binary").dropDuplicates(["shard", "a", "c"])
    found = cut(_search_shards(rows), "repeat-found")
    runs = found.filter(~F.col("digest")).select("a", "c", "lo", "hi")
    runs = runs.unionAll(_merge_shards(found.filter("digest")))
    # of a context all runs in one array (it has at most _W windows), met by its copies once each
    per_context = runs.groupBy("a", "c").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")).join(distinct.select("a", "c", "m"), ["a", "c"])
    told = join_skewed(met.select("doc_id", "tag", "s", "a", "c"), per_context, ["a", "c"], "m", met.count(), "doc_id").filter("runs IS NOT NULL")
    # a set, so that rows that repeat whole, which share their name, do not multiply it
    per_doc = told.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("s", "runs")).alias("spans"))
    final = narrow.join(per_doc, [narrow["doc_id"].eqNullSafe(per_doc["doc_id"]), narrow["tag"] == per_doc["tag"]], "left").select(narrow["doc_id"], "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
        for b in batches:
            out: list[tuple] = []
            for t, sl in zip(b.column(1), b.column(2)):
                data, cuts = t.as_py().encode(), []
                if sl.is_valid:
                    s, runs = sl.values.flatten()
                    lo, hi = (v.to_numpy() for v in runs.flatten().flatten())
                    at = np.repeat(s.to_numpy(), runs.value_lengths().to_numpy())
                    cuts = _joined(np.stack((at + lo, at + hi + SPAN - 1), 1)).tolist()
                edges = [0, *(x for c in cuts for x in c), len(data)]
                kept = b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2]))
                out.append((len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept, [x for c in cuts for x in c]))
            cols = list(zip(*out)) or [[]] * 6
            kinds_ = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())]
            m = 6 if with_text else 4
            yield pa.record_batch([b.column(0), *(pa.array(cols[k], kinds_[k]) for k in range(m))], names=names[: m + 1])

    return final.mapInArrow(remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary, spans array<bigint>" * with_text)
