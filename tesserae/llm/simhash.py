"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a small Hamming distance.

Candidates come from pigeonring chains. A fingerprint is a ring of four 16-bit segments; with two differing
bits allowed, the budget of a chain of 1, 2, 3, 4 consecutive segments is the whole part of 1/2, 1, 3/2, 2:
0, 1, 1, 2. Every pair within distance 2 has a segment from which all four chains keep their budgets. So its
first segment agrees, and of the next two the first agrees or differs in one bit and the second agrees: six
keys of two whole segments find every pair. Inside a bucket the chains are checked before the full distance.

Only distinct fingerprints are compared, so copies never pair up; a bucket answers with a spanning forest of
its links, not with all of them. Buckets beyond HOT members are divided again by the remaining 32 bits (equal
segment, or equal but for one bit), which bounds a group by 2**17 fingerprints at any size of input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, join_skewed, row_tag, small_batches
from tesserae.llm.components import connected_components

SHINGLE, MAX_BITS, SEGMENTS, WIDTH = 3, 2, 4, 16
BUDGETS = tuple(k * MAX_BITS // SEGMENTS for k in range(1, SEGMENTS + 1))
#: Two whole segments of a key, and the segments at which its chains may start.
KEYS = (((0, 1), (0,)), ((1, 2), (1,)), ((2, 3), (2,)), ((3, 0), (3,)), ((0, 2), (0, 2)), ((1, 3), (1, 3)))
#: Largest bucket that is compared pair by pair; rows that one shard of buckets should hold.
HOT, SHARD_ROWS = 2048, 100_000
PIECE = 4 << 20
_LANES = np.uint64(0x0101010101010101)


_GAP = re.compile(rb"[\x20\x09-\x0d]")


def _word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded piece of it at a time; a piece ends at white space, the first after it if it has none."""
    at = 0
    while len(data) - at > PIECE:
        last = max(data.rfind(c, at, at + PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if last < 0:
            gap = _GAP.search(data, at + PIECE)
            last = gap.start() if gap else len(data)
        yield data[at:last].split()
        at = last + 1
    yield data[at:].split()


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits. Bytes of a 64-bit word count eight bits at once."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 255 * 64):
        part = hashes[a : a + 255 * 64]
        rows = np.zeros(-(-len(part) // 64) * 64, np.uint64)
        rows[: len(part)] = part
        rows = rows.reshape(-1, 64)  # at most 255 rows, so no byte overflows
        for b in range(8):
            lanes = ((rows >> np.uint64(b)) & _LANES).sum(axis=0, dtype=np.uint64)
            total[b::8] += lanes.view(np.uint8).reshape(64, 8).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None) -> int:
    """A bit is set if it is set in over half of the shingles' hashes (XXH64, seed 42); no words: 0."""
    from xxhash import xxh64_intdigest as h64

    ones, n, tail, words_seen = np.zeros(64, np.int64), 0, [], 0
    for words in _word_blocks((text or "").encode().lower()):
        words_seen += len(words)
        w = tail + words
        if len(w) >= SHINGLE:
            hashes = np.array([h64(s, 42) for s in map(b" ".join, zip(w, w[1:], w[2:]))], np.uint64)
            ones += _bit_counts(hashes)
            n += len(hashes)
        tail = w[-(SHINGLE - 1) :]
    if 0 < words_seen < SHINGLE:
        return h64(b" ".join(tail), 42)
    bits = np.flatnonzero(2 * ones > n).tolist()
    return sum(1 << b for b in bits)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag (see ``row_tag``), fp (the fingerprint as a signed long) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(fps)], names=["doc_id", "tag", "fp"])

    narrow = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), row_tag(id_col, text_col).alias("tag"))
    return narrow.mapInArrow(run, "doc_id bigint, tag bigint, fp bigint")


def _segment(i: int) -> Column:
    return F.shiftrightunsigned("fp", WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _mask(segments: tuple[int, ...] | list[int]) -> np.uint64:
    return np.uint64(sum(((1 << WIDTH) - 1) << (WIDTH * s) for s in segments))


def in_chain(diff: np.ndarray, start: int) -> np.ndarray:
    """Which differences keep the budget of every chain from this segment on."""
    ok = np.ones(diff.shape, bool)
    for k in range(SEGMENTS):
        ok &= np.bitwise_count(diff & _mask([(start + j) % SEGMENTS for j in range(k + 1)])) <= BUDGETS[k]
    return ok


def _join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each component after the links a-b are added."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        lo, hi = np.minimum(la, lb)[apart], np.maximum(la, lb)[apart]
        np.minimum.at(labels, hi, lo)
        while (up := labels[labels]).tobytes() != labels.tobytes():
            labels = up
    return labels


def bucket_links(fps: np.ndarray, starts: tuple[int, ...], probes: np.ndarray | None = None) -> np.ndarray:
    """fps: sorted distinct fingerprints of a bucket. For each the index of the smallest member it is linked to."""
    n = len(fps)
    labels = np.arange(n)
    if n <= HOT:
        for lo in range(0, n, 512):
            diff = fps[lo : lo + 512, None] ^ fps[None, :]
            cand = np.zeros(diff.shape, bool)
            for s in starts:
                cand |= in_chain(diff, s)
            i, j = np.nonzero(cand)
            near = (np.bitwise_count(diff[i, j]) <= MAX_BITS) & (i + lo < j)
            labels = _join_labels(labels, i[near] + lo, j[near])
        return labels
    for p in probes:
        want = fps ^ p
        at = np.minimum(np.searchsorted(fps, want), n - 1)
        hit = np.flatnonzero((fps[at] == want) & (at > np.arange(n)))
        labels = _join_labels(labels, hit, at[hit])
    return labels


def _links_of_shards(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: shard, keys (the first is the kind of key), fp, node. Links a-b between nodes, a spanning forest per bucket."""

    def run(table: pa.Table) -> pa.Table:
        cols = [table.column(k).to_numpy() for k in keys]
        fp, node = table.column("fp").to_numpy().view(np.uint64), table.column("node").to_numpy()
        order = np.lexsort((fp, *cols[::-1]))
        fp, node, cols = fp[order], node[order], [c[order] for c in cols]
        new = np.zeros(len(fp), bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        edges = np.flatnonzero(np.concatenate(([True], new[1:], [True])))
        left, right = [], []
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi - lo > 1:
                kind = int(cols[0][lo])
                labels = bucket_links(fp[lo:hi], KEYS[kind][1], _probes(kind) if hi - lo > HOT else None)
                moved = np.flatnonzero(labels != np.arange(hi - lo))
                left.append(node[lo + moved])
                right.append(node[lo + labels[moved]])
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return pa.table({"a": cat(left), "b": cat(right)})

    return rows.groupBy("shard").applyInArrow(run, "a bigint, b bigint")


def _probes(kind: int) -> np.ndarray:
    """All differences of one or two bits outside the key's segments."""
    free = [np.uint64(1) << np.uint64(b) for s in range(SEGMENTS) if s not in KEYS[kind][0] for b in range(WIDTH * s, WIDTH * (s + 1))]
    return np.array([*free, *(x | y for i, x in enumerate(free) for y in free[:i])], np.uint64)


def links(nodes: DataFrame) -> DataFrame:
    """nodes: fp (distinct), node. Links a-b that connect all nodes whose fingerprints differ in at most 2 bits."""
    parts = [F.struct(F.lit(k).alias("kind"), (_segment(i) * (1 << WIDTH) + _segment(j)).alias("key")) for k, ((i, j), _) in enumerate(KEYS)]
    keyed = nodes.select("fp", "node", F.explode(F.array(*parts)).alias("k")).select("fp", "node", "k.kind", "k.key")
    sizes = cut(keyed.groupBy("kind", "key").agg(F.count("*").alias("members")).filter(F.col("members") > 1), "simhash-buckets")
    total, hottest = sizes.agg(F.sum("members"), F.max("members")).first()
    shards = max(1, (total or 0) // SHARD_ROWS)
    met = keyed.join(sizes, ["kind", "key"])
    shard = lambda *c: F.pmod(F.xxhash64(*c), F.lit(shards))
    out = _links_of_shards(met.filter(F.col("members") <= HOT).select(shard("kind", "key").alias("shard"), "kind", "key", "fp", "node"), ["kind", "key"])
    if (hottest or 0) > HOT:
        hot = met.filter(F.col("members") > HOT)
        for kind, ((i, j), _) in enumerate(KEYS):
            x, y = (s for s in range(SEGMENTS) if s not in (i, j))
            subs = [F.struct(F.lit(0).alias("how"), _segment(x).alias("rest")), F.struct(F.lit(1).alias("how"), _segment(y).alias("rest"))]
            subs += [F.struct(F.lit(2 + b).alias("how"), _segment(x).bitwiseAND(F.lit(0xFFFF ^ (1 << b))).alias("rest")) for b in range(WIDTH)]
            divided = hot.filter(F.col("kind") == kind).select("kind", "key", "fp", "node", F.explode(F.array(*subs)).alias("s"))
            divided = divided.select("kind", "key", "fp", "node", "s.how", "s.rest").withColumn("shard", shard("kind", "key", "how", "rest"))
            out = out.unionAll(_links_of_shards(divided, ["kind", "key", "how", "rest"]))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_tag: bool = False) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links) of every row; its tag too if asked.

    A null text counts as empty; texts without words have fingerprint zero and link like any other. Rows with
    the same fingerprint are one node, so repeated rows and large groups of copies cost nothing further. A null
    id belongs to its component but names one only if no row of the component has an id.
    """
    fps = cut(fingerprints(docs, id_col, text_col), "simhash-fps")
    nodes = cut(fps.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(2**63 - 1)).alias("id"), F.count("*").alias("n")).withColumn("node", F.col("fp")), "simhash-nodes")
    groups = connected_components(links(nodes.select("fp", "node")), nodes.select("node", "id"))
    labels = nodes.join(groups, "node", "left").select("fp", "n", F.coalesce("component", "id").alias("component_id"))
    labels = cut(labels, "simhash-labels")
    total = labels.agg(F.sum("n")).first()[0] or 0
    named = join_skewed(fps, labels, ["fp"], "n", total, "doc_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    lowest = F.when(F.col("component_id") < 2**63 - 1, F.col("component_id"))
    return named.select(F.col("doc_id").alias(id_col), digits.alias("fingerprint"), lowest.alias("component_id"), *["tag"] * with_tag)
