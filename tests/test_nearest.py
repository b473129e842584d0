"""Nearest vectors over many blocks: results against all pairs, and what is written."""

import numpy as np
import pytest

from tesserae.operators import vectors


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)


def table(spark, n, seed, kind="float"):
    r = np.random.default_rng(seed)
    m = r.integers(-2, 3, (n, 4)).astype(float)  # many equal vectors, some of zeros
    return m, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"vec_id bigint, embedding array<{kind}>")


@pytest.mark.parametrize("held,k,right,kind", [(1, 3, 300, "float"), (64, 1, 300, "double"), (2, 5, 3, "float")])
def test_nearest_against_all_pairs(spark, small_blocks, monkeypatch, held, k, right, kind):
    monkeypatch.setattr(vectors, "HELD", held)
    (a, left), (b, other) = table(spark, 400, 1, kind), table(spark, right, 2, kind)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    s = np.round(unit(a) @ unit(b).T, 9)
    want = {(i, int(j), n + 1): s[i, j] for i in range(len(a)) for n, j in enumerate(np.lexsort((np.arange(right), -s[i]))[:k])}
    got = {(r["id"], r["other"], r["rank"]): r["score"] for r in vectors.nearest(left, other, k).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-8 for x in want)


def test_nearest_writes_in_proportion_to_the_vectors(spark, small_blocks):
    """Pairs of blocks were written: four times the vectors took sixteen times the disk."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found, each = {}, manager.getAllFiles().iterator()
        while each.hasNext():
            f = each.next()
            found[f.getName()] = f.length()
        return found

    def written(n):
        (_, left), (_, other) = table(spark, n, 1), table(spark, n, 2)
        before = files()
        assert vectors.nearest(left, other, 1).count() == n
        return sum(size for name, size in files().items() if name not in before)

    assert written(2400) < 6 * written(600)
