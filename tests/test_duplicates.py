"""Classes of near-equal questions against all pairs, with copies, blanks, nulls and one large cluster."""

import random
from collections import Counter

import numpy as np

from tesserae.operators import duplicates
from tesserae.operators.duplicates import duplicate_classes


def plainly(rows):
    sets = [set((q or "").split()) for _, q in rows]

    def linked(a, b):
        if (rows[a][1] or "") == (rows[b][1] or ""):
            return True
        return bool(sets[a]) and bool(sets[b]) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.7

    near = [[b for b in range(len(rows)) if b != a and linked(a, b)] for a in range(len(rows))]
    out = Counter()
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        out[rows[a][0], min(ids) if ids else None, len(near[a])] += 1
    return out


def got(df):
    return Counter(tuple(r) for r in duplicate_classes(df).collect())


def test_classes_match_all_pairs(spark, monkeypatch):
    r = random.Random(7)
    rows = []
    for i in range(220):
        words = [f"w{min(int(r.expovariate(0.15)), 30)}" for _ in range(r.randint(0, 14))]
        rows.append((i if i % 17 else i % 3, " ".join(words)))
        if i % 3 == 0:
            rows.append((1000 + i, " ".join(words[:-1] + ["x"])))
    rows += [(3000, ""), (3001, " "), (3002, None), (None, "w1 w2"), (3003, "w1 w2"), (3004, "w2  w1 w1"), (3005, "w1　w2")]
    df = spark.createDataFrame(rows, "ordinal bigint, question string")
    want = plainly(rows)
    assert got(df.repartition(3)) == want
    monkeypatch.setattr(duplicates, "BLOCK", 5)
    monkeypatch.setattr(duplicates, "SHARD_ROWS", 100)
    monkeypatch.setattr(duplicates, "STEP", 3)
    assert got(df) == want
    assert got(df.filter("false")) == Counter()


def test_a_cluster_of_many_variants(spark):
    n, r = 5000, random.Random(8)
    common = [f"c{i}" for i in range(24)]
    texts = [" ".join(common + [f"v{r.randrange(2500)}" for _ in range(r.choice([1, 2, 5]))]) for _ in range(n)]
    out = duplicate_classes(spark.createDataFrame(list(enumerate(texts)), "ordinal bigint, question string")).collect()
    vocabulary = {w: k for k, w in enumerate(sorted({w for t in texts for w in t.split()}))}
    m = np.zeros((n, len(vocabulary)), np.float32)
    for k, t in enumerate(texts):
        m[k, [vocabulary[w] for w in t.split()]] = 1
    shared, size = m @ m.T, m.sum(axis=1)
    links = (shared / (size[:, None] + size[None, :] - shared).astype(np.float64) > 0.7).sum(axis=1) - 1
    assert len(out) == n and {x["ordinal"]: x["n_links"] for x in out} == dict(enumerate(links.tolist()))
    assert {x["class_id"] for x in out} == {0}
