"""Product codes and clusters of vectors against plain loops; annuli against all entries."""

import hashlib
import math
import random

import numpy as np
import pytest

from weftline.llm import centroids as C
from weftline.llm import vector_codes as VC
from weftline.llm import vectors as V

KIND = "vec_id long, embedding array<float>, label int"


def rows(seed, n, dim, spread=1.0, labels=5):
    r = random.Random(seed)
    near = [[r.uniform(-spread, spread) for _ in range(dim)] for _ in range(7)]
    out = []
    for i in range(n):
        own = near[r.randrange(7)]
        v = own if r.random() < 0.3 else [x + r.gauss(0, 0.1 * spread) for x in own]
        out.append((i, [float(np.float32(x)) for x in v], r.choice([*range(labels), None])))
    return out


def whole(v):
    most = V.bound(len(v))
    return [max(-most, min(most, math.floor(x * 1024))) for x in v]


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def nearest(x, entries):
    return min((apart(x, e), i) for i, e in enumerate(entries))[::-1]


def lloyd(points, start, rounds):
    entries = list(start)
    for _ in range(rounds):
        own = [nearest(x, entries)[0] for x in points]
        for e in range(len(entries)):
            mine = [x for x, o in zip(points, own, strict=True) if o == e]
            if mine:
                entries[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return entries


def plain_codes(data, parts=4, entries=256, rounds=4):
    kept = sorted((i, whole(v), label) for i, v, label in data if finite(v))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [lloyd([cut(v, p) for _, v, _ in kept], [cut(v, p) for _, v, _ in kept[:entries]], rounds) for p in range(parts)]
    coded, by_label = [], {}
    for i, v, label in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for _, d in found)
        by_label[label] = by_label.get(label, 0) + error
        coded.append((i, "".join(f"{e:02x}" for e, _ in found), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, c, e, by_label[label]) for i, c, e, label in coded), digest


def plain_clusters(data, dim, clusters, rounds):
    kept = [(i, whole(v)) for i, v, _ in data if finite(v) and len(v) == dim]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    final = lloyd([v for _, v in kept], [v for _, v in start], rounds)
    found = [(i, *nearest(v, final)) for i, v in kept]
    sums = {c: sum(d for _, k, d in found if k == c) for c in range(clusters)}
    return sorted((i, c, d, sums[c], sum(sums.values())) for i, c, d in found), final


def test_annuli_equal_all_entries():
    r = np.random.default_rng(1)
    for scale, dim in ((5, 4), (300, 16), (1 << 26, 4)):
        entries = r.integers(-scale, scale, (200, dim)).astype(np.int64)
        entries[50:60] = entries[:10]  # ties go to the lower number
        parts = np.concatenate([r.integers(-scale, scale, (700, dim)), entries[40:70]]).astype(np.int64)
        d = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
        at, distance = VC.Annuli(entries).nearest(parts)
        assert (at == d.argmin(1)).all() and (distance == d.min(1)).all()


def test_annuli_measure_few_where_norms_differ():
    r = np.random.default_rng(2)
    unit = r.normal(size=(256, 8))
    entries = (unit / np.linalg.norm(unit, axis=1)[:, None] * (1000 * np.arange(1, 257))[:, None]).astype(np.int64)
    parts = entries[r.integers(0, 256, 5000)] + r.integers(-5, 5, (5000, 8))
    a = VC.Annuli(entries)
    at, _ = a.nearest(parts)
    assert (at == ((parts[:, None, :] - entries[None]) ** 2).sum(2).argmin(1)).all()
    assert a.met < 0.2 * 5000 * 256


@pytest.mark.parametrize("dim", [8, 16])
def test_codes_equal_plain_loops(spark, dim):
    data = rows(dim, 400, dim)
    got, books = VC.codes(spark.createDataFrame(data, KIND).repartition(5))
    want, digest = plain_codes(data)
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got.collect()) == want and VC.digest(books) == digest


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [0.5] * 8, None), (2, [0.5] * 8, 3), (2, [0.5] * 8, 3), (3, None, 1), (4, [0.1] * 7 + [None], 1), (5, [nan] * 8, 1), (6, [inf] + [0.0] * 7, 1), (7, [-0.25] * 8, None)]
    df = spark.createDataFrame([*data, (9, [], 1), (10, [1.0] * 3, 1), (None, [0.125] * 8, 2), (11, [3e38] * 8, 5), (12, [1e9] * 8, 5)], KIND)
    got = {(r.vec_id, r.label): (r.code, r.error, r.label_error) for r in VC.codes(df)[0].collect()}
    assert set(got) == {(1, None), (2, 3), (7, None), (None, 2), (11, 5), (12, 5)} and VC.codes(df)[0].count() == 7
    assert got[11, 5][0] == got[12, 5][0]  # both held within the bound
    assert all(e == 0 and t == 0 for _, e, t in got.values())
    assert VC.codes(df.limit(0))[0].collect() == []


@pytest.mark.parametrize(("dim", "clusters", "rounds"), [(8, 4, 5), (64, 8, 10)])
def test_clusters_equal_plain_loops(spark, dim, clusters, rounds):
    data = rows(dim + 1, 300, dim) + [(1000 + i, [0.25] * dim, None) for i in range(120)]  # a hot vector
    got, final = C.cluster(spark.createDataFrame(data, KIND).repartition(5), dim, clusters, rounds)
    want, entries = plain_clusters(data, dim, clusters, rounds)
    assert sorted(tuple(r) for r in got.collect()) == want and final.tolist() == entries


def test_clusters_of_odd_rows(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, [0.5] * 8, 1), (1, [0.5] * 8, 1), (2, [0.5] * 8, 1), (3, [nan] * 8, 1), (4, None, 1), (5, [1.0] * 7, 1), (6, [0.0] * 7 + [None], 1), (None, [2.0] * 8, 1), (7, [1e30] * 8, 1)], KIND)
    got = C.cluster(df, 8, 8, 3)[0].collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "2", "7", "None"]
    assert all(r.distance == 0 and r.inertia == 0 for r in got)
    assert len({r.cluster for r in got if r.vec_id in (1, 2)}) == 1  # equal centroids: the smallest number
    assert C.cluster(df.limit(0), 8)[0].collect() == []


def test_hot_and_other_keys_meet_alike(spark):
    d = spark.createDataFrame([(i, None if i % 3 == 0 else i) for i in range(4000)], "id long, k long")
    keyed = d.groupBy("k").count().selectExpr("k", "count as n", "coalesce(k, -1) as got")
    out = V.with_key(d, keyed, "k", 4000).collect()
    assert len(out) == 4000 and all(r.got == (-1 if r.k is None else r.k) for r in out)
