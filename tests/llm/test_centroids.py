import hashlib
import math
import random

import numpy as np
import pytest

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string"


def brute(rows, k, rounds, d):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((i is None, "" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept)
    centers = [x for _, _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        for j, g in groups.items():
            centers[j] = [sum(c) // len(g) for c in zip(*g)]
    got = [(i, near(x)) for i, x in kept]
    spent = {}
    for _, (s, j) in got:
        spent[j] = spent.get(j, 0) + s
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, j, s, spent[j], sum(spent.values()), sha[j]) for i, (s, j) in got), key=str)


def vectors(seed, n, d, spread):
    r = random.Random(seed)
    centers = [[r.uniform(-spread, spread) * r.choice([0.1, 1, 3]) for _ in range(d)] for _ in range(9)]
    return [[x + r.gauss(0, spread / 4) for x in r.choice(centers)] for _ in range(n)]


@pytest.mark.parametrize("spread", [0.02, 1.0, 40.0])
def test_equals_brute_force(spark, spread):
    from loamstone.llm.centroids import clustered

    d = 6
    made = vectors(3, 220, d, spread)
    rows = [*enumerate(made)]
    rows += [(900 + i, list(made[7])) for i in range(60)]  # one vector of many rows
    rows += [(5, list(made[5])), (5, list(made[6])), (None, list(made[8])), (901, [0.0] * d), (902, [-0.0] * d)]  # repeated and null ids
    rows += [(903, None), (904, []), (905, [1.0] * (d + 1)), (906, [float("nan")] + [0.0] * (d - 1)), (907, [float("-inf")] + [0.0] * (d - 1)), (908, [None] + [0.0] * (d - 1))]
    df = spark.createDataFrame([(i, v, 1, "own", None) for i, v in rows], SCHEMA).repartition(5)
    for k, rounds in ((16, 3), (1, 2), (7, 0)):
        got = [tuple(x) for x in clustered(df, k, rounds, d).collect()]
        assert sorted(got, key=str) == brute(rows, k, rounds, d)


def test_few_and_no_vectors(spark):
    from loamstone.llm.centroids import clustered

    df = spark.createDataFrame([(1, [0.5, 1.0], 1, "", ""), (None, [3.0, 1.0], 1, "", "")], SCHEMA)
    assert sorted(x.cluster for x in clustered(df, 16, 3, 2).collect()) == [0, 1]
    out = clustered(df.limit(0), 16, 3, 2)
    assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert clustered(df, 16, 3, 64).collect() == []


def test_ties_go_to_the_smaller_number():
    from loamstone.llm.centroids import Annulus

    r = random.Random(2)
    for _ in range(300):
        c = np.array([[r.randint(-2, 2) for _ in range(3)] for _ in range(r.randint(1, 12))], dtype=np.int64)
        x = np.array([[r.randint(-2, 2) for _ in range(3)] for _ in range(20)], dtype=np.int64)
        chosen, best = Annulus(c).nearest(x)
        all_ = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert chosen.tolist() == all_.argmin(axis=1).tolist() and best.tolist() == all_.min(axis=1).tolist()


def test_large_components_stay_whole():
    from loamstone.llm.centroids import Annulus, integers

    bound = math.isqrt((1 << 62) // 8)
    assert integers(np.array([[1e300, -1e300]]), 64).tolist() == [[bound, -bound]]
    r = np.random.default_rng(1)
    c, x = r.integers(-(1 << 27), 1 << 27, (9, 64)), r.integers(-(1 << 27), 1 << 27, (50, 64))
    chosen, best = Annulus(c).nearest(x)
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x]
    assert best.tolist() == [min(e) for e in exact] and chosen.tolist() == [e.index(min(e)) for e in exact]
