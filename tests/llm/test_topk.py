import math

import numpy as np

from palaver.llm import topk


def brute(rows, every=50, k=5):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, u in {i: u for i, u in sorted(whole, reverse=True) if i % every == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in whole if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, block int, score string")


def test_equal_to_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=12) / 3]) for i in range(400)]
    rows += [(500 + i, rows[7][1]) for i in range(60)]  # one common vector, ties
    rows += [(900, None), (950, [0.1, None]), (1000, [float("nan")] * 12), (1050, [float("inf")] * 12), (1100, [0.5]), (1150, []), (1151, [0.0] * 12), (3, rows[3][1])]
    got = topk.top_k(frame(spark, rows), block_rows=100, query_rows=4, enough=5)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_fewer_than_k_and_empty(spark):
    rows = [(0, [1.0, -1.0]), (1, [0.5, 0.5]), (2, [-1.0, 1.0])]
    assert sorted(tuple(r) for r in topk.top_k(frame(spark, rows)).collect()) == brute(rows)
    assert topk.top_k(frame(spark, [])).count() == 0
    assert topk.top_k(frame(spark, [(0, [1.0])])).count() == 0


def test_stops_before_the_last_segment_only_with_proof():
    rng = np.random.default_rng(3)
    matrix = rng.integers(-90, 90, (3000, 16))
    matrix[17] = matrix[3] * 2  # far ahead of the rest
    index = topk.Segments(matrix)
    asked = np.array([3, 50, 99])
    allowed = np.arange(3000)[:, None] != asked[None, :]
    can, steps = index.possible(matrix[asked], allowed, 5, 200)
    assert steps < len(index.start)
    for i, q in enumerate(asked):
        exact = matrix @ matrix[q]
        exact[q] = -(10**15)
        assert set(np.lexsort((np.arange(3000), -exact))[:5]) <= set(np.flatnonzero(can[:, i])) and can[:, i].sum() <= 200 and not can[q, i]
    everything, _ = index.possible(matrix[asked], allowed, 3000, 1)
    assert (everything == allowed).all()
