import itertools
import math

import numpy as np

from palaver.llm import lattice

SCHEMA = "vec_id long, embedding array<float>, key string, cell long, ball string, sketch long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "k", 1, "b", 2) for i, v in rows], SCHEMA)


def sound(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, least=0.95):
    """vec_id, n_links, component_id, kept by all pairs."""
    n = len(rows)
    vectors = [np.array(v, np.float32).astype(float) if sound(v) else None for _, v in rows]
    links = [[] for _ in rows]
    for i, j in itertools.combinations(range(n), 2):
        a, b = vectors[i], vectors[j]
        if a is not None and b is not None and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
            links[i].append(j)
            links[j].append(i)
    out, low = [], [None] * n
    for i in range(n):
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), low[i], rows[i][0] == low[i]))
    return out


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(map(tuple, got), key=key) == sorted(want, key=key)


def near(rng, centre, cosine, n):
    """n unit vectors at a cosine to a centre."""
    noise = rng.normal(size=(n, len(centre)))
    noise -= np.outer(noise @ centre, centre)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return cosine * centre + math.sqrt(1 - cosine * cosine) * noise


def unit(rng, width=32):
    x = rng.normal(size=width)
    return x / np.linalg.norm(x)


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(400, 8)) * 1.5
    point = lattice.decode(y)
    doubled = np.rint(point * 2).astype(int)
    assert (np.abs(point * 2 - doubled) < 1e-12).all() and (doubled.sum(1) % 4 == 0).all() and ((doubled % 2).min(1) == (doubled % 2).max(1)).all()
    ball = np.array([p for s in (0.0, 0.5) for p in itertools.product(np.arange(-2, 3) + s, repeat=8) if abs(sum(p)) % 2 < 1e-9 and sum(x * x for x in p) <= 4.01])
    base = lattice.decode(y)
    away = ((y - base)[:, None, :] - ball[None, :, :]) ** 2
    order = np.sort(away.sum(2), axis=1)
    assert np.allclose(((y - point) ** 2).sum(1), order[:, 0])
    assert np.allclose(((y - lattice.next_nearest(y, point)) ** 2).sum(1), order[:, 1])
    assert len(lattice.SHORTEST) == 240 and np.allclose((lattice.SHORTEST ** 2).sum(1), 2)


def test_recall_of_pairs_at_the_least_cosine():
    """Share of pairs that meet in a home or probed cell; no later step loses a pair."""
    rng = np.random.default_rng(2)
    u = rng.normal(size=(4000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = np.concatenate([near(rng, x, 0.95, 1) for x in u])
    cells = lattice.Cells(64, 12, 2, 0.5, 13)
    (a, pa, sa), (b, pb, sb) = cells.of(u), cells.of(v)
    pa, pb = (p.reshape(len(u), 2, 12) for p in (pa, pb))
    met = (a == b) | (pa == b[:, None, :]).any(1) | (pb == a[:, None, :]).any(1)
    assert met.any(1).mean() >= 0.995
    assert np.bitwise_count((sa ^ sb).view(np.uint64)).max() <= 24
    strangers = np.roll(np.arange(len(u)), 1)
    assert (a == a[strangers]).mean() < 1e-3


def test_equal_to_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, unit(rng).tolist()) for i in range(120)]
    for k, cosine in enumerate((0.999, 0.99, 0.985, 0.976, 0.96)):  # tight to loose groups
        rows += [(1000 * (k + 1) + i, x.tolist()) for i, x in enumerate(near(rng, unit(rng), cosine, 60))]
    rows += [(90_000 + i, (np.array(rows[3][1]) * s).tolist()) for i, s in enumerate((1, 1, 2, 0.5, -1))]
    want = brute(rows)
    assert max(r[1] for r in want) == 59 and len({r[2] for r in want if r[1]}) < sum(r[1] > 0 for r in want)
    for limits in ({}, {"dense": 4, "tile": 16}):
        assert same(lattice.groups(frame(spark, rows), **limits).collect(), want), limits


def test_chains_of_groups(spark):
    """Balls that lie at about the allowed angle from each other are compared member by member."""
    rng = np.random.default_rng(4)
    a, b = unit(rng), unit(rng)
    b -= (b @ a) * a
    b /= np.linalg.norm(b)
    rows = []
    for k in range(5):
        centre = math.cos(0.3 * k) * a + math.sin(0.3 * k) * b
        rows += [(100 * k + i, x.tolist()) for i, x in enumerate(near(rng, centre, 0.9995, 40))]
    want = brute(rows)
    assert {r[2] for r in want} == {0} and len({r[1] for r in want}) > 5
    assert same(lattice.groups(frame(spark, rows), dense=8, tile=16).collect(), want)


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    x = unit(rng).tolist()
    rows = [(1, None), (2, []), (3, [None, 1.0]), (4, [float("nan")] * 4), (5, [float("inf"), 1.0]), (6, [0.0] * 32), (7, x), (7, x), (8, x), (None, x), (None, None),
            (9, x + [0.0]), (10, [1.0]), (11, [3.0]), (12, [-1.0]), (13, [1e-30] * 5), (14, [1e30] * 5), (15, (np.ones(4000)).tolist()), (16, (np.ones(4000) * 2).tolist())]
    assert same(lattice.groups(frame(spark, rows)).collect(), brute(rows))
    assert lattice.groups(frame(spark, [])).count() == 0
    assert same(lattice.groups(frame(spark, [(None, x), (None, x)])).collect(), [(None, 1, None, True)] * 2)
