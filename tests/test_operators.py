import math

import numpy as np
from pyspark.sql import functions as F

from palaver.operators.bands import blocks_of, cover_of
from palaver.operators import community
from palaver.operators.community import communities
from palaver.operators.components import connected_components
from palaver.operators import knn
from palaver.operators.knn import nearest_neighbours
from palaver.operators.matrix import debias, pick_kmeans
from palaver.operators.ordered import SLICE, with_dense_id, with_even_slice, with_previous, with_running_sum
from palaver.operators.percentiles import exact_percentiles
from palaver.operators.spectral import laplacian_eigenpairs
from palaver.plans.client import rerank
from palaver.plans.phrases import log_odds, log_odds_within


def test_percentiles_match_numpy_with_a_hot_group(spark):
    rng = np.random.default_rng(0)
    hot, cold = rng.integers(0, 5_000_000, 4000), rng.integers(0, 50, 7)
    df = spark.createDataFrame([("hot", int(x)) for x in hot] + [("cold", int(x)) for x in cold] + [("cold", None)], "k string, x bigint")
    got = {r["k"]: (r["a"], r["b"]) for r in exact_percentiles(df, ["k"], F.col("x"), {"a": 0.5, "b": 0.9}).collect()}
    for k, v in (("hot", hot), ("cold", cold)):
        assert np.allclose(got[k], np.quantile(v, [0.5, 0.9]))


def test_previous_row_and_running_sum_cross_slices(spark):
    df = spark.sql("SELECT id % 3 AS k, id AS i, TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, id * 7) AS t FROM range(60)")
    for rows_each in (7, 1000):
        sliced = with_running_sum(with_even_slice(df, ["k"], ["t", "i"], rows_each), ["k"], ["t", "i"], F.col("i"), "sum")
        got = {r["i"]: (r["prev_i"], r["sum"]) for r in with_previous(sliced, ["k"], ["t", "i"], ["i"]).collect()}
        assert got == {i: (i - 3 if i >= 3 else None, sum(range(i % 3, i + 1, 3))) for i in range(60)}


def test_one_conversation_at_one_instant_is_cut_evenly(spark):
    df = spark.sql("SELECT 1 AS k, id AS i, TIMESTAMP_NTZ '2024-01-01' AS t FROM range(20000)").union(
        spark.sql("SELECT 2 + id % 5, 20000 + id, TIMESTAMP_NTZ '2024-01-02' FROM range(50)")).repartition(6)
    sliced = with_even_slice(df, ["k"], ["t", "i"], 1000)
    sizes = [r["count"] for r in sliced.groupBy(SLICE).count().collect()]
    assert len(sizes) > 15 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    got = with_previous(with_running_sum(sliced, ["k"], ["t", "i"], F.lit(1), "n"), ["k"], ["t", "i"], ["i"])
    assert got.where("k = 1 AND (n != i + 1 OR NOT (prev_i <=> nullif(i - 1, -1)))").count() == 0
    assert got.where("k = 1").count() == 20000 and got.where("k > 1").agg(F.max("n")).first()[0] == 10


def test_dense_ids(spark):
    df = spark.sql("SELECT id * 5000 AS o FROM range(100)")
    got = [r["n"] for r in with_dense_id(df, "o", "n").orderBy("o").collect()]
    assert got == list(range(1, 101))


def test_bands_equal_brute_force(spark):
    values = spark.sql("SELECT id AS x FROM range(200)")
    bands = spark.createDataFrame([(0, 0), (3, 17), (5, 5), (64, 127), (0, 199), (50, 20)], "low long, high long")
    held = values.select("x", F.explode(blocks_of(F.col("x"))).alias("b")).select("x", "b.level", "b.block")
    asked = bands.select("low", "high", F.explode(cover_of(F.col("low"), F.col("high"))).alias("b")).select("low", "high", "b.level", "b.block")
    got = {(r["low"], r["high"]): sorted(r["xs"]) for r in asked.join(held, ["level", "block"]).groupBy("low", "high").agg(
        F.collect_list("x").alias("xs")).collect()}
    assert got == {(a, b): list(range(a, b + 1)) for a, b in [(0, 0), (3, 17), (5, 5), (64, 127), (0, 199)]}


def test_neighbours_equal_brute_force_with_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    x[20:50] = x[0]  # half of the rows are one vector
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<double>")
    got = {}
    for r in nearest_neighbours(df, k=5, block=8).orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    d = np.round(1 - u @ u.T, 9)
    for i in range(60):
        order = sorted((j for j in range(60) if j != i), key=lambda j: (abs(d[i, j]), j))
        assert got[i] == order[:5]


def test_neighbours_of_several_groups(spark):
    """More rows than one group of queries holds, text ids, many ties; a group keeps only its best rows."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(2500, 3)), 1)
    x = x[np.linalg.norm(x, axis=1) > 0]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    names = [f"{i % 7}:{i}" for i in range(len(x))]
    df = spark.createDataFrame([(n, [float(v) for v in row]) for n, row in zip(names, x)], "id string, embedding array<double>")
    got = {}
    for r in nearest_neighbours(df, k=9, block=100).orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append((round(r["dist"], 8), r["dst"]))
    assert len(got) == len(x) and all(len(v) == 9 for v in got.values())
    d = np.maximum(1 - u @ u.T, 0)
    for i in range(0, len(x), 50):
        best = np.sort(np.delete(d[i], i))[:9]
        assert np.allclose([a for a, _ in got[names[i]]], best, atol=1e-8) and names[i] not in [b for _, b in got[names[i]]]
        assert got[names[i]] == sorted(got[names[i]])
    best = knn._Best(np.arange(500), rng.normal(size=(500, 8)), 6)
    for _ in range(20):
        best.meet(np.arange(1000), rng.normal(size=(1000, 8)))
        best.merge()
        assert len(best.held[0]) == 500 * 6


def two_cliques(spark):
    edges = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 6) for b in range(a + 1, base + 6)]
    return spark.sql("SELECT id FROM range(6) UNION ALL SELECT id + 10 FROM range(6) UNION ALL SELECT 99L"), edges


def test_components_and_communities(spark):
    nodes, edges = two_cliques(spark)
    df = spark.createDataFrame(edges, "a long, b long, w double")
    labels = {r["id"]: r["component"] for r in connected_components(nodes, df).collect()}
    assert {labels[i] for i in range(6)} == {0} and {labels[i + 10] for i in range(6)} == {10} and labels[99] == 99
    joined = spark.createDataFrame(edges + [(5, 10, 0.5)], "a long, b long, w double")
    found = {r["id"]: r["cluster_id"] for r in communities(nodes, joined, (1.0,)).collect()}
    assert len({found[i] for i in range(6)}) == 1 and len({found[i + 10] for i in range(6)}) == 1 and found[0] != found[10]


def test_path_component(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n - 1)], "a long, b long, w double")
    nodes = spark.sql(f"SELECT id FROM range({n})")
    assert {r["component"] for r in connected_components(nodes, edges).collect()} == {0}


def test_laplacian_of_two_joined_cliques(spark):
    _nodes, edges = two_cliques(spark)
    edges = edges + [(5, 10, 0.1)]
    ids = sorted({i for a, b, _ in edges for i in (a, b)})
    w = np.zeros((12, 12))
    for a, b, x in edges:
        w[ids.index(a), ids.index(b)] = w[ids.index(b), ids.index(a)] = x
    d = w.sum(1)
    exact = np.sort(np.linalg.eigvalsh(np.eye(12) - w / np.sqrt(np.outer(d, d))))
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    values, vectors, _residuals = laplacian_eigenpairs(nodes, spark.createDataFrame(edges, "a long, b long, w double"), k=2)
    assert np.allclose(values, exact[:2], atol=1e-6) and vectors.count() == 12


def test_blobs_and_debias(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal([10, 0, 0], 0.1, (12, 3)), rng.normal([0, 10, 0], 0.1, (12, 3))])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<double>")
    rows, _centres, k, _scores = pick_kmeans(df, "embedding", range(2, 5))
    found = {r["id"]: r["cluster_id"] for r in rows.collect()}
    assert k == 2 and len({found[i] for i in range(12)}) == 1 and found[0] != found[12]
    clean = np.array([r["debiased"] for r in debias(df, "embedding", 1).collect()])
    top = np.linalg.eigh(np.cov((x - x.mean(0)).T))[1][:, -1]
    assert np.abs(clean @ top).max() < 1e-6


def test_log_odds_ranks_distinctive_phrases_first(spark):
    rows = [("t", "womp womp", 10), ("t", "sounds good", 10), ("b", "sounds good", 200)]
    counts = spark.createDataFrame(rows, "s string, phrase string, count long")
    got = [(r["phrase"], r["score"]) for r in log_odds_within(counts, "s", 1).where("scope = 't'").orderBy("rank").collect()]
    assert got[0][0] == "womp womp" and got[0][1] > 0 > got[1][1]
    assert log_odds_within(counts, "s", 11).where("scope = 't'").count() == 0


def test_communities_do_not_depend_on_the_graphs_beside_them(spark):
    rng = np.random.default_rng(6)
    rows = []
    for name, n, weight in (("small", 18, 1e-3), ("large", 60, 1e4)):
        for i in range(n):
            for j in range(i):
                if (i // 6 == j // 6 and rng.random() < 0.8) or rng.random() < 0.05:
                    rows.append((name, i, j, weight * float(rng.random() + 0.5)))
    edges = spark.createDataFrame(rows, "graph string, a long, b long, w double")
    nodes = edges.select("graph", F.col("a").alias("id")).unionByName(edges.select("graph", F.col("b").alias("id"))).distinct()
    both = communities(nodes, edges, (1.0,)).where("graph = 'small'")
    alone = communities(nodes.where("graph = 'small'"), edges.where("graph = 'small'"), (1.0,))
    assert sorted((r.id, r.cluster_id) for r in both.collect()) == sorted((r.id, r.cluster_id) for r in alone.collect())


def test_log_odds_of_a_scope_that_is_its_whole_corpus(spark):
    """All scores are rounding errors around zero: their order is that of the C library's logarithm."""
    n = 1_007_922
    rows = spark.range(5, 20005).selectExpr("'all' scope", "format_string('p%06d', id) phrase", "id count", "0L rest")
    totals = spark.createDataFrame([("all", n, 0)], "scope string, n_target long, n_background long")
    got = [r["phrase"] for r in log_odds(rows, totals, 5, 15).orderBy("rank").collect()]

    def score(y):
        a = 10.0 * (y + 0.0) / (n + 0.0)
        return (math.log((y + a) / (n + 10.0 - y - a)) - math.log((0.0 + a) / (0.0 + 10.0 - 0.0 - a))) / math.sqrt(1.0 / (y + a) + 1.0 / (0.0 + a))

    assert got == [f"p{y:06d}" for y in sorted(range(5, 20005), key=lambda y: (-score(float(y)), y))[:15]]


def test_ranks_count_all_contacts(spark):
    people = spark.range(1, 131).selectExpr("id person_id", "1000 - id total", "id sent", "timestamp'2024-01-30 00:00:00' last_ts")
    assert rerank(people, "sent", "2024-01-31 00:00:00").count() == 130
    shown = {r["person_id"]: r["rank"] for r in rerank(people, "sent", "2024-01-31 00:00:00", hide_quiet=True, shown=100).collect()}
    assert shown == {i: 131 - i for i in range(1, 101)}
    best = {r["person_id"]: r["rank"] for r in rerank(people, "sent", "2024-01-31 00:00:00", top=3).collect()}
    assert best == {1: 3, 2: 2, 3: 1}


def test_communities_of_several_parts(spark, monkeypatch):
    """Layers dealt to parts give what one part gives; rounds of a layer of one part write nothing, others write their mail and no edges."""
    rng = np.random.default_rng(8)
    rows = [(f"n{i:02d}", f"n{j:02d}", float(rng.random() + 0.5)) for i in range(48) for j in range(i) if rng.random() < (0.7 if i // 8 == j // 8 else 0.04)]
    edges = spark.createDataFrame(rows, "a string, b string, w double")
    nodes = spark.createDataFrame([(f"n{i:02d}",) for i in range(49)], "id string")
    written, materialize = [], community.materialize
    monkeypatch.setattr(community, "materialize", lambda df, name="step": written.append(name) or materialize(df, name))
    one = sorted(tuple(r) for r in communities(nodes, edges, (0.5, 2.0)).collect())
    assert "moved" not in written and len({c for _g, gamma, _id, c in one if gamma == 2.0}) >= 6
    monkeypatch.setattr(community, "NODES_EACH", 9)
    assert sorted(tuple(r) for r in communities(nodes, edges, (0.5, 2.0)).collect()) == one and "moved" in written
