"""Neighbour-graph queries G1-G35, J9 layouts and S8/S10 artifact reads."""
from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Window, functions as F

from palaver.functions import text as tx
from palaver.operators import matrix
from palaver.operators.community import communities
from palaver.operators.components import connected_components
from palaver.operators.knn import nearest_neighbours
from palaver.operators.percentiles import exact_percentiles
from palaver.operators.spectral import laplacian_eigenpairs
from palaver.plans import graph as g
from palaver.session import materialize, shared_dir
from palaver.sources.published import append_result, current, publish, results

from .base import ORACLES, QUERIES, Archive, r6, register, shape
from .oracle import FOLDED, STOP_LIST, TABLES
from .persons import r
from .sessions import (
    docs, first_labels, session_phrases, session_tokens, session_vectors, transcript_vectors, transcripts,
)
from .language import z_score

SWEEP = (10, 15, 20, 30, 50)
MIN_COMMUNITY = {0.5: 25, 1.0: 25, 2.0: 15, 4.0: 10}


def edges_sql(knn: str, k: int, mutual: bool = True, weight: str = "greatest(1 - dist, 0)") -> str:
    pick, having = ("min(w)", "HAVING count(*) = 2") if mutual else ("max(w)", "")
    return f"""
        SELECT least(src, dst) AS a, greatest(src, dst) AS b, {pick} AS w
        FROM (SELECT src, dst, {weight} AS w FROM {knn} WHERE rank <= {k}) GROUP BY 1, 2 {having}"""


def neighbours_sql(table: str, key: str) -> str:
    return f"""
        SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank
        FROM (SELECT x.{key} AS src, y.{key} AS dst,
                     greatest(round(1 - list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9), 0) AS dist
              FROM {table} x JOIN {table} y ON x.{key} <> y.{key}) QUALIFY rank <= 50"""


TABLES.update({
    "knn": neighbours_sql("embeddings", "vec_id"),
    "edges20": edges_sql("knn", 20),
    "ends20": "SELECT a AS id, b AS other, w FROM edges20 UNION ALL SELECT b, a, w FROM edges20",
    "sknn": neighbours_sql("session_vecs", "session_id"),
    "sedges20": edges_sql("sknn", 20),
    "sends20": "SELECT a AS id, b AS other, w FROM sedges20 UNION ALL SELECT b, a, w FROM sedges20",
    "doc_words": f"""
        SELECT DISTINCT vec_id AS id, word FROM (
            SELECT doc_id % (SELECT count(*) FROM embeddings) AS vec_id, unnest(regexp_extract_all({FOLDED}, '[a-z'']+')) AS word FROM documents)
        WHERE length(word) > 2 AND word NOT IN ({STOP_LIST})""",
    "sweep": "SELECT unnest([10, 15, 20, 30, 50]) AS k",
    "sweep_edges": """
        SELECT k, true AS mutual, least(src, dst) AS a, greatest(src, dst) AS b FROM knn JOIN sweep ON rank <= k GROUP BY ALL HAVING count(*) = 2
        UNION ALL SELECT DISTINCT k, false, least(src, dst), greatest(src, dst) FROM knn JOIN sweep ON rank <= k""",
    "sweep_ends": "SELECT k, mutual, a AS id, b AS other FROM sweep_edges UNION ALL SELECT k, mutual, b, a FROM sweep_edges",
    "sweep_nodes": "SELECT k, mutual, vec_id AS id FROM sweep, (SELECT unnest([true, false]) AS mutual), embeddings",
})


def nodes(a: Archive):
    return a.given("embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("bigint").alias("cluster_id"))


def labels(a: Archive):
    return nodes(a).select("id", "cluster_id")


def knn(a: Archive):
    return a.keep("knn", lambda: nearest_neighbours(nodes(a), 50))


def edges(a: Archive):
    return a.keep("edges20", lambda: g.knn_edges(knn(a), 20))


def doc_words(a: Archive):
    size = a.given("embeddings").count()
    words = a.given("documents").select(
        F.pmod("doc_id", F.lit(size)).alias("id"), F.explode(F.array_distinct(tx.found_words(F.col("text")))).alias("token"))
    return a.keep("doc_words", lambda: words.where((F.char_length("token") > 2) & tx.is_content_word(F.col("token"))).distinct())


def s_vectors(a: Archive):
    return session_vectors(a).select(F.col("session_id").alias("id"), "embedding")


def s_docs(a: Archive):
    return docs(a).withColumnRenamed("session_id", "id")


def s_texts(a: Archive):
    return transcripts(a).withColumnRenamed("session_id", "id")


def s_tokens(a: Archive):
    return session_tokens(a).withColumnRenamed("session_id", "id")


def s_knn(a: Archive):
    return a.keep("sknn", lambda: nearest_neighbours(s_vectors(a), 50))


def s_edges(a: Archive):
    return a.keep("sedges20", lambda: g.knn_edges(s_knn(a), 20))


def s_communities(a: Archive):
    return a.keep("session_communities", lambda: communities(s_vectors(a).select("id"), s_edges(a)))


def at(a: Archive, gamma: float):
    return s_communities(a).where(F.col("gamma") == gamma).select("id", "cluster_id")


def giant(a: Archive):
    return a.keep("giant", lambda: g.giant_component(s_vectors(a).select("id"), s_edges(a)))


def spectrum(a: Archive):
    """The 64 smallest eigenpairs of the giant component of the session graph, with their residuals."""
    if "_spectrum" not in a.__dict__:
        a.__dict__["_spectrum"] = laplacian_eigenpairs(giant(a), g.inside(s_edges(a), giant(a)), k=64)
    return a.__dict__["_spectrum"]


def spectral_labels(a: Archive):
    def build():
        found = spectrum(a)
        _rows, k = g.eigengaps(found.values)
        k = min(k, len(found.values))
        return matrix.kmeans(g.spectral_rows(found.vectors, k), "u", k, seed=0, measure="euclidean")[0].select("id", "cluster_id")

    return a.keep("spectral_labels", build)


TIMES = (1, 4, 16)


def diffusion_scores(a: Archive):
    """(t, silhouette of the spectral clusters in 32 diffusion coordinates) for each time."""
    if "_diffusion" not in a.__dict__:
        found = spectrum(a)
        a.__dict__["_diffusion"] = [(t, matrix.silhouette(g.diffusion(found.vectors, found.values, t).join(spectral_labels(a), "id"), "coords", measure="euclidean"))
                                    for t in TIMES]
    return a.__dict__["_diffusion"]


def best_time(a: Archive) -> int:
    return max(diffusion_scores(a), key=lambda x: (round(x[1], 3), -x[0]))[0]


def clean_vectors(a: Archive):
    """Session vectors without their mean and two leading axes."""
    return a.keep("session_clean", lambda: matrix.debias(s_vectors(a), "embedding", 2).select("id", F.col("debiased").alias("embedding")))


def density(a: Archive):
    """(spanning forest, leaf members, leaf levels) of the cleaned session vectors."""
    if "_density" not in a.__dict__:
        near = a.keep("clean_knn", lambda: nearest_neighbours(clean_vectors(a), 50))
        a.__dict__["_density"] = g.density_tree(near)
    return a.__dict__["_density"]


def density_labels(a: Archive):
    return a.keep("density_labels", lambda: g.density_labels(s_vectors(a).select("id"), density(a)[1]))


def kmeans_labels(a: Archive):
    def build():
        k = min(at(a, 1.0).select("cluster_id").distinct().count(), 30)
        return matrix.kmeans(clean_vectors(a), "embedding", max(k, 2), seed=0, measure="euclidean")[0].select("id", "cluster_id")

    return a.keep("kmeans_labels", build)


# ------------------------------------------------------- neighbours and graphs

@register("g1_nearest_neighbours", f"SELECT src, dst, rank, dist + 0.0 AS dist FROM knn")
def _(a: Archive):
    return shape(knn(a), src="n", dst="n", rank="n", dist="r")


@register("g1_session_neighbours", f"SELECT src, dst, rank, dist + 0.0 AS dist FROM sknn")
def _(a: Archive):
    return shape(s_knn(a), src="s", dst="s", rank="n", dist="r")


SIGMA = "(SELECT src AS node, greatest(dist, 1e-4) AS s FROM knn WHERE rank = 10)"


@register("g2_graph_weightings", f"""
    WITH ad AS (SELECT src, dst, rank, exp(-dist * dist / (x.s * y.s)) AS w FROM knn JOIN {SIGMA} x ON x.node = src JOIN {SIGMA} y ON y.node = dst)
    SELECT 'cosine mutual' AS kind, a, b, {r('w', 'w')} FROM edges20
    UNION ALL SELECT 'binary plain', a, b, {r('w', 'w')} FROM ({edges_sql('knn', 20, False, '1.0::DOUBLE')})
    UNION ALL SELECT 'adaptive mutual', a, b, {r('w', 'w')} FROM ({edges_sql('ad', 20, True, 'w')})""")
def _(a: Archive):
    def one(kind, rows):
        return rows.select(F.lit(kind).alias("kind"), "a", "b", r6("w").alias("w"))

    return one("cosine mutual", edges(a)).unionByName(one("binary plain", g.knn_edges(knn(a), 20, False, "binary"))).unionByName(
        one("adaptive mutual", g.knn_edges(knn(a), 20, True, "adaptive")))


STATS = f"""
    WITH cc(k, mutual, id, comp) USING KEY (k, mutual, id) AS (
        SELECT k, mutual, id, id FROM sweep_nodes
        UNION
        SELECT e.k, e.mutual, e.other, min(cc.comp)
        FROM cc JOIN sweep_ends e ON e.k = cc.k AND e.mutual = cc.mutual AND e.id = cc.id
        JOIN recurring.cc old ON old.k = e.k AND old.mutual = e.mutual AND old.id = e.other
        WHERE cc.comp < old.comp GROUP BY 1, 2, 3),
    parts AS (SELECT k, mutual, max(n) AS giant, count(*) AS n_components FROM (SELECT k, mutual, comp, count(*) AS n FROM cc GROUP BY ALL) GROUP BY 1, 2),
    deg AS (SELECT n.k, n.mutual, n.id, count(e.other) AS d FROM sweep_nodes n LEFT JOIN sweep_ends e USING (k, mutual, id) GROUP BY 1, 2, 3),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY k, mutual ORDER BY d DESC, id) AS i, count(*) OVER (PARTITION BY k, mutual) AS n FROM deg),
    st AS (SELECT k, mutual, median(d) AS median_degree, avg((d = 0)::INT) AS isolated, any_value(n) AS n,
                  sum(d) FILTER (i <= greatest(n // 100, 1)) / greatest(sum(d), 1) AS top1 FROM ranked GROUP BY 1, 2)
    SELECT k::BIGINT AS k, mutual, {r('giant / n', 'giant_frac')}, n_components, {r('median_degree', 'median_degree')},
           {r('isolated', 'isolated_frac')}, {r('top1', 'top1pct_degree_share')}"""


def sweep_graphs(a: Archive):
    def build():
        out = None
        for k in SWEEP:
            for mutual in (False, True):
                part = g.knn_edges(knn(a), k, mutual).withColumns({"k": F.lit(k), "mutual": F.lit(mutual)})
                out = part if out is None else out.unionByName(part)
        return out

    every = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("mutual")) for k in SWEEP for m in (False, True)]))
    return nodes(a).select("id", every.alias("x")).select("id", "x.k", "x.mutual"), a.keep("sweep_edges", build)


@register("g3_graph_stats", STATS + " FROM parts JOIN st USING (k, mutual)")
def _(a: Archive):
    rows = a.keep("sweep_stats", lambda: g.graph_stats(*sweep_graphs(a), ["k", "mutual"]))
    return shape(rows, k="n", mutual="b", giant_frac="d", n_components="n", median_degree="d", isolated_frac="d", top1pct_degree_share="d")


@register("g4_connected_components", """
    WITH cc(id, comp) USING KEY (id) AS (
        SELECT vec_id, vec_id FROM embeddings UNION
        SELECT e.other, min(cc.comp) FROM cc JOIN ends20 e ON e.id = cc.id JOIN recurring.cc old ON old.id = e.other
        WHERE cc.comp < old.comp GROUP BY 1)
    SELECT id, comp AS component FROM cc""")
def _(a: Archive):
    return connected_components(nodes(a).select("id"), edges(a))


@register("g5_edge_sample", f"SELECT a, b, {r('w', 'w')} FROM edges20 ORDER BY md5('0,' || a || ',' || b), a, b LIMIT 2000")
def _(a: Archive):
    return shape(g.edge_sample(edges(a), 2000, 0), a="n", b="n", w="d")


JACCARD = """
    (SELECT {keys}avg(both_ / (na.n + nb.n - both_)) AS j FROM (
        SELECT {keys}e.a, e.b, count(y.word) AS both_ FROM {edges} e LEFT JOIN doc_words x ON x.id = e.a
        LEFT JOIN doc_words y ON y.id = e.b AND y.word = x.word GROUP BY ALL) p
     JOIN (SELECT id, count(*) AS n FROM doc_words GROUP BY 1) na ON na.id = p.a
     JOIN (SELECT id, count(*) AS n FROM doc_words GROUP BY 1) nb ON nb.id = p.b {group})"""


@register("g6_edge_word_overlap", f"SELECT {r('j', 'jaccard')} FROM {JACCARD.format(keys='', edges='edges20', group='')}")
def _(a: Archive):
    return shape(g.edge_jaccard(edges(a), doc_words(a)), jaccard="d")


@register("g7_same_chat_fraction", f"""
    SELECT {r('avg((x.chat_id = y.chat_id)::INT)', 'same_chat')} FROM sedges20 JOIN docs x ON x.session_id = a JOIN docs y ON y.session_id = b""")
def _(a: Archive):
    return shape(g.same_chat_fraction(s_edges(a), s_docs(a)), same_chat="d")


@register("g8_communities")
def _(a: Archive):
    return s_communities(a).groupBy("gamma", "cluster_id").agg(F.count(F.lit(1)).alias("size")).orderBy("gamma", "cluster_id")


@register("g8_community_modularity")
def _(a: Archive):
    out = None
    for gamma in (0.5, 1.0, 2.0, 4.0):
        single = s_vectors(a).select("id").withColumn("cluster_id", F.xxhash64("id"))
        row = g.modularity(s_edges(a), at(a, gamma), gamma).select(F.lit(gamma).alias("gamma"), r6("modularity").alias("modularity")).withColumn(
            "singletons", r6(g.modularity(s_edges(a), single, gamma).scalar()))
        out = row if out is None else out.unionByName(row)
    return out


VOLUMES = """
    vol AS (SELECT label AS c, sum(w) AS v FROM ends20 JOIN embeddings ON vec_id = id GROUP BY 1),
    inn AS (SELECT x.label AS c, 2 * sum(w) AS i FROM edges20 JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b
            WHERE x.label = y.label GROUP BY 1),
    cl AS (SELECT label AS c, count(*) AS size FROM embeddings GROUP BY 1),
    tot AS (SELECT 2 * sum(w) AS m FROM edges20)"""


@register("g9_modularity", f"""
    WITH {VOLUMES} SELECT {r('sum(coalesce(i, 0) / m - (v / m) ** 2)', 'modularity')} FROM vol LEFT JOIN inn USING (c), tot""")
def _(a: Archive):
    return shape(g.modularity(edges(a), labels(a)), modularity="d")


COND = "CASE WHEN least(coalesce(v, 0), m - coalesce(v, 0)) <= 1e-12 THEN 1 ELSE (v - coalesce(i, 0)) / least(v, m - v) END"


@register("g10_conductance", f"""
    WITH {VOLUMES} SELECT c::BIGINT AS cluster_id, size, {r(COND, 'conductance')} FROM cl LEFT JOIN vol USING (c) LEFT JOIN inn USING (c), tot""")
def _(a: Archive):
    return shape(g.conductance(edges(a), labels(a)), cluster_id="n", size="n", conductance="d")


@register("g10_mean_top_conductance", f"""
    WITH {VOLUMES}, x AS (SELECT {COND} AS k FROM cl LEFT JOIN vol USING (c) LEFT JOIN inn USING (c), tot ORDER BY size DESC, c LIMIT 10)
    SELECT {r('avg(k)', 'mean_conductance')} FROM x""")
def _(a: Archive):
    return shape(g.mean_top_conductance(edges(a), labels(a)), mean_conductance="d")


CENTRES = """
    cen AS (SELECT label AS c, n, list(x ORDER BY i) AS centre FROM (
        SELECT label, i, count(*) AS n, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
        GROUP BY 1, 2) GROUP BY 1, 2)"""


@register("g11_coherence", f"""
    WITH {CENTRES} SELECT {r('avg(list_cosine_similarity(embedding::DOUBLE[], centre))', 'coherence')} FROM embeddings JOIN cen ON c = label WHERE n >= 5""")
def _(a: Archive):
    return shape(g.coherence(nodes(a), labels(a)), coherence="d")


GIANT = """
    cc(id, comp) USING KEY (id) AS (
        SELECT session_id, session_id FROM session_vecs UNION
        SELECT e.other, min(cc.comp) FROM cc JOIN sends20 e ON e.id = cc.id JOIN recurring.cc old ON old.id = e.other
        WHERE cc.comp < old.comp GROUP BY 1),
    giant AS (SELECT count(*) AS n FROM cc GROUP BY comp ORDER BY n DESC, comp LIMIT 1)"""


@register("g12_laplacian_eigenvalues")
def _(a: Archive):
    found = spectrum(a)
    rows = [(i + 1, round(float(x), 6), float(d), bool(d < 1e-6)) for i, (x, d) in enumerate(zip(found.values, found.residuals))]
    return a.spark.createDataFrame(rows, "k int, value double, residual double, settled boolean")


@register("g12_spectrum_invariants", f"""
    WITH {GIANT} SELECT least(64, n - 2)::BIGINT AS pairs, 0.0::DOUBLE AS lowest, least(64, n - 2)::BIGINT AS settled, 0.0::DOUBLE AS off_diagonal, true AS ascending FROM giant""")
def _(a: Archive):
    """How many pairs there are, the first one (0 for a connected graph), residuals below 1e-6, and how far the vectors are from orthonormal."""
    found = spectrum(a)
    k = len(found.values)
    cells = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: F.element_at("vector", i) * F.element_at("vector", j)))
    sums = found.vectors.select(F.posexplode(F.flatten(cells)).alias("cell", "x")).groupBy("cell").agg(F.sum("x").alias("x"))
    off = sums.agg(F.max(F.abs(F.col("x") - F.when(F.floor(F.col("cell") / k) == F.col("cell") % k, 1.0).otherwise(0.0))).alias("off"))
    return off.select(F.lit(k).cast("bigint").alias("pairs"), F.lit(round(float(found.values[0]), 6) + 0.0).alias("lowest"),
                      F.lit(int((found.residuals < 1e-6).sum())).cast("bigint").alias("settled"), (F.round("off", 6) + F.lit(0.0)).alias("off_diagonal"),
                      F.lit(bool((np.diff(found.values) >= -1e-9).all())).alias("ascending"))


@register("g13_largest_eigengaps")
def _(a: Archive):
    rows, k = g.eigengaps(spectrum(a).values)
    return a.spark.createDataFrame([(i, round(x, 6), round(d, 6), k) for i, x, d in rows], "k int, value double, gap double, chosen int")


@register("m8_cluster_number_by_eigengap")
def _(a: Archive):
    """Number of topics: eigengap of the neighbour graph of all debiased text vectors."""
    chosen = a.keep("debiased_vectors", lambda: matrix.debias(a.given("embeddings"), "embedding", 3).select(
        F.col("vec_id").alias("id"), F.col("debiased").alias("embedding")))
    values = g.neighbour_spectrum(chosen)
    k = g.eigengap_number(values)
    return a.spark.createDataFrame([(i, round(float(values[i] - values[i - 1]), 6), i == k) for i in range(8, min(24, len(values) - 1) + 1)], "k int, gap double, chosen boolean")


@register("g14_spectral_clusters")
def _(a: Archive):
    return spectral_labels(a).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


@register("g15_diffusion_silhouette")
def _(a: Archive):
    best = best_time(a)
    return a.spark.createDataFrame([(t, round(s, 6), t == best) for t, s in diffusion_scores(a)], "t int, silhouette double, best boolean")


@register("g16_density_clusters")
def _(a: Archive):
    return density_labels(a).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


@register("g16_density_tree", """
    SELECT (SELECT count(*) FROM session_vecs) AS nodes, true AS is_forest, true AS all_large, true AS all_connected, true AS all_separate, true AS some""")
def _(a: Archive):
    """Checks on the written tree: no cycles, and every cluster is connected below its level, large and cut off at it."""
    forest, leaves, levels = (x for x in density(a))
    sides = [leaves.select(F.col("id").alias(e), F.col("core").alias(f"core_{e}")) for e in "ab"]
    seen = forest.join(sides[0], "a", "left").join(sides[1], "b", "left")
    inner = seen.where("core_a = core_b").groupBy(F.col("core_a").alias("core")).agg(F.count(F.lit(1)).alias("inner_edges"), F.max("w").alias("highest"))
    border = seen.where("NOT (core_a <=> core_b)").select(F.explode(F.array_compact(F.array("core_a", "core_b"))).alias("core"), "w").groupBy("core").agg(F.min("w").alias("border"))
    rows = leaves.groupBy("core").agg(F.count(F.lit(1)).alias("n")).join(levels, "core").join(inner, "core", "left").join(border, "core", "left")
    facts = rows.agg(F.min(F.col("n") >= 10).alias("all_large"), F.min((F.col("inner_edges") == F.col("n") - 1) & F.coalesce(F.col("highest") <= F.col("level"), F.lit(True))).alias("all_connected"),
                     F.min(F.coalesce(F.col("border") >= F.col("level"), F.lit(True))).alias("all_separate"), (F.count(F.lit(1)) > 0).alias("some"))
    parts = connected_components(s_vectors(a).select("id"), forest).select("component").distinct().count()
    n = s_vectors(a).count()
    return facts.select(F.lit(n).cast("bigint").alias("nodes"), F.lit(forest.count() == n - parts).alias("is_forest"), "all_large", "all_connected", "all_separate", "some")


@register("g17_kmeans_baseline")
def _(a: Archive):
    return kmeans_labels(a).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


@register("g18_adjusted_rand", f"""
    WITH c AS (SELECT label AS x, vec_id % 7 + 10 * (label // 3) AS y, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1, 2),
    s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS b, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY x)) AS px,
                 (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY y)) AS py, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS al)
    SELECT {r('(b - px * py / al) / ((px + py) / 2 - px * py / al)', 'ari')} FROM s""")
def _(a: Archive):
    other = labels(a).select("id", (F.pmod("id", F.lit(7)) + 10 * F.floor(F.col("cluster_id") / 3)).alias("cluster_id"))
    return shape(g.adjusted_rand(labels(a), other), ari="d")


# ------------------------------------------------------------- descriptions

PHRASES = f"""
    al AS (SELECT phrase, sum(n) AS k FROM session_grams GROUP BY 1),
    tg AS (SELECT cluster_id, phrase, sum(n) AS y FROM session_grams JOIN first_labels USING (session_id) GROUP BY 1, 2),
    nt AS (SELECT cluster_id, sum(y)::DOUBLE AS nt FROM tg GROUP BY 1),
    z AS (SELECT cluster_id, phrase, y, {z_score('y::DOUBLE', '(k - y)::DOUBLE', 'nt', '((SELECT sum(n) FROM session_grams)::DOUBLE - nt)')} AS score
          FROM tg JOIN al USING (phrase) JOIN nt USING (cluster_id) WHERE y >= 3),
    ph AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, phrase) AS rank FROM z QUALIFY rank <= 6)"""


@register("g19_cluster_phrases", f"WITH {PHRASES} SELECT cluster_id, phrase, y::BIGINT AS count, {r('score', 'score')}, rank FROM ph")
def _(a: Archive):
    return shape(g.cluster_phrases(session_phrases(a), first_labels(a)), cluster_id="n", phrase="s", count="n", score="d", rank="n")


CENTRAL = """
    cen AS (SELECT cluster_id, size, list(x ORDER BY i) AS centre FROM (
        SELECT cluster_id, i, count(*) AS size, avg(x) AS x FROM (
            SELECT cluster_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM session_vecs JOIN first_labels USING (session_id))
        GROUP BY 1, 2) GROUP BY 1, 2),
    near AS (SELECT cluster_id, session_id, row_number() OVER (PARTITION BY cluster_id
                    ORDER BY round(list_cosine_similarity(embedding, centre), 9) DESC, session_id) AS rank
             FROM session_vecs JOIN first_labels USING (session_id) JOIN cen USING (cluster_id))"""


@register("g20_central_examples", f"""
    WITH {CENTRAL} SELECT cluster_id, rank, session_id AS id, left(replace(disp_text, chr(10), ' · '), 420) AS snippet
    FROM near JOIN conv USING (session_id) WHERE rank <= 3""")
def _(a: Archive):
    rows = g.snippets(g.central_members(s_vectors(a), first_labels(a)), s_texts(a), "disp_text", 420)
    return shape(rows, cluster_id="n", rank="n", id="s", snippet="s")


CONTACTS = """
    cc AS (SELECT cluster_id, contact, count(*) AS n FROM docs JOIN first_labels USING (session_id) GROUP BY 1, 2),
    tc AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, contact) AS rank, sum(n) OVER (PARTITION BY cluster_id) AS size FROM cc)"""


@register("g21_top_contact", f"WITH {CONTACTS} SELECT cluster_id, contact, n, size::BIGINT AS size, {r('n / size', 'share')} FROM tc WHERE rank = 1")
def _(a: Archive):
    return shape(g.top_contacts(s_docs(a), first_labels(a)), cluster_id="n", contact="s", n="n", size="n", share="d")


@register("g22_community_profiles", f"""
    WITH {CONTACTS}, ct AS (SELECT cluster_id, string_agg(contact || ' ' || n, ', ' ORDER BY rank) AS contacts FROM tc WHERE rank <= 5 GROUP BY 1),
    yr AS (SELECT cluster_id, string_agg(y || ' ' || n, ', ' ORDER BY y) AS years FROM (
        SELECT cluster_id, strftime(start_ts, '%Y') AS y, count(*) AS n FROM docs JOIN first_labels USING (session_id) GROUP BY 1, 2) GROUP BY 1)
    SELECT cluster_id, count(*) AS size, {r('sum(n_from_me) / sum(n_msgs)', 'from_me_frac')}, {r('avg(initiated_by_me::INT)', 'initiated_frac')},
           floor(median(n_msgs))::BIGINT AS median_msgs, any_value(contacts) AS contacts, any_value(years) AS years
    FROM docs JOIN first_labels USING (session_id) JOIN ct USING (cluster_id) JOIN yr USING (cluster_id) GROUP BY 1 HAVING count(*) >= 25""")
def _(a: Archive):
    rows = g.profiles(s_docs(a), first_labels(a), 25)
    size = F.col("size")
    contacts = F.transform("top_contacts", lambda x: F.concat(x["contact"], F.lit(" "), F.round(x["share"] * size).cast("bigint").cast("string")))
    years = F.transform(F.map_entries("years"), lambda x: F.concat(x["key"], F.lit(" "), x["value"].cast("string")))
    rows = rows.withColumn("contacts", F.array_join(contacts, ", ")).withColumn("years", F.array_join(years, ", "))
    return shape(rows, cluster_id="n", size="n", from_me_frac="d", initiated_frac="d", median_msgs="n", contacts="s", years="s")


@register("g23_parent_links", """
    WITH c AS (SELECT vec_id % 7 AS cluster_id, label::BIGINT AS parent_cluster_id, count(*) AS n FROM embeddings GROUP BY 1, 2)
    SELECT cluster_id, parent_cluster_id FROM c
    QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, parent_cluster_id) = 1""")
def _(a: Archive):
    fine = nodes(a).select("id", F.pmod("id", F.lit(7)).alias("cluster_id"))
    return shape(g.parents(fine, labels(a)), cluster_id="n", parent_cluster_id="n")


@register("g24_small_niches")
def _(a: Archive):
    """Density clusters of 8 to 60 sessions with phrases of their own, smallest first."""
    described = g.describe(s_docs(a), s_vectors(a), s_texts(a), session_phrases(a), s_edges(a), density_labels(a), None, 8, 5, 60)
    return shape(g.niches(described), cluster_id="n", size="n", conductance="d", phrases="s", top_contact="s", top_contact_share="d", example="s")


@register("g25_label_reuse", f"""
    WITH {PHRASES}, sz AS (SELECT cluster_id, count(*) AS size FROM first_labels GROUP BY 1)
    SELECT cluster_id, size, CASE WHEN cluster_id % 2 = 0 THEN 'kept ' || cluster_id ELSE coalesce(words, 'unlabeled') END AS label
    FROM sz LEFT JOIN (SELECT cluster_id, string_agg(phrase, ', ' ORDER BY rank) AS words FROM ph WHERE rank <= 2 GROUP BY 1) USING (cluster_id)""")
def _(a: Archive):
    sizes = first_labels(a).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).withColumn("gamma", F.lit(1.0))
    known = sizes.where(F.pmod("cluster_id", F.lit(2)) == 0).withColumn("label", F.concat(F.lit("kept "), F.col("cluster_id").cast("string")))
    words = g.cluster_phrases(session_phrases(a), first_labels(a)).withColumn("gamma", F.lit(1.0))
    return shape(g.label_communities(sizes, known, words), cluster_id="n", size="n", label="s")


@register("g26_sweep_table", STATS + f""", {r('j', 'jaccard')} FROM parts JOIN st USING (k, mutual)
    JOIN {JACCARD.format(keys='k, mutual, ', edges='sweep_edges', group='GROUP BY k, mutual')} jac USING (k, mutual)""")
def _(a: Archive):
    graph_nodes, graph_edges = sweep_graphs(a)
    stats = a.keep("sweep_stats", lambda: g.graph_stats(graph_nodes, graph_edges, ["k", "mutual"]))
    rows = stats.join(g.edge_jaccard(graph_edges, doc_words(a), ["k", "mutual"]), ["k", "mutual"])
    return shape(rows, k="n", mutual="b", giant_frac="d", n_components="n", median_degree="d", isolated_frac="d", top1pct_degree_share="d", jaccard="d")


def quality_row(name: str, graph_edges, labelled, vectors):
    """clusters, modularity, mean conductance and coherence of one labeling, as one written row."""
    labelled = materialize(labelled, "labeling")
    clusters = labelled.where("cluster_id >= 0").agg(F.count_distinct("cluster_id").alias("clusters"))
    row = clusters.select(F.lit(name).alias("name"), "clusters").withColumns({
        "modularity": g.modularity(graph_edges, labelled).scalar(),
        "mean_conductance": g.mean_top_conductance(graph_edges, labelled).scalar(),
        "coherence": g.coherence(vectors, labelled).scalar()})
    return materialize(row, "quality")


def stacked(rows):
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


@register("g27_edge_weightings")
def _(a: Archive):
    kinds = ("binary", "cosine", "adaptive")
    parts = {k: a.keep(f"sedges_{k}", lambda k=k: g.knn_edges(s_knn(a), 20, True, k)) for k in kinds}
    graph_edges = stacked([parts[k].withColumn("graph", F.lit(k)) for k in kinds])
    graph_nodes = s_vectors(a).select("id", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("graph"))
    found = a.keep("weighting_communities", lambda: communities(graph_nodes, graph_edges, (1.0,)))
    rows = a.keep("weightings", lambda: stacked([
        quality_row(k, parts[k], found.where(F.col("graph") == k).select("id", "cluster_id"), s_vectors(a)) for k in kinds]))
    best = rows.agg(F.max_by("name", F.col("modularity") - F.col("mean_conductance"))).scalar()
    return shape(rows.withColumn("best", F.col("name") == best), name="s", clusters="n", modularity="d", mean_conductance="d", coherence="d", best="b")


def representations(a: Archive):
    plain = {"weighted-mean": s_vectors(a), "conversation": transcript_vectors(a).select(F.col("session_id").alias("id"), "embedding")}
    out = {}
    for name, rows in plain.items():
        out[name] = rows
        out[f"{name} debiased"] = a.keep(f"{name}-debiased", lambda rows=rows: matrix.debias(rows, "embedding", 2).select(
            "id", F.col("debiased").alias("embedding")))
    return out


def representation_edges(a: Archive):
    out = {}
    for name, rows in representations(a).items():
        out[name] = a.keep(f"edges-{name}", lambda rows=rows: g.knn_edges(nearest_neighbours(rows, 20), 20, True, "adaptive"))
    return out


@register("g28_representations")
def _(a: Archive):
    parts, vectors = representation_edges(a), representations(a)
    graph_edges = stacked([e.withColumn("graph", F.lit(k)) for k, e in parts.items()])
    graph_nodes = stacked([rows.select("id", F.lit(k).alias("graph")) for k, rows in vectors.items()])
    found = a.keep("representation_communities", lambda: communities(graph_nodes, graph_edges, (1.0,)))
    giants = a.keep("representation_stats", lambda: g.graph_stats(graph_nodes, graph_edges, ["graph"]))
    words = s_tokens(a)
    rows = a.keep("representations", lambda: stacked([
        materialize(quality_row(k, parts[k], found.where(F.col("graph") == k).select("id", "cluster_id"), vectors[k]).withColumns({
            "jaccard": g.edge_jaccard(parts[k], words).scalar(),
            "same_chat": g.same_chat_fraction(parts[k], s_docs(a)).scalar()}), "representation") for k in parts]))
    rows = rows.join(giants.select(F.col("graph").alias("name"), "giant_frac"), "name")
    best = rows.agg(F.max_by("name", F.col("jaccard") - 0.3 * F.col("same_chat"))).scalar()
    return shape(rows.withColumn("best", F.col("name") == best), name="s", jaccard="d", same_chat="d", giant_frac="d", clusters="n",
                 modularity="d", coherence="d", best="b")


@register("g29_method_comparison")
def _(a: Archive):
    """Each method's clusters, those of at least five, median size, share of noise, conductance, coherence and agreement."""
    methods = {f"communities {gamma}": at(a, gamma) for gamma in (0.5, 1.0, 2.0, 4.0)}
    methods.update({"density": density_labels(a), "k-means": kmeans_labels(a), "spectral": spectral_labels(a)})
    reference = at(a, 1.0)
    rows = a.keep("methods", lambda: stacked([
        materialize(quality_row(name, s_edges(a), found, s_vectors(a)).withColumn("ari", g.adjusted_rand(reference, found).scalar()), "method")
        for name, found in methods.items()]))
    sized = stacked([found.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).withColumn("name", F.lit(name)) for name, found in methods.items()])
    sized = a.keep("method_sizes", lambda: sized)
    large = sized.groupBy("name").agg(
        F.sum(((F.col("cluster_id") >= 0) & (F.col("size") >= 5)).cast("bigint")).alias("large"),
        (F.sum(F.when(F.col("cluster_id") < 0, F.col("size")).otherwise(0)) / F.sum("size")).alias("noise_share"))
    median = exact_percentiles(sized.where("cluster_id >= 0"), ["name"], F.col("size"), {"median_size": 0.5})
    return shape(rows.join(large, "name").join(median, "name", "left"), name="s", clusters="n", large="n", median_size="d", noise_share="d",
                 mean_conductance="d", coherence="d", ari="d")


def map_rows(a: Archive):
    """Coordinates of the giant component in diffusion space and the labelled community per resolution."""

    def build():
        found, t = spectrum(a), best_time(a)
        rows = g.layout(g.diffusion(found.vectors, found.values, t), ["x3", "y3", "z3"]).select("id", "x3", "y3", "z3")
        flat = g.layout(g.diffusion(found.vectors, found.values, t), ["x", "y"]).select("id", "x", "y")
        rows = rows.join(flat, "id")
        for gamma, name in ((0.5, "c05"), (1.0, "c1"), (2.0, "c2"), (4.0, "c4")):
            sized = at(a, gamma)
            big = sized.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COMMUNITY[gamma])
            rows = rows.join(sized.join(big.select("cluster_id"), "cluster_id", "left_semi").withColumnRenamed("cluster_id", name), "id", "left")
            rows = rows.withColumn(name, F.coalesce(name, F.lit(-1)))
        facts = s_docs(a).select("id", "contact", F.date_format("start_ts", "yyyy-MM-dd").alias("start_ts"), "n_msgs")
        snippet = s_texts(a).select("id", F.left(F.replace(F.col("disp_text"), F.lit("\n"), F.lit(" · ")), F.lit(140)).alias("snippet"))
        return rows.join(facts, "id").join(snippet, "id").withColumnRenamed("id", "session_id")

    return a.keep("session_map", build)


@register("g30_session_map")
def _(a: Archive):
    return shape(map_rows(a), session_id="s", x="d", y="d", x3="d", y3="d", z3="d", c05="n", c1="n", c2="n", c4="n", contact="s",
                 start_ts="s", n_msgs="n", snippet="s")


def layout_variants(a: Archive):
    def build():
        found = spectrum(a)
        return stacked([g.layout(g.diffusion(found.vectors, found.values, t), ["x3", "y3", "z3"]).select(
            F.col("id").alias("session_id"), F.lit(float(t)).alias("t"), "x3", "y3", "z3") for t in TIMES])

    return a.keep("layout_variants", build)


@register("g31_layout_by_variant")
def _(a: Archive):
    chosen = layout_variants(a).where(F.abs(F.col("t") - 4.0) < 1e-9)
    rows = map_rows(a).select("session_id").join(chosen, "session_id").orderBy("session_id")
    return shape(rows, session_id="s", x3="d", y3="d", z3="d")


def community_rows(a: Archive):
    def build():
        out = []
        coarser, above = None, None
        for gamma in (0.5, 1.0, 2.0, 4.0):
            found = at(a, gamma)
            rows = g.profiles(s_docs(a), found, MIN_COMMUNITY[gamma]).withColumn("gamma", F.lit(gamma))
            up = g.parents(found, coarser) if coarser is not None else None
            rows = rows.join(up, "cluster_id", "left") if up is not None else rows.withColumn("parent_cluster_id", F.lit(None).cast("int"))
            words = g.cluster_phrases(session_phrases(a), found, limit=8).withColumn("gamma", F.lit(gamma))
            none = rows.select("gamma", "cluster_id", "size").where("false").withColumn("label", F.lit(""))
            listed = words.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda x: x["phrase"]).alias("phrases"))
            central = g.snippets(g.central_members(s_vectors(a), found.join(rows.select("cluster_id"), "cluster_id", "left_semi")), s_texts(a), "disp_text", 420)
            examples = central.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "snippet"))), lambda x: x["snippet"]).alias("examples"))
            rows = g.label_communities(rows, none, words).join(listed, "cluster_id", "left").join(examples, "cluster_id", "left")
            out.append(materialize(rows.select(
                "gamma", "cluster_id", "label", "size", F.coalesce("phrases", F.array().cast("array<string>")).alias("phrases"), "top_contacts", "years", "from_me_frac",
                "initiated_frac", "median_msgs", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"),
                F.when(F.col("parent_cluster_id").isNotNull(), F.lit(above).cast("double")).alias("parent_gamma"),
                F.col("parent_cluster_id").cast("int").alias("parent_cluster_id")), "profiles"))
            coarser, above = found, gamma
        return stacked(out)

    return a.keep("semantic_communities", build)


@register("g32_community_list")
def _(a: Archive):
    rows = semantic_tables(a)["semantic_communities"]
    rows = rows.withColumns({c: F.to_json(c) for c in ("phrases", "top_contacts", "years", "examples")})
    return rows.orderBy("gamma", F.desc("size"), "cluster_id")


@register("g33_map_points_and_parameters")
def _(a: Archive):
    points = map_rows(a).select(F.lit("point").alias("kind"), "session_id", r6("x3").alias("value"))
    parameters = layout_variants(a).select("t").distinct().select(F.lit("parameter").alias("kind"), F.lit("").alias("session_id"), F.col("t").alias("value"))
    return points.unionByName(parameters).orderBy("kind", "session_id", "value")


SVOL = """
    svol AS (SELECT cluster_id, sum(w) AS v FROM sends20 JOIN first_labels ON session_id = id GROUP BY 1),
    sinn AS (SELECT x.cluster_id, 2 * sum(w) AS i FROM sedges20 JOIN first_labels x ON x.session_id = a JOIN first_labels y ON y.session_id = b
             WHERE x.cluster_id = y.cluster_id GROUP BY 1),
    scl AS (SELECT cluster_id, count(*) AS size FROM first_labels GROUP BY 1), stot AS (SELECT 2 * sum(w) AS m FROM sedges20)"""


@register("g34_cluster_descriptions", f"""
    WITH {PHRASES}, {CENTRAL}, {CONTACTS}, {SVOL},
    top AS (SELECT cluster_id, size, {COND} AS cond FROM scl LEFT JOIN svol USING (cluster_id) LEFT JOIN sinn USING (cluster_id), stot
            WHERE size >= 5 ORDER BY size DESC, cluster_id LIMIT 14),
    w AS (SELECT cluster_id, string_agg(phrase, ', ' ORDER BY rank) AS phrases FROM ph GROUP BY 1)
    SELECT cluster_id, top.size, {r('cond', 'conductance')}, coalesce(phrases, '') AS phrases, contact AS top_contact, {r('n / tc.size', 'top_contact_share')},
           left(replace(conv_text, chr(10), ' · '), 180) AS example
    FROM top LEFT JOIN w USING (cluster_id) JOIN tc USING (cluster_id) JOIN near USING (cluster_id) JOIN conv USING (session_id)
    WHERE tc.rank = 1 AND near.rank = 1""")
def _(a: Archive):
    rows = g.describe(s_docs(a), s_vectors(a), s_texts(a), session_phrases(a), s_edges(a), first_labels(a))
    return shape(rows, cluster_id="n", size="n", conductance="d", phrases="s", top_contact="s", top_contact_share="d", example="s")


@register("g35_neighbour_examples")
def _(a: Archive):
    out = []
    flat = s_texts(a).select("id", F.left(F.replace(F.col("conv_text"), F.lit("\n"), F.lit(" · ")), F.lit(130)).alias("snippet"))
    for name, rows in representation_edges(a).items():
        few = g.edge_sample(rows, 4, 2).select("a", "b", F.lit(name).alias("note"))
        out.append(few.join(flat.select(F.col("id").alias("a"), F.col("snippet").alias("left")), "a").join(
            flat.select(F.col("id").alias("b"), F.col("snippet").alias("right")), "b"))
    return stacked(out).select("note", "a", "b", "left", "right")


# ------------------------------------------------------------ artifact tables

SWEEP_ROW = "k bigint, mutual boolean, giant_frac double, n_components bigint, median_degree double, isolated_frac double, top1pct_degree_share double, jaccard double"
EXPERIMENTS = (  # experiment, title, what it compares, the query whose rows are its result
    ("representation", "What a conversation vector should be", "Weighted mean of message vectors or the transcript's own, plain and debiased", "g28_representations"),
    ("neighborhood", "Building the neighbour graph", "Number of neighbours, plain or mutual", "g26_sweep_table"),
    ("weighting", "Weighting the edges", "Binary, cosine or adaptive weights", "g27_edge_weightings"),
    ("laplacian", "Spectrum and diffusion", "Separation of the spectral clusters at several diffusion times", "g15_diffusion_silhouette"),
    ("clustering", "Ways to cluster", "Communities, density clusters, k-means and spectral clusters", "g29_method_comparison"),
)


def experiment_results(a: Archive):
    """Newest run of each experiment, read from the store; the first experiment ran twice."""
    if "_experiments" not in a.__dict__:
        folder = f"{shared_dir(a.spark)}/experiments-{uuid.uuid4().hex}"
        for experiment, title, summary, query in (EXPERIMENTS[1], *EXPERIMENTS):
            append_result(a.spark, folder, experiment, title, summary, QUERIES[query](a.spark, a.folder))
        a.__dict__["_experiments"] = results(a.spark, folder)
    return a.__dict__["_experiments"]


def semantic_tables(a: Archive):
    """The five tables of a semantic run, read back from their published set."""
    if "_semantic" not in a.__dict__:
        folder = f"{shared_dir(a.spark)}/semantic-{uuid.uuid4().hex}"
        publish({"session_embeddings": transcript_vectors(a), "session_map": map_rows(a), "semantic_communities": community_rows(a),
                 "session_layout_variants": layout_variants(a), "semantic_experiments": experiment_results(a)}, folder)
        a.__dict__["_semantic"] = current(a.spark, folder)
    return a.__dict__["_semantic"]


@register("s8_semantic_artifacts")
def _(a: Archive):
    return stacked([table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, table in semantic_tables(a).items()])


@register("s10_experiment_results", """
    SELECT * FROM (VALUES (1, 'representation', 4), (2, 'neighborhood', 10), (3, 'weighting', 3), (4, 'laplacian', 3), (5, 'clustering', 7)) AS t(place, experiment, rows)""")
def _(a: Archive):
    """Experiments in order of their newest run, with the number of result rows. (The repeated first run counts once.)"""
    rows = experiment_results(a).groupBy(F.col("number").alias("place"), "experiment").agg(F.count(F.lit(1)).alias("rows"))
    return rows.select(F.col("place").cast("int").alias("place"), "experiment", F.col("rows").cast("int").alias("rows")).orderBy("place")


@register("s10_sweep_from_the_store")
def _(a: Archive):
    """The stored payload of the sweep, typed again."""
    body = F.from_json("body", SWEEP_ROW).alias("b")
    return experiment_results(a).where("experiment = 'neighborhood'").select(body).select("b.*")


ORACLES["s10_sweep_from_the_store"] = ORACLES["g26_sweep_table"]
