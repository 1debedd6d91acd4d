"""Text and vector queries M1-M22, U2, J11, W11, and artifact reads S7-S9."""
from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from palaver.functions import vectors as v
from palaver.operators import matrix
from palaver.plans import language as l, phrases as ph
from palaver.session import shared_dir
from palaver.sources.published import current, publish

from .base import ORACLES, Archive, r6, register, shape
from .oracle import FOLDED, with_prelude
from .persons import r


def text_ids(a: Archive):
    return a.keep("text_ids", lambda: l.text_ids(a.star))


def texts(a: Archive):
    return a.keep("texts", lambda: l.distinct_texts(a.star, text_ids(a)))


def said(a: Archive):
    return a.keep("said", lambda: l.message_texts(a.star, text_ids(a)))


def vectors(a: Archive):
    """Each text borrows the vector whose number is its id modulo the number of vectors."""

    def build():
        given = a.given("embeddings")
        number = F.pmod(F.col("text_id"), given.agg(F.count(F.lit(1))).scalar())
        ids = text_ids(a).select("text_id", "total", "mine").withColumn("vec_id", number)
        return ids.join(given, "vec_id").select("text_id", "total", "mine", "embedding", F.col("label").cast("bigint").alias("cluster_id"))

    return a.keep("text_vectors", build)


def counts(a: Archive):
    return a.keep("phrase_counts", lambda: ph.scoped_counts(a.star))


def centroids(a: Archive):
    return a.keep("centroids", lambda: l.scope_centroids(l.scope_rows(said(a), "week"), vectors(a)))


def people(a: Archive):
    return a.keep("people_vectors", lambda: l.person_vectors(said(a), vectors(a)))


def language_counts(a: Archive):
    return ph.phrase_counts(a.given("documents"), ["lang"])


LANG_GRAMS = f"""
    w AS (SELECT lang, regexp_extract_all({FOLDED}, '[a-z'']+') AS w FROM documents),
    grams AS (SELECT lang, phrase, count(*) AS n FROM (
        SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM w
        UNION ALL
        SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w)
        GROUP BY 1, 2)"""


def z_score(y: str, x: str, nt: str, nb: str) -> str:
    a = f"(10.0::DOUBLE * ({y} + {x}) / ({nt} + {nb}))"
    return f"""((ln(({y} + {a}) / ({nt} + 10 - {y} - {a})) - ln(({x} + {a}) / ({nb} + 10 - {x} - {a})))
                / sqrt(1.0::DOUBLE / ({y} + {a}) + 1.0::DOUBLE / ({x} + {a})))"""


@register("m1_distinct_texts", "SELECT text, total, mine FROM texts")
def _(a: Archive):
    return texts(a).select("text", "total", "mine")


@register("m2_ngram_counts", f"WITH {LANG_GRAMS} SELECT lang, phrase, n FROM grams")
def _(a: Archive):
    return language_counts(a).withColumnRenamed("count", "n")


@register("m3_language_log_odds", f"""
    WITH {LANG_GRAMS},
    al AS (SELECT phrase, sum(n) AS k FROM grams GROUP BY 1), tot AS (SELECT lang, sum(n) AS nt FROM grams GROUP BY 1),
    z AS (SELECT lang AS scope, phrase, n AS count, {z_score('n::DOUBLE', '(k - n)::DOUBLE', 'nt::DOUBLE', '((SELECT sum(n) FROM grams) - nt)::DOUBLE')} AS score
          FROM grams JOIN al USING (phrase) JOIN tot USING (lang) WHERE n >= 5)
    SELECT scope, phrase, count, {r('score', 'score')}, row_number() OVER (PARTITION BY scope ORDER BY score DESC, phrase) AS rank
    FROM z QUALIFY rank <= 25""")
def _(a: Archive):
    rows = ph.log_odds_within(a.keep("language_counts", lambda: language_counts(a)), "lang", 5, 25)
    return shape(rows, scope="s", phrase="s", count="n", score="d", rank="n")


SIGNATURE = f"""
    WITH w AS (SELECT s.is_from_me, s.year, CASE WHEN NOT grp AND named_id IS NOT NULL THEN named_id ELSE 0 END AS pair,
                      regexp_extract_all({FOLDED}, '[a-z'']+') AS w FROM said s),
    g AS (SELECT is_from_me, year, pair, phrase, count(*) AS n FROM (
            SELECT is_from_me, year, pair, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM w
            UNION ALL
            SELECT is_from_me, year, pair, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w)
          GROUP BY ALL),
    everything AS (SELECT phrase, sum(n) AS k, sum(n) FILTER (is_from_me) AS km FROM g GROUP BY 1),
    best AS (SELECT named_id FROM said WHERE NOT grp AND named_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20),
    t AS (SELECT 'you' AS scope, 8 AS low, 25 AS top, phrase, sum(n) AS y FROM g WHERE is_from_me GROUP BY phrase
          UNION ALL SELECT 'year:' || year, 5, 15, phrase, sum(n) FROM g WHERE is_from_me GROUP BY year, phrase
          UNION ALL SELECT 'person:' || pair, 4, 15, phrase, sum(n) FROM g WHERE pair IN (SELECT named_id FROM best) GROUP BY pair, phrase),
    nt AS (SELECT scope, sum(y)::DOUBLE AS nt FROM t GROUP BY 1),
    x AS (SELECT t.*, nt, (CASE WHEN scope LIKE 'year:%' THEN km ELSE k END - y)::DOUBLE AS rest,
                 (CASE WHEN scope LIKE 'year:%' THEN (SELECT sum(km) FROM everything) ELSE (SELECT sum(k) FROM everything) END)::DOUBLE - nt AS nb
          FROM t JOIN nt USING (scope) JOIN everything USING (phrase) WHERE y >= low),
    z AS (SELECT *, {z_score('y::DOUBLE', 'rest', 'nt', 'nb')} AS score FROM x)
    SELECT scope, CASE WHEN scope = 'you' THEN 'You' WHEN scope LIKE 'year:%' THEN scope[6:]
                  ELSE (SELECT display_name FROM persons p WHERE scope = 'person:' || p.person_id) END AS label,
           phrase, y::BIGINT AS count, {r('score', 'score')}, row_number() OVER (PARTITION BY scope ORDER BY score DESC, phrase) AS rank
    FROM z QUALIFY rank <= top"""


def signature(a: Archive):
    return a.keep("signature_phrases", lambda: ph.signature_phrases(counts(a), a.star))


@register("m4_signature_phrases", SIGNATURE)
def _(a: Archive):
    return shape(signature(a), scope="s", label="s", phrase="s", count="n", score="d", rank="n")


@register("u2_union_of_scopes", SIGNATURE[:SIGNATURE.index("SELECT scope, CASE")] + """
    SELECT DISTINCT scope, CASE WHEN scope = 'you' THEN 'You' WHEN scope LIKE 'year:%' THEN scope[6:]
                    ELSE (SELECT display_name FROM persons p WHERE scope = 'person:' || p.person_id) END AS label FROM z""")
def _(a: Archive):
    return signature(a).select("scope", "label").distinct().orderBy("scope")


@register("m5_enrichment_with_cache")
def _(a: Archive):
    documents = a.given("documents").select("doc_id", "text", "lang")
    cache = l.hashed_vectors(documents.where("lang = 'en'").dropDuplicates(["text"])).select("text", "embedding")
    rows = l.enrich(documents, cache)
    return rows.select("doc_id", "lang", r6(v.norm(F.col("embedding"))).alias("length"), F.size("embedding").alias("dims"))


@register("m5_hashed_vectors_word_share", f"""
    SELECT doc_id, len(regexp_extract_all({FOLDED}, '[a-z'']+')) > 0 AS has_vector FROM documents""")
def _(a: Archive):
    rows = l.hashed_vectors(a.given("documents"))
    return rows.select("doc_id", (v.norm(F.col("embedding")) > 0.99).alias("has_vector"))


@register("m6_debiased_vectors")
def _(a: Archive):
    rows = matrix.debias(a.given("embeddings"), "embedding", 3)
    return rows.select("vec_id", r6(v.norm(F.col("debiased"))).alias("length"), r6(F.col("debiased")[0]).alias("first"))


@register("m7_kmeans_clusters")
def _(a: Archive):
    labelled, _centres = matrix.kmeans(a.given("embeddings"), "embedding", 10, seed=0)
    return labelled.groupBy("cluster_id", "label").agg(F.count(F.lit(1)).alias("n"))


@register("m9_silhouette_by_k")
def _(a: Archive):
    _rows, _centres, k, scores = matrix.pick_kmeans(a.given("embeddings"), "embedding", range(6, 13))
    return a.spark.createDataFrame([(kk, round(s, 6), kk == k) for kk, s in scores], "k int, silhouette double, best boolean")


@register("m10_topic_table", f"""
    WITH c AS (SELECT label AS cluster_id, count(*) AS msg_count FROM said JOIN vecs USING (text_id) GROUP BY 1)
    SELECT cluster_id, msg_count, {r('msg_count / (SELECT sum(msg_count) FROM c)', 'share')} FROM c""")
def _(a: Archive):
    return shape(l.topic_table(said(a), vectors(a)), cluster_id="n", msg_count="n", share="d")


@register("m10_topic_table_contentful", rf"""
    WITH lab AS (SELECT text_id, CASE WHEN length(text) >= 18 AND len(list_filter(regexp_split_to_array(text, '[\t-\r\x1c-\x20\x85\p{{Z}}]+'), lambda w: w <> '')) >= 4
                                 THEN label ELSE -1 END AS cluster_id FROM texts JOIN vecs USING (text_id)),
    c AS (SELECT cluster_id, count(*) AS msg_count FROM said JOIN lab USING (text_id) WHERE cluster_id >= 0 GROUP BY 1)
    SELECT cluster_id, msg_count, {r('msg_count / (SELECT sum(msg_count) FROM c)', 'share')} FROM c""")
def _(a: Archive):
    content = texts(a).select("text_id", l.is_contentful(F.col("text")).alias("keep"))
    labels = vectors(a).join(content, "text_id").withColumn("cluster_id", F.when(F.col("keep"), F.col("cluster_id")).otherwise(-1))
    return shape(l.topic_table(said(a), labels), cluster_id="n", msg_count="n", share="d")


@register("m11_topic_people", f"""
    WITH c AS (SELECT label AS cluster_id, named_id, count(*) AS n FROM said JOIN vecs USING (text_id) GROUP BY 1, 2),
    t AS (SELECT cluster_id, sum(n) AS al FROM c GROUP BY 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, named_id) AS rank FROM c WHERE named_id IS NOT NULL QUALIFY rank <= 3)
    SELECT cluster_id, named_id AS person_id, {r('n / al', 'share')}, rank FROM k JOIN t USING (cluster_id) WHERE n / al >= 0.03""")
def _(a: Archive):
    return shape(l.topic_people(said(a), vectors(a)), cluster_id="n", person_id="n", share="d", rank="n")


@register("m12_representative_texts", """
    SELECT label AS cluster_id, text_id, total, row_number() OVER (PARTITION BY label ORDER BY total DESC, text_id) AS rank
    FROM texts JOIN vecs USING (text_id) QUALIFY rank <= 30""")
def _(a: Archive):
    labels = vectors(a).select("text_id", "cluster_id")
    return shape(l.representative_texts(texts(a), labels), cluster_id="n", text_id="n", total="n", rank="n")


@register("m13_scope_centroids", f"""
    SELECT scope, weight::BIGINT AS weight, unnest(range(1, len(centroid) + 1)) AS i, round(unnest(centroid), 6) + 0.0 AS x FROM centroids""")
def _(a: Archive):
    rows = centroids(a).select("scope", "weight", F.posexplode("centroid").alias("p", "x")).withColumn("i", F.col("p") + 1)
    return shape(rows, scope="s", weight="n", i="n", x="d")


@register("m14_voice", f"""
    WITH top AS (SELECT person_id FROM messages WHERE person_id IS NOT NULL AND NOT grp GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 30),
    me AS (SELECT centroid FROM centroids WHERE scope = 'me')
    SELECT n.person_id, n.display_name AS name, m.weight::BIGINT AS msgs,
           {r('1 - list_cosine_similarity(m.centroid, (SELECT centroid FROM me))', 'divergence')},
           {r('list_cosine_similarity(m.centroid, t.centroid)', 'mirroring')}
    FROM named n JOIN top USING (person_id) JOIN centroids m ON m.scope = 'me_with:' || n.person_id
    JOIN centroids t ON t.scope = 'them:' || n.person_id""")
def _(a: Archive):
    return shape(l.voice(centroids(a), a.star), person_id="n", name="s", msgs="n", divergence="d", mirroring="d")


DRIFT = f"""
    SELECT scope[8:] AS period, {r('1 - list_cosine_similarity(centroid, lag(centroid) OVER (ORDER BY scope))', 'drift')},
           {r("1 - list_cosine_similarity(centroid, (SELECT centroid FROM centroids WHERE scope = 'me'))", 'novelty')}
    FROM centroids WHERE scope LIKE 'period:%' AND weight >= 50"""


@register("m15_weekly_drift", DRIFT)
def _(a: Archive):
    return shape(l.drift(centroids(a)), period="s", drift="d", novelty="d")


@register("w11_previous_qualifying_period", """
    SELECT event_type, day, n, coalesce(lag(day) OVER (PARTITION BY event_type ORDER BY day), '') AS previous
    FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2) WHERE n >= 65""")
def _(a: Archive):
    daily = a.given("events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    busy = daily.where("n >= 65")
    return busy.withColumn("previous", F.coalesce(F.lag("day").over(Window.partitionBy("event_type").orderBy("day")), F.lit("")))


@register("m16_person_vectors", f"""
    SELECT person_id, period, msgs, unnest(range(1, len(centroid) + 1)) AS i, round(unnest(centroid), 6) + 0.0 AS x FROM people_vectors""")
def _(a: Archive):
    rows = people(a).select("person_id", "period", "msgs", F.posexplode("centroid").alias("p", "x")).withColumn("i", F.col("p") + 1)
    return shape(rows, person_id="n", period="s", msgs="n", i="n", x="d")


@register("m17_people_clusters", "SELECT DISTINCT person_id, true AS known FROM people_vectors WHERE period = 'all'")
def _(a: Archive):
    """Every person of the whole archive is in one of 4 to 9 clusters."""
    rows = published(a)["person_clusters"]
    k = rows.agg(F.count_distinct("cluster_id")).scalar()
    return rows.select(F.col("person_id").cast("bigint").alias("person_id"), (F.col("cluster_id").isNotNull() & k.between(1, 9)).alias("known"))


@register("m18_person_periods", "SELECT person_id, period, msgs, true AS nearest FROM people_vectors")
def _(a: Archive):
    """Each person and period lies in the cluster whose centre is nearest to its centred vector."""
    whole = people(a).where("period = 'all'")
    _rows, centres, k, _scores = l.people_clusters(whole)
    moved = matrix.nearest_label(matrix.centred(people(a), "centroid", around=whole), "centred", list(range(k)), centres)
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    scores = F.transform(table, lambda c: v.dot(F.col("centred"), c))
    best = F.abs(F.array_max(scores) - F.element_at(scores, F.col("nearest").cast("int") + 1)) < 1e-9
    return moved.select(F.col("person_id").cast("bigint").alias("person_id"), "period", F.col("msgs").cast("bigint").alias("msgs"), best.alias("nearest"))


@register("m18_nearest_centroid", """
    WITH c AS (SELECT label, list(x ORDER BY i) AS centre FROM (
        SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
        GROUP BY 1, 2) GROUP BY 1)
    SELECT vec_id, arg_max(c.label, list_cosine_similarity(e.embedding::DOUBLE[], centre))::BIGINT AS nearest FROM embeddings e, c GROUP BY 1""")
def _(a: Archive):
    points = a.given("embeddings")
    centres = v.weighted_centroids(points.withColumn("one", F.lit(1)), ["label"], "embedding", "one")
    labels, table = matrix.small_matrix(centres, "label", "centroid")
    return shape(matrix.nearest_label(points, "embedding", labels, table), vec_id="n", nearest="n")


@register("m19_person_map")
def _(a: Archive):
    rows = l.people_map(people(a))
    return rows.select("person_id", "period", "msgs", *[r6(c).alias(c) for c in "xyz"])


@register("m20_semantic_search", f"""
    SELECT text_id, total, mine, {r('list_cosine_similarity(embedding, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 11))', 'similarity')}
    FROM texts JOIN vecs USING (text_id) ORDER BY list_cosine_similarity(embedding, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 11)) DESC, text_id LIMIT 12""")
def _(a: Archive):
    query = a.given("embeddings").where("vec_id = 11").select("embedding")
    return shape(l.search(vectors(a), query), text_id="n", total="n", mine="n", similarity="d")


@register("m21_similar_replies", f"""
    WITH me AS (SELECT text_id AS id, text AS reply, embedding AS target FROM texts JOIN vecs USING (text_id) WHERE mine > 0 ORDER BY total DESC, text_id LIMIT 1),
    best AS (SELECT text_id, text, list_cosine_similarity(embedding, (SELECT target FROM me)) AS sim FROM texts JOIN vecs USING (text_id)
             WHERE mine > 0 AND lower(text) <> (SELECT lower(reply) FROM me)
               AND length(text) BETWEEN floor((SELECT length(reply) FROM me) * 0.5::DOUBLE) AND floor((SELECT length(reply) FROM me) * 2.0::DOUBLE) + 1
             ORDER BY sim DESC, text_id LIMIT 40)
    SELECT text_id, {r('sim', 'similarity')} FROM best WHERE sim < 0.95
    QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY sim DESC, text_id) = 1 ORDER BY sim DESC, text_id LIMIT 25""")
def _(a: Archive):
    reply = texts(a).where("mine > 0").orderBy(F.desc("total"), "text_id").select("text_id").first()["text_id"]
    return shape(l.similar_replies(texts(a), vectors(a), reply), text_id="n", similarity="d")


@register("m22_cluster_evidence", """
    WITH c AS (SELECT named_id, text_id, count(*) AS n FROM said WHERE NOT is_from_me AND named_id IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT named_id, named_id % 3 AS cluster_id, row_number() OVER (PARTITION BY named_id % 3 ORDER BY sum(n) DESC, named_id) AS place
          FROM c GROUP BY 1 QUALIFY place <= 8),
    f AS (SELECT *, row_number() OVER (PARTITION BY named_id ORDER BY n DESC, text_id) AS i FROM c QUALIFY i <= 80)
    SELECT cluster_id, place, named_id, text_id, row_number() OVER (PARTITION BY named_id ORDER BY i) AS rank
    FROM f JOIN texts USING (text_id) JOIN p USING (named_id) WHERE length(text) >= 6 QUALIFY rank <= 6""")
def _(a: Archive):
    clusters = a.persons.select(F.col("person_id").alias("named_id"), F.pmod("person_id", F.lit(3)).alias("cluster_id"))
    rows = l.cluster_evidence(said(a), texts(a), clusters)
    return shape(rows, cluster_id="n", place="n", named_id="n", text_id="n", rank="n")


@register("j11_text_to_vector", f"SELECT msg_id, text_id, label AS cluster_id, {r('embedding[1]', 'first')} FROM said JOIN vecs USING (text_id)")
def _(a: Archive):
    rows = said(a).join(vectors(a), "text_id").withColumn("first", F.col("embedding")[0])
    return shape(rows, msg_id="n", text_id="n", cluster_id="n", first="d")


def published(a: Archive):
    """The eight tables of a language run, read back from their published set; the two people tables come from a second, people-only run."""
    if "_language" not in a.__dict__:
        folder = f"{shared_dir(a.spark)}/language-{uuid.uuid4().hex}"
        publish(l.artifact_tables(said(a), texts(a), vectors(a), centroids(a), signature(a), people(a), a.star), folder)
        publish(l.people_tables(people(a), a.persons), folder)
        a.__dict__["_language"] = current(a.spark, folder)
    return a.__dict__["_language"]


def counted(sources: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS name, count(*)::BIGINT AS n FROM ({sql})" for name, sql in sources.items())


@register("s7_language_artifacts")
def _(a: Archive):
    out = None
    for name, table in published(a).items():
        row = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


ORACLES["s7_language_artifacts"] = counted({
    "text_embeddings": with_prelude("SELECT text FROM texts JOIN vecs USING (text_id)"), "clusters": ORACLES["m10_topic_table"],
    "cluster_people": ORACLES["m11_topic_people"], "voice_person": ORACLES["m14_voice"], "voice_drift": ORACLES["m15_weekly_drift"],
    "signature_phrases": ORACLES["m4_signature_phrases"], "person_clusters": ORACLES["m17_people_clusters"], "person_map": ORACLES["m18_person_periods"]})


@register("s9_topics_with_people", """
    WITH c AS (SELECT label AS cluster_id, named_id, count(*) AS n FROM said JOIN vecs USING (text_id) GROUP BY 1, 2),
    t AS (SELECT cluster_id, sum(n)::BIGINT AS msg_count FROM c GROUP BY 1),
    k AS (SELECT c.*, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, named_id) AS i FROM c WHERE named_id IS NOT NULL QUALIFY i <= 3)
    SELECT t.cluster_id, t.msg_count, coalesce(string_agg(display_name, ', ' ORDER BY n DESC, display_name) FILTER (n / msg_count >= 0.03), '') AS people
    FROM t LEFT JOIN k USING (cluster_id) LEFT JOIN named ON person_id = named_id GROUP BY 1, 2""")
def _(a: Archive):
    tables = published(a)
    nested = tables["cluster_people"].groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "name"))).alias("people"))
    topics = tables["clusters"].join(nested, "cluster_id", "left")
    people_text = F.coalesce(F.array_join(F.transform("people", lambda x: x["name"]), ", "), F.lit(""))
    return shape(topics.withColumn("people", people_text).orderBy(F.desc("msg_count")), cluster_id="n", msg_count="n", people="s")


@register("s9_voice")
def _(a: Archive):
    return shape(published(a)["voice_person"].orderBy(F.desc("msgs")), person_id="n", name="s", msgs="n", divergence="d", mirroring="d")


@register("s9_drift")
def _(a: Archive):
    return shape(published(a)["voice_drift"].withColumnRenamed("month", "period").orderBy("period"), period="s", drift="d", novelty="d")


@register("s9_scopes")
def _(a: Archive):
    return published(a)["signature_phrases"].select("scope", "label").distinct().orderBy("scope")


@register("s9_signature_of_a_scope")
def _(a: Archive):
    rows = published(a)["signature_phrases"].where("scope = 'you'").orderBy(F.desc("score"), "phrase")
    return shape(rows, phrase="s", count="n", score="d")


ORACLES |= {"s9_voice": ORACLES["m14_voice"], "s9_drift": ORACLES["m15_weekly_drift"], "s9_scopes": ORACLES["u2_union_of_scopes"],
            "s9_signature_of_a_scope": f"SELECT phrase, count, score FROM ({ORACLES['m4_signature_phrases']}) WHERE scope = 'you'"}


@register("s9_people_clusters", "SELECT DISTINCT person_id, display_name AS name FROM people_vectors JOIN persons USING (person_id) WHERE period = 'all'")
def _(a: Archive):
    """Members by cluster, read as nested lists and spread again."""
    nested = published(a)["person_clusters"].groupBy("cluster_id", "label").agg(F.array_sort(F.collect_list(F.struct("name", "person_id"))).alias("members"))
    rows = nested.select("cluster_id", "label", F.explode("members").alias("m")).orderBy("cluster_id", "m.name")
    return rows.select(F.col("m.person_id").cast("bigint").alias("person_id"), "m.name")


@register("s9_people_map", """
    SELECT person_id, display_name AS name, period, msgs, count(*) OVER () AS points, true AS placed FROM people_vectors JOIN persons USING (person_id)""")
def _(a: Archive):
    """Points in order; coordinates have mean 0 and unit variance over all points."""
    rows = published(a)["person_map"]
    centred = F.greatest(*[F.abs(F.avg(c)) for c in "xyz"]) < 1e-6
    scaled = F.greatest(*[F.abs(F.stddev_pop(c) - 1) for c in "xyz"]) < 1e-6
    placed = F.col("cluster_id").isNotNull() & rows.agg(centred & scaled).scalar()
    out = rows.withColumns({"points": rows.agg(F.count(F.lit(1))).scalar(), "placed": placed})
    return shape(out.orderBy("period", "name"), person_id="n", name="s", period="s", msgs="n", points="n", placed="b")
