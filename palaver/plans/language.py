"""Text vectors: enrichment, topics, voice, drift and the map of people."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx, timefn as tf, vectors as v
from ..operators import banded, matrix
from ..operators.topk import top_per_group
from ..session import materialize
from ..sources.raw import Tables, spoken_messages, with_text

CONTENT_MIN_CHARS, CONTENT_MIN_WORDS = 18, 4


def text_ids(star: Tables) -> DataFrame:
    """Distinct trimmed texts by their md5 (``said``), with total and own counts; the id is the first message that says it."""
    return spoken_messages(star).groupBy("said").agg(
        F.min("msg_id").alias("text_id"), F.count(F.lit(1)).alias("total"), F.count_if("is_from_me").alias("mine"))


def distinct_texts(star: Tables, ids: DataFrame) -> DataFrame:
    """The texts of ``ids``, each read from the first message that says it."""
    first = star["messages"].join(ids.select(F.col("text_id").alias("msg_id"), "total", "mine"), "msg_id")
    return with_text(star, first).select(F.trim("text").alias("text"), F.col("msg_id").alias("text_id"), "total", "mine")


def message_texts(star: Tables, ids: DataFrame) -> DataFrame:
    """Every spoken message with the id of its text and what the vector plans group by."""
    named = star["persons"].where(~F.col("display_name").like("urn:%")).select("person_id", "display_name")
    return (
        spoken_messages(star).join(ids.select("said", "text_id"), "said")
        .join(star["chats"].select("chat_id", "is_group"), "chat_id").join(named, "person_id", "left")
        .select("msg_id", "text_id", "chat_id", "session_id", "ts_utc", "is_from_me", "is_group",
                F.when(F.col("display_name").isNotNull(), F.col("person_id")).alias("named_id"),
                tf.month_label(F.col("ts_local")).alias("month"), tf.bucket("week", F.col("ts_local")).alias("week"),
                tf.year_label(F.col("ts_local")).alias("year"))
    )


def hashed_vectors(texts: DataFrame, dims: int = 256, text: str = "text") -> DataFrame:
    """Deterministic text vectors: word counts hashed into ``dims`` places, unit length."""
    words = texts.withColumn("_w", tx.found_words(F.col(text)))
    counted = HashingTF(numFeatures=dims, inputCol="_w", outputCol="_tf").transform(words)
    return Normalizer(p=2.0, inputCol="_tf", outputCol="_n").transform(counted).withColumn(
        "embedding", vector_to_array("_n", "float32")).drop("_w", "_tf", "_n")


def enrich(texts: DataFrame, cache: DataFrame, vectorise: Callable[[DataFrame], DataFrame] = hashed_vectors,
           key: str = "text") -> DataFrame:
    """Vectors of all texts; only those absent from ``cache`` (key, embedding) are computed."""
    known = texts.join(cache.select(key, "embedding"), key)
    fresh = vectorise(texts.join(cache.select(key), key, "left_anti"))
    return known.unionByName(fresh)


def is_contentful(text: Column) -> Column:
    return (F.char_length(text) >= CONTENT_MIN_CHARS) & (tx.word_count(text) >= CONTENT_MIN_WORDS)


def topic_table(said: DataFrame, clusters: DataFrame) -> DataFrame:
    """Messages and share per cluster; texts without content (cluster -1) do not count."""
    counts = said.groupBy("text_id").agg(F.count(F.lit(1)).alias("n")).join(
        clusters.where("cluster_id >= 0"), "text_id").groupBy("cluster_id").agg(F.sum("n").alias("msg_count"))
    return counts.withColumn("share", F.col("msg_count") / counts.agg(F.sum("msg_count")).scalar())


def topic_people(said: DataFrame, clusters: DataFrame, k: int = 3, min_share: float = 0.03) -> DataFrame:
    """People with the largest part of a whole cluster."""
    counts = said.groupBy("text_id", "named_id").agg(F.count(F.lit(1)).alias("n")).join(
        clusters.where("cluster_id >= 0"), "text_id").groupBy("cluster_id", "named_id").agg(F.sum("n").alias("n"))
    whole = counts.groupBy("cluster_id").agg(F.sum("n").alias("all"))
    named = top_per_group(counts.where(F.col("named_id").isNotNull()), ["cluster_id"], [F.desc("n"), F.asc("named_id")], k)
    return named.join(whole, "cluster_id").withColumn("share", F.col("n") / F.col("all")).where(
        F.col("share") >= min_share).select("cluster_id", F.col("named_id").alias("person_id"), "share", "rank")


def representative_texts(texts: DataFrame, clusters: DataFrame, k: int = 30) -> DataFrame:
    rows = texts.join(clusters.where("cluster_id >= 0"), "text_id").select("cluster_id", "text_id", "total")
    return top_per_group(rows, ["cluster_id"], [F.desc("total"), F.asc("text_id")], k)


def scope_rows(said: DataFrame, period: str = "month") -> DataFrame:
    """(scope, text_id, n): mine, mine per period, mine with a person, the person's own to me."""
    direct = ~F.col("is_group") & F.col("named_id").isNotNull()
    me = F.col("is_from_me")
    person = F.col("named_id").cast("string")
    scopes = F.array_compact(F.array(
        F.when(me, F.lit("me")),
        F.when(me, F.concat(F.lit("period:"), F.col(period))),
        F.when(me & direct, F.concat(F.lit("me_with:"), person)),
        F.when(~me & direct, F.concat(F.lit("them:"), person))))
    return said.withColumn("scope", F.explode(scopes)).groupBy("scope", "text_id").agg(F.count(F.lit(1)).alias("n"))


def scope_centroids(scoped: DataFrame, vectors: DataFrame) -> DataFrame:
    """Unit centroid of each scope, weighted by how often each text was said."""
    return v.weighted_centroids(scoped.join(vectors.select("text_id", "embedding"), "text_id"), ["scope"], "embedding", "n")


def voice(centroids: DataFrame, star: Tables, top: int = 30) -> DataFrame:
    """How my voice with a person departs from my usual one, and how close it is to theirs."""
    busiest = (
        star["messages"].where(F.col("person_id").isNotNull()).groupBy("chat_id", "person_id").agg(F.count(F.lit(1)).alias("n"))
        .join(star["chats"].where(~F.col("is_group")).select("chat_id"), "chat_id", "left_semi")
        .groupBy("person_id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "person_id").limit(top)
    )
    people = star["persons"].where(~F.col("display_name").like("urn:%")).join(busiest.select("person_id"), "person_id", "left_semi")
    usual = centroids.where("scope = 'me'").select("centroid").scalar()

    def part(prefix: str, name: str) -> DataFrame:
        rows = centroids.where(F.col("scope").startswith(prefix + ":"))
        return rows.select(F.substring_index("scope", ":", -1).cast("int").alias("person_id"), F.col("centroid").alias(name), F.col("weight").alias(f"{name}_msgs"))

    joined = people.join(part("me_with", "mine"), "person_id").join(part("them", "theirs"), "person_id").withColumn("usual", usual)
    return joined.select(
        "person_id", F.col("display_name").alias("name"), F.col("mine_msgs").cast("bigint").alias("msgs"),
        (1 - v.cosine(F.col("mine"), F.col("usual"))).alias("divergence"), v.cosine(F.col("mine"), F.col("theirs")).alias("mirroring"))


def drift(centroids: DataFrame, min_messages: int = 50) -> DataFrame:
    """Change from the previous qualifying period and distance from my usual voice."""
    usual = centroids.where("scope = 'me'").select("centroid").scalar()
    periods = centroids.where(F.col("scope").startswith("period:") & (F.col("weight") >= min_messages)).select(
        F.substring_index("scope", ":", -1).alias("period"), "centroid")
    # one row per calendar period: the unpartitioned order is over a few hundred rows at most
    before = F.lag("centroid").over(Window.partitionBy(F.lit(0)).orderBy("period"))
    return periods.withColumn("before", before).withColumn("usual", usual).select(
        "period", (1 - v.cosine(F.col("centroid"), F.col("before"))).alias("drift"),
        (1 - v.cosine(F.col("centroid"), F.col("usual"))).alias("novelty")).orderBy("period")


def person_vectors(said: DataFrame, vectors: DataFrame, top: int = 40, min_year: int = 30) -> DataFrame:
    """Centroid of the people who write most, over all time and per busy year."""
    theirs = said.where(~F.col("is_from_me") & F.col("named_id").isNotNull()).groupBy("named_id", "year", "text_id").agg(
        F.count(F.lit(1)).alias("n"))
    volume = theirs.groupBy("named_id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "named_id").limit(top)
    kept = theirs.join(volume.select("named_id"), "named_id", "left_semi")
    periods = kept.withColumn("period", F.explode(F.array(F.lit("all"), F.col("year")))).join(
        vectors.select("text_id", "embedding"), "text_id")
    rows = v.weighted_centroids(periods, ["named_id", "period"], "embedding", "n")
    return rows.where((F.col("period") == "all") | (F.col("weight") >= min_year)).select(
        F.col("named_id").alias("person_id"), "period", F.col("weight").cast("bigint").alias("msgs"), "centroid")


def people_clusters(people: DataFrame, ks: range = range(4, 10)):
    """Clusters of mean-centred people with the best silhouette: (rows, centres, k, scores)."""
    return matrix.pick_kmeans(matrix.centred(people, "centroid"), "centred", ks)


def cluster_evidence(said: DataFrame, texts: DataFrame, clusters: DataFrame, max_people: int = 8,
                     among: int = 80, per_person: int = 6, min_chars: int = 6) -> DataFrame:
    """Sample texts of the people of a cluster: long enough ones among each person's most frequent."""
    counts = said.where(~F.col("is_from_me") & F.col("named_id").isNotNull()).groupBy("named_id", "text_id").agg(
        F.count(F.lit(1)).alias("n"))
    volume = counts.groupBy("named_id").agg(F.sum("n").alias("msgs")).join(clusters, "named_id")
    people = top_per_group(volume, ["cluster_id"], [F.desc("msgs"), F.asc("named_id")], max_people, "place")
    frequent = top_per_group(counts, ["named_id"], [F.desc("n"), F.asc("text_id")], among, "frequency")
    long_enough = texts.where(F.char_length("text") >= min_chars).select("text_id", "text")
    samples = top_per_group(frequent.join(long_enough, "text_id"), ["named_id"], [F.asc("frequency")], per_person)
    return samples.join(people.select("named_id", "cluster_id", "place"), "named_id").select(
        "cluster_id", "place", "named_id", "rank", "text_id", "text")


def people_map(people: DataFrame) -> DataFrame:
    """Three standardised coordinates per person and period, around the mean of the whole-archive rows."""
    around = people.where("period = 'all'")
    return matrix.standardized_coordinates(matrix.centred(people, "centroid", around=around), "centred", ["x", "y", "z"])


def people_tables(people: DataFrame, persons: DataFrame) -> Tables:
    """person_clusters (of the whole archive) and person_map: coordinates and nearest cluster of every person and period."""
    whole = people.where("period = 'all'")
    _rows, centres, k, _scores = people_clusters(whole)
    moved = matrix.nearest_label(matrix.centred(people, "centroid", around=whole), "centred", list(range(k)), centres)
    placed = materialize(matrix.standardized_coordinates(moved, "centred", ["x", "y", "z"]).withColumnRenamed("nearest", "cluster_id"), "person_map")
    names = persons.select("person_id", F.col("display_name").alias("name"))
    placed = placed.join(names, "person_id").withColumn("cluster_id", F.col("cluster_id").cast("int"))
    label = F.concat(F.lit("people "), (F.col("cluster_id") + 1).cast("string"))
    return {"person_clusters": placed.where("period = 'all'").select("cluster_id", label.alias("label"), "person_id", "name"),
            "person_map": placed.select("person_id", "name", "period", "x", "y", "z", "cluster_id", "msgs")}


def artifact_tables(said: DataFrame, texts: DataFrame, vectors: DataFrame, centroids: DataFrame, signature: DataFrame, people: DataFrame, star: Tables) -> Tables:
    """The eight tables of a language run. ``vectors``: text_id, total, mine, embedding, cluster_id."""
    first = representative_texts(texts, vectors.select("text_id", "cluster_id"), 1).join(texts.select("text_id", "text"), "text_id").select(
        "cluster_id", F.left("text", F.lit(60)).alias("label"))
    names = star["persons"].select("person_id", F.col("display_name").alias("name"))
    return {
        "text_embeddings": vectors.join(texts.select("text_id", "text"), "text_id").select("text", "total", "mine", "cluster_id", "embedding"),
        "clusters": topic_table(said, vectors).join(first, "cluster_id", "left").select("cluster_id", "label", "msg_count", "share"),
        "cluster_people": topic_people(said, vectors).join(names, "person_id").select("cluster_id", "name", "share"),
        "voice_person": voice(centroids, star),
        "voice_drift": drift(centroids).withColumnRenamed("period", "month"),
        "signature_phrases": signature.select("scope", "label", "phrase", "count", "score"),
        **people_tables(people, star["persons"]),
    }


def search(vectors: DataFrame, query: DataFrame, k: int = 12) -> DataFrame:
    """Texts closest to a one-row query vector."""
    rows = vectors.withColumn("target", query.scalar())
    return rows.withColumn("similarity", v.cosine(F.col("embedding"), F.col("target"))).drop("target", "embedding").orderBy(
        F.desc("similarity"), "text_id").limit(k)


def similar_replies(texts: DataFrame, vectors: DataFrame, reply_id: int, near: float = 0.95, pool: int = 40,
                    k: int = 25) -> DataFrame:
    """Own texts that mean something close to a reply, of similar length, without near copies."""
    own = texts.where("mine > 0").join(vectors.select("text_id", "embedding"), "text_id")
    reply = texts.where(F.col("text_id") == reply_id)
    rows = own.withColumn("target", vectors.where(F.col("text_id") == reply_id).select("embedding").scalar()).withColumn(
        "reply", reply.select("text").scalar())
    size = F.char_length("reply").cast("double")
    band = F.char_length("text").between(F.floor(size * 0.5), F.floor(size * 2.0) + 1)
    best = rows.where(band & (F.lower("text") != F.lower("reply"))).withColumn(
        "similarity", v.cosine(F.col("embedding"), F.col("target"))).orderBy(F.desc("similarity"), "text_id").limit(pool)
    unique = top_per_group(best.where(F.col("similarity") < near).withColumn("folded", F.lower("text")), ["folded"],
                           [F.desc("similarity"), F.asc("text_id")], 1)
    return unique.select("text_id", "text", "similarity").orderBy(F.desc("similarity"), "text_id").limit(k)


def similar_replies_each(texts: DataFrame, vectors: DataFrame, replies: DataFrame, pool: int = 40) -> DataFrame:
    """(reply_id, text_id, twin, similarity, rank): for every reply the own texts closest in meaning.

    ``replies``: text_id of each reply, repeats allowed. Candidates are own texts of half to twice
    the length (as ``similar_replies``) that differ from the reply by more than case; ``twin`` is
    the first id of the texts equal but for case. Replies without a vector get no rows.
    """
    own = texts.select("text_id", F.md5(F.lower("text")).alias("folded"), F.char_length("text").cast("long").alias("size"), "mine")
    first = own.groupBy("folded").agg(F.min("text_id").alias("twin"))
    named = materialize(own.join(first, "folded").drop("folded").join(vectors.select("text_id", "embedding"), "text_id"), "own_texts")
    half, twice = F.floor(F.col("size") * 0.5), F.floor(F.col("size") * 2.0) + 1
    queries = named.join(replies.select("text_id").distinct(), "text_id", "left_semi").select(
        F.col("text_id").alias("query"), "embedding", half.alias("low"), twice.alias("high"), "twin")
    items = named.where("mine > 0").select(F.col("text_id").alias("item"), "embedding", "size", "twin")
    best = banded.most_similar_in_band(queries, items, pool)
    return best.join(named.select(F.col("text_id").alias("item"), "twin"), "item").select(
        F.col("query").alias("reply_id"), F.col("item").alias("text_id"), "twin", "similarity", "rank")
