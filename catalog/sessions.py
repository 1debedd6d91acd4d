"""Session documents G0-G0c and the shared session tables of the graph queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import vectors as v
from palaver.plans import language as l, sessions as s
from palaver.sources.raw import attach_text

from .base import Archive, r6, register, shape
from .language import said, texts, vectors
from .oracle import FOLDED, STOP_LIST, TABLES
from .persons import r

TABLES.update({
    "docs": """
        SELECT session_id, chat_id, grp AS is_group, n_msgs, n_words, n_from_me, initiated_by_me, start_ts,
               CASE WHEN grp THEN coalesce(nullif(trim(name), ''), 'unnamed group') ELSE coalesce(sender, 'unknown') END AS contact
        FROM (SELECT session_id, s.chat_id, grp, count(*) AS n_msgs, sum(word_count)::BIGINT AS n_words,
                     count(*) FILTER (is_from_me) AS n_from_me, arg_min(is_from_me, k) AS initiated_by_me, min(ts_utc) AS start_ts,
                     arg_max(display_name, k) FILTER (NOT is_from_me AND display_name IS NOT NULL) AS sender
              FROM (SELECT *, row_number() OVER (ORDER BY ts_utc, msg_id) AS k FROM said) s
              LEFT JOIN named ON person_id = named_id GROUP BY 1, 2, 3)
        JOIN chats USING (chat_id) WHERE n_msgs >= 3 AND n_words >= 20""",
    "conv": """
        SELECT session_id,
               left(string_agg(CASE WHEN is_from_me THEN 'Me' ELSE 'Them' END || ': ' || text, chr(10) ORDER BY ts_utc, msg_id), 4000) AS conv_text,
               left(string_agg(CASE WHEN is_from_me THEN 'Me' ELSE coalesce(nullif(split_part(display_name, ' ', 1), ''), 'Them') END
                               || ': ' || text, chr(10) ORDER BY ts_utc, msg_id), 4000) AS disp_text,
               string_agg(text, ' ' ORDER BY ts_utc, msg_id) AS raw_text
        FROM said LEFT JOIN named ON person_id = named_id SEMI JOIN docs USING (session_id) GROUP BY 1""",
    "session_words": f"""
        SELECT DISTINCT session_id, word FROM (
            SELECT session_id, unnest(regexp_extract_all({FOLDED.replace('text', 'raw_text')}, '[a-z'']+')) AS word FROM conv)
        WHERE length(word) > 2 AND word NOT IN ({STOP_LIST})""",
    "session_grams": f"""
        SELECT session_id, phrase, count(*) AS n FROM (
            SELECT session_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM (
                SELECT session_id, regexp_extract_all({FOLDED.replace('text', 'raw_text')}, '[a-z'']+') AS w FROM conv)
            UNION ALL
            SELECT session_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM (
                SELECT session_id, regexp_extract_all({FOLDED.replace('text', 'raw_text')}, '[a-z'']+') AS w FROM conv))
        GROUP BY 1, 2""",
    "info": f"""
        SELECT text_id, q, q * greatest(k, 1) ** 0.25 AS w FROM (
            SELECT text_id, k, 1 / (1 + exp(-(-2.5::DOUBLE + 0.9::DOUBLE * ln(1 + k) + 2.0::DOUBLE * c / greatest(k, 1)))) AS q FROM (
                SELECT text_id, len(ws) AS k, len(list_filter(ws, lambda x: x NOT IN ({STOP_LIST}))) AS c FROM (
                    SELECT text_id, regexp_extract_all({FOLDED}, '[a-z'']+') AS ws FROM texts)))""",
    "session_vecs": """
        SELECT session_id, list(x / norm ORDER BY i) AS embedding
        FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY session_id)) AS norm
              FROM (SELECT session_id, i, sum(w * x) / sum(w) AS x
                    FROM (SELECT session_id, w, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i
                          FROM said SEMI JOIN docs USING (session_id) JOIN info USING (text_id) JOIN vecs USING (text_id)) GROUP BY 1, 2))
        GROUP BY 1""",
    "first_labels": """
        SELECT session_id, arg_min(label, k) AS cluster_id
        FROM (SELECT s.session_id, s.text_id, row_number() OVER (ORDER BY ts_utc, msg_id) AS k FROM said s SEMI JOIN docs USING (session_id))
        JOIN vecs USING (text_id) GROUP BY 1""",
})


def spoken(a: Archive):
    """Spoken messages with their texts, which are joined where they are read."""
    return attach_text(spoken_rows(a), a.star["shared_text"]).withColumn("text", F.trim("text"))


def spoken_rows(a: Archive):
    return a.keep("spoken", lambda: s.spoken(a.star))


def docs(a: Archive):
    return a.keep("docs", lambda: s.documents(spoken_rows(a)))


def clipped(a: Archive):
    return s.transcripts(spoken_rows(a), docs(a), a.star["text_scan"])


def transcripts(a: Archive):
    return a.keep("transcripts", lambda: clipped(a))


def session_tokens(a: Archive):
    return a.keep("session_tokens", lambda: s.tokens(spoken(a), docs(a)))


def session_phrases(a: Archive) -> s.Phrases:
    """Phrases of sessions; what is written is a narrow row a message."""
    if "_phrases" not in a.__dict__:
        found = s.running_phrases(spoken_rows(a), docs(a), a.star["shared_text"])
        a.__dict__["_phrases"] = found._replace(messages=a.keep("phrase_messages", lambda: found.messages))
    return a.__dict__["_phrases"]


def session_vectors(a: Archive):
    return a.keep("session_vectors", lambda: s.session_vectors(said(a), docs(a), s.information_weights(texts(a)), vectors(a)))


def first_labels(a: Archive):
    """A ready-made clustering of sessions: the label of the vector of the first text."""

    def build():
        first = said(a).join(docs(a).select("session_id"), "session_id", "left_semi").groupBy("session_id").agg(
            F.min_by("text_id", F.struct("ts_utc", "msg_id")).alias("text_id"))
        return first.join(vectors(a).select("text_id", "cluster_id"), "text_id").select(F.col("session_id").alias("id"), "cluster_id")

    return a.keep("first_labels", build)


@register("g0_session_documents", """
    SELECT session_id, chat_id, is_group, contact, n_msgs, n_words, n_from_me, initiated_by_me, conv_text, disp_text
    FROM docs JOIN conv USING (session_id)""")
def _(a: Archive):
    rows = docs(a).join(transcripts(a), "session_id")
    return shape(rows, session_id="s", chat_id="n", is_group="b", contact="s", n_msgs="n", n_words="n", n_from_me="n",
                 initiated_by_me="b", conv_text="s", disp_text="s")


@register("g0_session_token_sets", "SELECT session_id, count(*) AS tokens, min(word) AS first, max(word) AS last FROM session_words GROUP BY 1")
def _(a: Archive):
    return session_tokens(a).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("tokens"), F.min("token").alias("first"), F.max("token").alias("last"))


@register("g0_session_phrases_across_messages", """
    SELECT session_id, count(*) AS phrases, sum(n)::BIGINT AS uses, min(phrase) AS first, max(phrase) AS last FROM session_grams GROUP BY 1""")
def _(a: Archive):
    return s.phrase_counts(session_phrases(a)).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("phrases"), F.sum("count").alias("uses"), F.min("phrase").alias("first"), F.max("phrase").alias("last"))


@register("g0b_information_weights", f"SELECT text_id, {r('q', 'q')}, {r('w', 'w')} FROM info")
def _(a: Archive):
    return shape(s.information_weights(texts(a)), text_id="n", q="d", w="d")


@register("g0b_session_vectors", """
    SELECT session_id, unnest(range(1, len(embedding) + 1)) AS i, round(unnest(embedding), 6) + 0.0 AS x FROM session_vecs""")
def _(a: Archive):
    rows = session_vectors(a).select("session_id", F.posexplode("embedding").alias("p", "x")).withColumn("i", F.col("p") + 1)
    return shape(rows, session_id="s", i="n", x="d")


def transcript_vectors(a: Archive):
    """Vectors of whole transcripts with a cache by content hash."""

    def build():
        rows = transcripts(a).select("session_id", "conv_text", "text_hash")
        hashes = rows.dropDuplicates(["text_hash"])
        cached = l.hashed_vectors(hashes.where(F.substring("text_hash", 1, 1) < "8"), text="conv_text").select("text_hash", "embedding")
        fresh = l.enrich(hashes, cached, lambda d: l.hashed_vectors(d, text="conv_text"), key="text_hash")
        return rows.join(fresh.select("text_hash", "embedding"), "text_hash").select("session_id", "text_hash", "embedding")

    return a.keep("transcript_vectors", build)


@register("g0c_transcript_vectors")
def _(a: Archive):
    return transcript_vectors(a).select("session_id", "text_hash", r6(v.norm(F.col("embedding"))).alias("length"))


@register("x14_transcript_hash", "SELECT session_id, sha1(conv_text) AS text_hash FROM conv")
def _(a: Archive):
    return clipped(a).select("session_id", "text_hash")  # no transcript is written for a hash
