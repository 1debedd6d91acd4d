"""Quiz queries Z1-Z6 and the row windows W9, W10."""
from __future__ import annotations

from pyspark.sql import functions as F

from palaver.plans import language as l, quiz as z

from .base import Archive, register, shape
from .language import texts, vectors
from .oracle import TABLES
from .persons import bucket, r

TABLES.update({
    "direct_texts": "SELECT * FROM messages WHERE NOT grp AND text IS NOT NULL",
    "eligible": """
        SELECT person_id, display_name, count(*) AS n FROM direct_texts JOIN named USING (person_id)
        GROUP BY 1, 2 ORDER BY n DESC, person_id LIMIT 20""",
})


def windows_sql(rows: str, key: str, size: int, having: str, theirs: int) -> str:
    return f"""
    WITH base AS ({rows}), ok AS (SELECT {key}, session_id, count(*) AS n FROM base GROUP BY 1, 2 HAVING {having}),
    p AS (SELECT b.*, n, least({size}, n) AS size, row_number() OVER (PARTITION BY {key}, session_id ORDER BY ts_utc, msg_id) AS pos
          FROM base b JOIN ok USING ({key}, session_id))
    SELECT {key}, session_id, s.pos AS start, any_value(s.size) AS size, count(*) FILTER (NOT m.is_from_me) AS theirs,
           {bucket('day', 'min(s.ts_local)')} AS date, sha1(string_agg(trim(m.text), chr(10) ORDER BY m.pos)) AS texts
    FROM p s JOIN p m USING ({key}, session_id)
    WHERE s.pos <= s.n - s.size + 1 AND m.pos BETWEEN s.pos AND s.pos + s.size - 1
    GROUP BY 1, 2, 3 HAVING count(*) FILTER (NOT m.is_from_me) >= {theirs}"""


def hashed(rows, key):
    texts = F.sha1(F.encode(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), "UTF-8"))
    return shape(rows.withColumn("texts", texts), **{key: "n"}, session_id="s", start="n", size="n", theirs="n", date="s", texts="s")


def who(a: Archive):
    return a.keep("who_said_it", lambda: z.who_said_it(a.star))


def replies(a: Archive):
    return a.keep("reply_candidates", lambda: z.reply_candidates(a.star))


def which(a: Archive):
    return a.keep("which_group", lambda: z.which_group(a.star))


@register("z1_eligible_persons", "SELECT person_id, display_name, n FROM eligible")
def _(a: Archive):
    return shape(z.eligible(a.star), person_id="n", display_name="s", n="n")


@register("z2_who_said_it_windows", windows_sql(
    "SELECT * FROM direct_texts WHERE person_id IN (SELECT person_id FROM eligible)", "person_id", 5,
    "count(*) >= 3 AND count(*) FILTER (NOT is_from_me) >= 2", 2))
def _(a: Archive):
    return hashed(who(a), "person_id")


@register("z2_who_said_it_rounds")
def _(a: Archive):
    rounds = z.seeded_rounds(who(a), ["person_id"], ["session_id", "start"], seed=11)
    asked = z.with_choices(rounds, z.eligible(a.star).select("person_id"), "person_id", seed=11)
    return asked.select("person_id", "session_id", "start", "date", F.to_json("choices").alias("choices"))


@register("z3_reply_candidates", f"""
    WITH o AS (SELECT *, trim(text) AS t, row_number() OVER w AS rn, lag(is_from_me) OVER w AS pm, lag(session_id) OVER w AS ps,
                      row_number() OVER (PARTITION BY chat_id, session_id ORDER BY ts_utc, msg_id) AS srn
               FROM direct_texts WINDOW w AS (PARTITION BY chat_id ORDER BY ts_utc, msg_id)),
    c AS (SELECT * FROM o WHERE is_from_me AND length(t) >= 8 AND NOT pm AND ps = session_id AND srn >= 5 AND person_id IN (SELECT person_id FROM eligible))
    SELECT c.msg_id AS reply_id, any_value(c.person_id) AS person_id, count(*) FILTER (o.rn < c.rn) AS before, count(*) FILTER (o.rn > c.rn) AS after,
           {bucket('day', 'max(o.ts_local) FILTER (o.rn < c.rn)')} AS date,
           sha1(string_agg(o.t, chr(10) ORDER BY o.rn) FILTER (o.rn < c.rn)) AS context
    FROM c JOIN o ON o.chat_id = c.chat_id AND o.rn BETWEEN c.rn - 4 AND c.rn + 3 GROUP BY 1""")
def _(a: Archive):
    context = F.sha1(F.encode(F.array_join(F.transform("context", lambda x: x["text"]), "\n"), "UTF-8"))
    rows = replies(a).withColumns({"before": F.size("context"), "after": F.size("aftermath")}).withColumn("context", context)
    return shape(rows, reply_id="n", person_id="n", before="n", after="n", date="s", context="s")


@register("w9_neighbourhood_by_row_number", """
    WITH o AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY ts_utc, msg_id) AS rn FROM direct_texts)
    SELECT c.msg_id AS reply_id, count(*) - 1 AS around, sum(o.char_len)::BIGINT AS chars FROM o c JOIN o USING (chat_id)
    WHERE o.rn BETWEEN c.rn - 4 AND c.rn + 3 GROUP BY 1""")
def _(a: Archive):
    rows = z.with_even_slice(z.direct_texts(a.star).select("msg_id", "chat_id", "ts_utc", "char_len"), ["chat_id"], z.ORDER)
    rows = z.with_running_sum(rows, ["chat_id"], z.ORDER, F.lit(1), "rn")
    asked = rows.select("chat_id", F.col("msg_id").alias("reply_id"), F.explode(F.sequence(F.col("rn") - 4, F.col("rn") + 3)).alias("rn"))
    found = asked.join(rows.select("chat_id", "rn", "char_len"), ["chat_id", "rn"]).groupBy("reply_id").agg(
        (F.count(F.lit(1)) - 1).alias("around"), F.sum("char_len").alias("chars"))
    return shape(found, reply_id="n", around="n", chars="n")


@register("w10_contiguous_windows", windows_sql("SELECT * FROM messages WHERE text IS NOT NULL", "chat_id", 3, "count(*) >= 1", 0))
def _(a: Archive):
    rows = a.said.where(F.col("text").isNotNull()).select("chat_id", "session_id", "msg_id", "ts_utc", "ts_local", "text", "is_from_me")
    return hashed(z.contiguous_windows(rows, ["chat_id", "session_id"], 3), "chat_id")


@register("z4_length_matched_distractors")
def _(a: Archive):
    rows = z.length_matched(a.star, replies(a), seed=5)
    return rows.select("reply_id", "rank", F.char_length("text").alias("chars"), F.sha1(F.encode("text", "UTF-8")).alias("text"))


@register("z4_replies_with_distractors", """
    WITH o AS (SELECT *, trim(text) AS t, lag(is_from_me) OVER w AS pm, lag(session_id) OVER w AS ps,
                      row_number() OVER (PARTITION BY chat_id, session_id ORDER BY ts_utc, msg_id) AS srn
               FROM direct_texts WINDOW w AS (PARTITION BY chat_id ORDER BY ts_utc, msg_id)),
    c AS (SELECT * FROM o WHERE is_from_me AND length(t) >= 8 AND NOT pm AND ps = session_id AND srn >= 5 AND person_id IN (SELECT person_id FROM eligible)),
    pool AS (SELECT DISTINCT chat_id, lower(trim(text)) AS f, min(length(trim(text))) OVER (PARTITION BY chat_id, lower(trim(text))) AS len
             FROM messages WHERE is_from_me AND length(trim(text)) > 0)
    SELECT c.msg_id AS reply_id FROM c JOIN pool p ON p.chat_id <> c.chat_id AND p.f <> lower(c.t)
      AND p.len BETWEEN floor(length(c.t) * 0.6::DOUBLE) AND floor(length(c.t) * 1.4::DOUBLE) + 1
    GROUP BY 1 HAVING count(DISTINCT p.f) >= 3""")
def _(a: Archive):
    return z.length_matched(a.star, replies(a), seed=5).select("reply_id").distinct()


REPLIES = """
    o AS (SELECT *, trim(text) AS t, lag(is_from_me) OVER w AS pm, lag(session_id) OVER w AS ps,
                 row_number() OVER (PARTITION BY chat_id, session_id ORDER BY ts_utc, msg_id) AS srn
          FROM direct_texts WINDOW w AS (PARTITION BY chat_id ORDER BY ts_utc, msg_id)),
    c AS (SELECT * FROM o WHERE is_from_me AND length(t) >= 8 AND NOT pm AND ps = session_id AND srn >= 5 AND person_id IN (SELECT person_id FROM eligible))"""
CLOSE = f"""
    WITH {REPLIES},
    asked AS (SELECT DISTINCT x.text_id AS asked, x.text, v.embedding FROM c JOIN texts x ON x.text = c.t JOIN vecs v USING (text_id)),
    own AS (SELECT text_id, text, embedding FROM texts JOIN vecs USING (text_id) WHERE mine > 0),
    best AS (SELECT asked, w.text_id, lower(w.text) AS folded, round(list_cosine_similarity(w.embedding, a.embedding), 9) AS sim
             FROM asked a JOIN own w ON length(w.text) BETWEEN floor(length(a.text) * 0.5::DOUBLE) AND floor(length(a.text) * 2.0::DOUBLE) + 1
               AND lower(w.text) <> lower(a.text)
             QUALIFY row_number() OVER (PARTITION BY asked ORDER BY sim DESC, w.text_id) <= 40),
    single AS (SELECT * FROM best WHERE sim < 0.95 QUALIFY row_number() OVER (PARTITION BY asked, folded ORDER BY sim DESC, text_id) = 1),
    closest AS (SELECT * FROM single QUALIFY row_number() OVER (PARTITION BY asked ORDER BY sim DESC, text_id) <= 25),
    enough AS (SELECT asked FROM closest GROUP BY 1 HAVING count(*) >= 3),
    met AS (SELECT c.msg_id AS reply_id, n.text_id, n.sim FROM c JOIN texts x ON x.text = c.t JOIN enough e ON e.asked = x.text_id JOIN closest n USING (asked)),
    drawn AS (SELECT *, row_number() OVER (PARTITION BY reply_id ORDER BY md5('5,' || reply_id || ',' || text_id), reply_id, text_id) AS rank
              FROM met QUALIFY rank <= 3)"""


@register("z4_similar_replies", CLOSE + """
    SELECT asked AS reply_id, text_id, round(sim, 6) + 0.0 AS similarity, row_number() OVER (PARTITION BY asked ORDER BY sim DESC, text_id) AS rank FROM best""")
def _(a: Archive):
    asked = texts(a).withColumn("said", F.md5("text")).join(replies(a).select(F.md5("reply").alias("said")).distinct(), "said", "left_semi")
    return shape(l.similar_replies_each(texts(a), vectors(a), asked), reply_id="n", text_id="n", similarity="d", rank="n")


@register("z4_meaning_matched_distractors", CLOSE + " SELECT reply_id, text_id, round(sim, 6) + 0.0 AS similarity, rank FROM drawn")
def _(a: Archive):
    return shape(z.meaning_matched(replies(a), texts(a), vectors(a), seed=5), reply_id="n", text_id="n", similarity="d", rank="n")


@register("z4_distractor_sources", CLOSE + """,
    pool AS (SELECT DISTINCT chat_id, lower(trim(text)) AS f, min(length(trim(text))) OVER (PARTITION BY chat_id, lower(trim(text))) AS len
             FROM messages WHERE is_from_me AND length(trim(text)) > 0),
    fallback AS (SELECT c.msg_id AS reply_id FROM c JOIN pool p ON p.chat_id <> c.chat_id AND p.f <> lower(c.t)
                   AND p.len BETWEEN floor(length(c.t) * 0.6::DOUBLE) AND floor(length(c.t) * 1.4::DOUBLE) + 1
                 WHERE c.msg_id NOT IN (SELECT reply_id FROM drawn) GROUP BY 1 HAVING count(DISTINCT p.f) >= 3)
    SELECT DISTINCT reply_id, 'meaning' AS source, 3::BIGINT AS options FROM drawn
    UNION ALL SELECT reply_id, 'length', 3 FROM fallback""")
def _(a: Archive):
    rows = z.distractors(a.star, replies(a), texts(a), vectors(a), seed=5)
    return shape(rows.groupBy("reply_id", "source").agg(F.count(F.lit(1)).alias("options")), reply_id="n", source="s", options="n")


@register("z5_which_group_windows", windows_sql(
    """SELECT * FROM messages WHERE text IS NOT NULL AND chat_id IN (
         SELECT chat_id FROM messages JOIN chats USING (chat_id) WHERE is_group AND text IS NOT NULL AND length(trim(name)) > 0
         GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20)""", "chat_id", 6, "count(*) >= 4", 0))
def _(a: Archive):
    return hashed(which(a), "chat_id")


@register("z5_which_group_rounds")
def _(a: Archive):
    rounds = z.seeded_rounds(which(a), ["chat_id"], ["session_id", "start"], seed=3)
    asked = z.with_choices(rounds, z.named_groups(a.star).select("chat_id"), "chat_id", seed=3)
    return asked.select("chat_id", "session_id", "start", "date", F.to_json("choices").alias("choices"))


@register("z6_who_says_it_more", f"""
    WITH t AS (SELECT person_id, count(*) AS total FROM direct_texts WHERE NOT is_from_me AND person_id IN (SELECT person_id FROM eligible) GROUP BY 1),
    u AS (SELECT person_id, word, count(*) AS c, count(*) / any_value(total) * 1000 AS rate
          FROM words JOIN t USING (person_id) WHERE NOT is_from_me AND NOT grp GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT word, x.person_id AS answer_person_id, x.c AS answer_count, {r('x.rate', 'high')}, y.person_id AS other_person_id,
           y.c AS other_count, {r('y.rate', 'low')}
    FROM u x JOIN u y USING (word) WHERE x.person_id <> y.person_id AND x.rate / y.rate >= 1.5""")
def _(a: Archive):
    return shape(z.who_says_it_more(a.star), word="s", answer_person_id="n", answer_count="n", high="d", other_person_id="n", other_count="n", low="d")
