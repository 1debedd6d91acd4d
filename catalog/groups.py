"""Group queries Q27-Q34. Member 0 is the owner."""
from __future__ import annotations

from pyspark.sql import functions as F

from palaver.plans import groups as g

from .base import AS_OF, Archive, register, shape
from .persons import bucket, r

MEMBER = "CASE WHEN is_from_me THEN 0 ELSE person_id END"
MEMBERS = """(SELECT chat_id, person_id AS member_id, display_name FROM chat_members JOIN persons USING (person_id)
               JOIN groups USING (chat_id)
               UNION ALL SELECT chat_id, 0, 'You' FROM groups)"""


def _leader(days: int | None) -> str:
    return f"""
    SELECT chat_id, g.name, participant_count AS participants, count(*) AS total, {r('avg(is_from_me::INT)', 'my_share')},
           strftime(min(ts_local), '%Y-%m-%d %H:%M:%S.%f') AS first_ts,
           strftime(max(ts_local), '%Y-%m-%d %H:%M:%S.%f') AS last_ts
    FROM messages JOIN groups g USING (chat_id)
    WHERE ts_local >= TIMESTAMP '{AS_OF}' - INTERVAL {days or 100000} DAY GROUP BY 1, 2, 3"""


COLUMNS = dict(chat_id="n", name="s", participants="n", total="n", my_share="d", first_ts="t", last_ts="t")


@register("q27_group_leaderboard", _leader(None))
def _(a: Archive):
    return shape(g.leaderboard(a.star, AS_OF), **COLUMNS)


@register("q27_group_leaderboard_last_10_days", _leader(10))
def _(a: Archive):
    return shape(g.leaderboard(a.star, AS_OF, 10), **COLUMNS)


@register("q28_group_series", f"""
    SELECT chat_id, {bucket('week', 'ts_local')} AS bucket, count(*) AS total, count(*) FILTER (is_from_me) AS mine
    FROM messages WHERE grp GROUP BY 1, 2""")
def _(a: Archive):
    return shape(g.time_series(a.star), chat_id="n", bucket="s", total="n", mine="n")


@register("q29_group_heatmap", """
    SELECT chat_id, dayofweek(ts_local) AS weekday, hour(ts_local) AS hour, count(*) AS count
    FROM messages WHERE grp GROUP BY 1, 2, 3""")
def _(a: Archive):
    return shape(g.heatmap(a.star), chat_id="n", weekday="n", hour="n", count="n")


@register("q30_group_member_stats", f"""
    WITH gm AS (SELECT *, {MEMBER} AS member_id FROM messages WHERE grp),
    tot AS (SELECT chat_id, count(*) AS total, count(DISTINCT session_id) AS st FROM gm GROUP BY 1),
    core AS (SELECT chat_id, member_id, count(*) AS n, avg(char_len) AS c, count(DISTINCT session_id) AS sp FROM gm GROUP BY 1, 2),
    fin AS (SELECT chat_id, member_id, count(*) AS e
            FROM (SELECT chat_id, session_id, member_id,
                         row_number() OVER (PARTITION BY chat_id, session_id ORDER BY ts_utc DESC, msg_id DESC) AS i FROM gm)
            WHERE i = 1 GROUP BY 1, 2)
    SELECT chat_id, member_id, display_name, coalesce(n, 0) AS count, {r('coalesce(n / total, 0)', 'share')},
           {r('c', 'avg_chars')}, coalesce(st, 0) AS sessions_total, coalesce(sp, 0) AS sessions_participated,
           coalesce(st, 0) - coalesce(sp, 0) AS sessions_ghosted, coalesce(e, 0) AS sessions_ended
    FROM {MEMBERS} x LEFT JOIN tot USING (chat_id) LEFT JOIN core USING (chat_id, member_id)
    LEFT JOIN fin USING (chat_id, member_id)""")
def _(a: Archive):
    return shape(g.member_stats(a.star), chat_id="n", member_id="n", display_name="s", count="n", share="d",
                 avg_chars="d", sessions_total="n", sessions_participated="n", sessions_ghosted="n", sessions_ended="n")


@register("q31_group_member_words", f"""
    SELECT chat_id, {MEMBER} AS member_id, word, count(*) AS count,
           row_number() OVER (PARTITION BY chat_id, {MEMBER} ORDER BY count(*) DESC, word) AS rank
    FROM words WHERE grp GROUP BY 1, 2, 3 QUALIFY rank <= 10""")
def _(a: Archive):
    return shape(g.member_words(a.star), chat_id="n", member_id="n", word="s", count="n", rank="n")


@register("q31_group_member_emojis", f"""
    SELECT chat_id, {MEMBER} AS member_id, emoji, count(*) AS count,
           row_number() OVER (PARTITION BY chat_id, {MEMBER} ORDER BY count(*) DESC, emoji) AS rank
    FROM emoji_uses JOIN messages USING (msg_id) WHERE grp GROUP BY 1, 2, 3 QUALIFY rank <= 5""")
def _(a: Archive):
    return shape(g.member_emojis(a.star), chat_id="n", member_id="n", emoji="s", count="n", rank="n")


@register("q32_group_member_reactions", f"""
    WITH hits AS (
        SELECT m.chat_id, t.kind, CASE WHEN t.is_from_me THEN 0 ELSE t.person_id END AS actor,
               CASE WHEN m.is_from_me THEN 0 ELSE m.person_id END AS target
        FROM tapbacks t JOIN messages m ON m.guid = t.target_guid WHERE m.grp),
    al AS (SELECT chat_id, actor AS member_id, 'given' AS direction, kind, count(*) AS count FROM hits GROUP BY ALL
           UNION ALL SELECT chat_id, target, 'received', 'received', count(*) FROM hits GROUP BY ALL)
    SELECT al.* FROM al JOIN {MEMBERS} x USING (chat_id, member_id)""")
def _(a: Archive):
    return shape(g.member_reactions(a.star), chat_id="n", member_id="n", direction="s", kind="s", count="n")


@register("q33_group_member_series", f"""
    SELECT chat_id, {MEMBER} AS member_id, {bucket('week', 'ts_local')} AS bucket, count(*) AS count
    FROM messages WHERE grp GROUP BY ALL""")
def _(a: Archive):
    return shape(g.member_series(a.star), chat_id="n", member_id="n", bucket="s", count="n")


@register("q34_group_stats", f"""
    WITH gm AS (SELECT *, {MEMBER} AS mid FROM messages WHERE grp),
    tot AS (SELECT chat_id, count(*) AS total, avg(is_from_me::INT) AS mine, count(DISTINCT session_id) AS ss FROM gm GROUP BY 1),
    v AS (SELECT chat_id, mid, count(*) AS n, avg(char_len) AS c FROM gm GROUP BY 1, 2),
    rec AS (SELECT chat_id, coalesce(m.person_id, 0) AS mid, count(*) AS k
            FROM tapbacks t JOIN messages m ON m.guid = t.target_guid GROUP BY 1, 2),
    busy AS (SELECT chat_id, {bucket('day', 'ts_local')} AS d, count(*) AS k FROM gm GROUP BY 1, 2
             QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY k DESC, d) = 1)
    SELECT chat_id, g.name, v.mid AS person_id, CASE WHEN v.mid = 0 THEN 'You' ELSE p.display_name END AS display_name,
           v.n AS count, {r('v.n / total', 'share')}, {r('v.c', 'avg_chars')}, coalesce(rec.k, 0) AS tapbacks_received,
           {r('mine', 'my_share')}, ss AS session_count, busy.d AS busiest_date, busy.k AS busiest_count
    FROM v JOIN tot USING (chat_id) JOIN busy USING (chat_id) JOIN groups g USING (chat_id)
    LEFT JOIN rec USING (chat_id, mid) LEFT JOIN persons p ON p.person_id = v.mid""")
def _(a: Archive):
    rows = g.stats(a.star).withColumn("person_id", F.coalesce("person_id", F.lit(0)))
    return shape(rows, chat_id="n", name="s", person_id="n", display_name="s", count="n", share="d", avg_chars="d",
                 tapbacks_received="n", my_share="d", session_count="n", busiest_date="s", busiest_count="n")
