"""Person queries Q1-Q12."""
from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import timefn as tf
from palaver.plans import persons as p
from palaver.plans.ingest import message_flow

from .base import AS_OF, Archive, register, shape
from .oracle import STOP_LIST  # noqa: F401

R = "round({0}, 6) + 0.0 AS {1}"


def r(expr: str, name: str) -> str:
    return R.format(expr, name)


def r9(expr: str, name: str) -> str:
    return f"round({expr}, 9) + 0.0 AS {name}"


LEADER = f"""
    WITH v AS (
        SELECT contact_id, count(*) AS total, count(*) FILTER (is_from_me) AS sent,
               count(*) FILTER (NOT is_from_me) AS received, min(ts_local) AS first_ts, max(ts_local) AS last_ts,
               quantile_cont(response_seconds, 0.5) FILTER (is_from_me) AS rm,
               quantile_cont(response_seconds, 0.5) FILTER (NOT is_from_me) AS rt
        FROM dmw GROUP BY 1),
    s AS (
        SELECT contact_id, avg(first_mine::INT) AS init, avg(n) AS size, avg(dur) AS secs,
               count(*) FILTER (last_mine) AS g_them, count(*) FILTER (NOT last_mine) AS g_me
        FROM (SELECT contact_id, session_id, count(*) AS n, date_diff('second', min(ts_utc), max(ts_utc)) AS dur,
                     arg_min(is_from_me, k) AS first_mine, arg_max(is_from_me, k) AS last_mine
              FROM (SELECT *, row_number() OVER (ORDER BY ts_utc, msg_id) AS k FROM dmw) GROUP BY 1, 2) GROUP BY 1),
    fl AS (
        SELECT *, CASE WHEN pm = is_from_me AND ps = session_id THEN 0 ELSE 1 END AS nb,
               pm = is_from_me AND date_diff('second', pt, ts_utc) >= 600 AS dt
        FROM (SELECT *, lag(is_from_me) OVER w AS pm, lag(session_id) OVER w AS ps, lag(ts_utc) OVER w AS pt
              FROM dmw WINDOW w AS (PARTITION BY contact_id, chat_id ORDER BY ts_utc, msg_id))),
    b AS (
        SELECT contact_id, avg(n) FILTER (me) AS b_me, avg(n) FILTER (NOT me) AS b_them
        FROM (SELECT contact_id, chat_id, blk, bool_and(is_from_me) AS me, count(*) AS n
              FROM (SELECT *, sum(nb) OVER (PARTITION BY contact_id, chat_id ORDER BY ts_utc, msg_id
                                            ROWS UNBOUNDED PRECEDING) AS blk FROM fl) GROUP BY ALL) GROUP BY 1),
    d AS (
        SELECT contact_id, count(*) FILTER (dt AND is_from_me) AS d_me, count(*) FILTER (dt AND NOT is_from_me) AS d_them
        FROM fl GROUP BY 1),
    days AS (SELECT DISTINCT contact_id, ts_local::DATE AS day FROM dmw),
    st AS (
        SELECT contact_id, count(*) AS streak
        FROM (SELECT *, max(day) OVER (PARTITION BY contact_id) AS top,
                     row_number() OVER (PARTITION BY contact_id ORDER BY day DESC) AS i FROM days)
        WHERE top - day = i - 1 AND top >= DATE '{AS_OF[:10]}' - 1 GROUP BY 1)
    SELECT p.person_id, p.display_name, total, sent, received,
           strftime(first_ts, '%Y-%m-%d %H:%M:%S.%f') AS first_ts, strftime(last_ts, '%Y-%m-%d %H:%M:%S.%f') AS last_ts,
           {r9('rm', 'median_response_seconds_me')}, {r9('rt', 'median_response_seconds_them')},
           {r('init', 'initiation_rate_me')}, {r('size', 'avg_session_messages')}, {r('secs', 'avg_session_seconds')},
           g_them AS ghosts_by_them, g_me AS ghosts_by_me, {r('b_me', 'avg_reply_block_me')},
           {r('b_them', 'avg_reply_block_them')}, d_me AS double_texts_me, d_them AS double_texts_them,
           coalesce(streak, 0) AS streak_days
    FROM persons p JOIN v ON v.contact_id = p.person_id JOIN s ON s.contact_id = p.person_id
    JOIN b ON b.contact_id = p.person_id JOIN d ON d.contact_id = p.person_id
    LEFT JOIN st ON st.contact_id = p.person_id
    WHERE NOT starts_with(p.display_name, 'urn:')"""


def leader_sql(days: int | None = None) -> str:
    window = f"SELECT * FROM dm WHERE ts_local >= TIMESTAMP '{AS_OF}' - INTERVAL {days or 100000} DAY"
    return LEADER.replace("WITH v AS", f"WITH dmw AS ({window}), v AS", 1)


LEADER_COLUMNS = dict(
    person_id="n", display_name="s", total="n", sent="n", received="n", first_ts="t", last_ts="t",
    median_response_seconds_me="r", median_response_seconds_them="r", initiation_rate_me="d",
    avg_session_messages="d", avg_session_seconds="d", ghosts_by_them="n", ghosts_by_me="n",
    avg_reply_block_me="d", avg_reply_block_them="d", double_texts_me="n", double_texts_them="n", streak_days="n")


def leaderboard(a: Archive):
    return p.leaderboard(a.star, a.flow, AS_OF)


@register("q1_leaderboard", leader_sql())
def _(a: Archive):
    return shape(leaderboard(a), **LEADER_COLUMNS)


@register("q1d_leaderboard_last_10_days", leader_sql(10))
def _(a: Archive):
    recent = a.messages.where(tf.since(F.col("ts_local"), AS_OF, 10))
    return shape(p.leaderboard(a.star, message_flow(recent), AS_OF, 10), **LEADER_COLUMNS)


@register("q1a_session_metrics", f"""
    SELECT cm.person_id, {r('avg(first_mine::INT)', 'initiation_rate_me')}, {r('avg(n)', 'avg_session_messages')},
           {r('avg(dur)', 'avg_session_seconds')}, count(*) FILTER (last_mine) AS ghosts_by_them,
           count(*) FILTER (NOT last_mine) AS ghosts_by_me, count(*) AS sessions
    FROM sess s JOIN chats c USING (chat_id) JOIN chat_members cm USING (chat_id) WHERE NOT c.is_group GROUP BY 1""")
def _(a: Archive):
    return shape(p.session_metrics(a.messages, p.contacts_of(a.star)), person_id="n", initiation_rate_me="d",
                 avg_session_messages="d", avg_session_seconds="d", ghosts_by_them="n", ghosts_by_me="n", sessions="n")


@register("q1b_reply_blocks_and_double_texts", f"""
    WITH pairs AS (SELECT cm.chat_id, cm.person_id FROM chat_members cm JOIN chats c USING (chat_id) WHERE NOT c.is_group),
    sizes AS (SELECT chat_id, block_no, bool_or(is_from_me) AS me, count(*) AS n FROM flow GROUP BY 1, 2),
    b AS (SELECT person_id, avg(n) FILTER (me) AS x, avg(n) FILTER (NOT me) AS y
          FROM sizes JOIN pairs USING (chat_id) GROUP BY 1),
    d AS (SELECT person_id, sum(double_text) FILTER (is_from_me) AS x, sum(double_text) FILTER (NOT is_from_me) AS y
          FROM flow JOIN pairs USING (chat_id) GROUP BY 1)
    SELECT b.person_id, {r('b.x', 'avg_reply_block_me')}, {r('b.y', 'avg_reply_block_them')},
           coalesce(d.x, 0)::BIGINT AS double_texts_me, coalesce(d.y, 0)::BIGINT AS double_texts_them
    FROM b JOIN d USING (person_id)""")
def _(a: Archive):
    return shape(p.block_metrics(a.flow, p.contacts_of(a.star)), person_id="n", avg_reply_block_me="d",
                 avg_reply_block_them="d", double_texts_me="n", double_texts_them="n")


@register("q1c_current_streak", f"""
    WITH days AS (SELECT DISTINCT contact_id, ts_local::DATE AS day FROM dm),
    numbered AS (SELECT *, day + row_number() OVER (PARTITION BY contact_id ORDER BY day DESC)::INT AS anchor,
                        max(day) OVER (PARTITION BY contact_id) AS top FROM days)
    SELECT contact_id AS person_id, count(*) AS streak_days FROM numbered
    WHERE anchor = top + 1 AND top >= DATE '{AS_OF[:10]}' - 1 GROUP BY 1""")
def _(a: Archive):
    return shape(p.streaks(a.messages, p.contacts_of(a.star), AS_OF), person_id="n", streak_days="n")


@register("q2_monthly_timeline", """
    WITH best AS (SELECT contact_id FROM dm GROUP BY 1 ORDER BY count(*) DESC, contact_id LIMIT 40)
    SELECT strftime(ts_local, '%Y-%m') AS bucket, p.person_id, p.display_name, count(*) AS count
    FROM dm JOIN best USING (contact_id) JOIN persons p ON p.person_id = contact_id
    WHERE NOT starts_with(p.display_name, 'urn:') GROUP BY 1, 2, 3""")
def _(a: Archive):
    return shape(p.monthly_timeline(a.star), bucket="s", person_id="n", display_name="s", count="n")


def bucket(unit: str, column: str) -> str:
    return f"strftime(date_trunc('{unit}', {column}), '%Y-%m-%d')"


@register("q3_person_weekly_series", f"""
    SELECT contact_id AS person_id, {bucket('week', 'ts_local')} AS bucket, count(*) FILTER (is_from_me) AS sent,
           count(*) FILTER (NOT is_from_me) AS received FROM dm GROUP BY 1, 2""")
def _(a: Archive):
    return shape(p.time_series(a.star), person_id="n", bucket="s", sent="n", received="n")


@register("q3_person_daily_series_with_groups", f"""
    SELECT cm.person_id, {bucket('day', 'ts_local')} AS bucket, count(*) FILTER (is_from_me) AS sent,
           count(*) FILTER (NOT is_from_me) AS received
    FROM messages m JOIN chat_members cm USING (chat_id)
    WHERE NOT m.grp OR m.person_id = cm.person_id GROUP BY 1, 2""")
def _(a: Archive):
    return shape(p.time_series(a.star, "day", include_groups=True), person_id="n", bucket="s", sent="n", received="n")


@register("q4_person_stats", f"""
    WITH core AS (
        SELECT contact_id, count(*) AS total, count(*) FILTER (is_from_me) AS sent,
               count(*) FILTER (NOT is_from_me) AS received,
               median(response_seconds) FILTER (is_from_me) AS m1, median(response_seconds) FILTER (NOT is_from_me) AS m2,
               quantile_cont(response_seconds, 0.9) FILTER (is_from_me) AS p1,
               quantile_cont(response_seconds, 0.9) FILTER (NOT is_from_me) AS p2,
               avg(char_len) FILTER (is_from_me) AS c1, avg(char_len) FILTER (NOT is_from_me) AS c2
        FROM dm GROUP BY 1),
    pairs AS (SELECT cm.chat_id, cm.person_id AS contact_id FROM chat_members cm JOIN chats c USING (chat_id) WHERE NOT c.is_group),
    s AS (SELECT contact_id, avg(first_mine::INT) AS init, avg(n) AS size, avg(dur) AS secs,
                 count(*) FILTER (last_mine) AS g1, count(*) FILTER (NOT last_mine) AS g2
          FROM sess JOIN pairs USING (chat_id) GROUP BY 1),
    sizes AS (SELECT chat_id, block_no, bool_or(is_from_me) AS me, count(*) AS n FROM flow GROUP BY 1, 2),
    b AS (SELECT contact_id, avg(n) FILTER (me) AS x, avg(n) FILTER (NOT me) AS y
          FROM sizes JOIN pairs USING (chat_id) GROUP BY 1),
    d AS (SELECT contact_id, sum(double_text * is_from_me::INT) AS x, sum(double_text * (NOT is_from_me)::INT) AS y
          FROM flow JOIN pairs USING (chat_id) GROUP BY 1)
    SELECT p.person_id, p.display_name, total, sent, received, {r9('m1', 'median_response_seconds_me')},
           {r9('m2', 'median_response_seconds_them')}, {r9('p1', 'p90_response_seconds_me')},
           {r9('p2', 'p90_response_seconds_them')}, {r('c1', 'avg_chars_me')}, {r('c2', 'avg_chars_them')},
           {r('init', 'initiation_rate_me')}, {r('size', 'avg_session_messages')}, {r('secs', 'avg_session_seconds')},
           g1 AS ghosts_by_them, g2 AS ghosts_by_me, {r('b.x', 'avg_reply_block_me')}, {r('b.y', 'avg_reply_block_them')},
           {r('b.y / b.x', 'reply_block_ratio')}, d.x::BIGINT AS double_texts_me, d.y::BIGINT AS double_texts_them
    FROM persons p JOIN core c ON c.contact_id = p.person_id JOIN s ON s.contact_id = p.person_id
    JOIN b ON b.contact_id = p.person_id JOIN d ON d.contact_id = p.person_id""")
def _(a: Archive):
    return shape(
        p.person_stats(a.star, a.flow), person_id="n", display_name="s", total="n", sent="n", received="n",
        median_response_seconds_me="r", median_response_seconds_them="r", p90_response_seconds_me="r",
        p90_response_seconds_them="r", avg_chars_me="d", avg_chars_them="d", initiation_rate_me="d",
        avg_session_messages="d", avg_session_seconds="d", ghosts_by_them="n", ghosts_by_me="n",
        avg_reply_block_me="d", avg_reply_block_them="d", reply_block_ratio="d", double_texts_me="n",
        double_texts_them="n")


@register("q5_person_top_words", """
    SELECT cm.person_id, is_from_me, word, count(*) AS count,
           row_number() OVER (PARTITION BY cm.person_id, is_from_me ORDER BY count(*) DESC, word) AS rank
    FROM words w JOIN chat_members cm USING (chat_id) WHERE NOT w.grp
    GROUP BY 1, 2, 3 QUALIFY rank <= 10""")
def _(a: Archive):
    return shape(p.top_words(a.star), person_id="n", is_from_me="b", word="s", count="n", rank="n")


@register("q6_person_top_emojis", """
    SELECT contact_id AS person_id, is_from_me, emoji, count(*) AS count,
           row_number() OVER (PARTITION BY contact_id, is_from_me ORDER BY count(*) DESC, emoji) AS rank
    FROM emoji_uses e JOIN dm USING (msg_id) GROUP BY 1, 2, 3 QUALIFY rank <= 10""")
def _(a: Archive):
    return shape(p.top_emojis(a.star), person_id="n", is_from_me="b", emoji="s", count="n", rank="n")


@register("q7_person_reactions", """
    SELECT person_id, kind, 'from_them' AS direction, count(*) AS count
    FROM tapbacks WHERE person_id IS NOT NULL GROUP BY 1, 2
    UNION ALL
    SELECT m.person_id, t.kind, 'from_me', count(*) FROM tapbacks t JOIN messages m ON m.guid = t.target_guid
    WHERE t.is_from_me AND NOT m.is_from_me AND m.person_id IS NOT NULL GROUP BY 1, 2""")
def _(a: Archive):
    return shape(p.reactions_by_kind(a.star), person_id="n", kind="s", direction="s", count="n")


def trends_sql(unit: str) -> str:
    return f"""
    WITH pairs AS (SELECT cm.chat_id, cm.person_id FROM chat_members cm JOIN chats c USING (chat_id) WHERE NOT c.is_group),
    vol AS (
        SELECT contact_id AS person_id, {bucket(unit, 'ts_local')} AS bucket, count(*) FILTER (is_from_me) AS sent,
               count(*) FILTER (NOT is_from_me) AS received, median(response_seconds) FILTER (is_from_me) AS a,
               median(response_seconds) FILTER (NOT is_from_me) AS b FROM dm GROUP BY 1, 2),
    smooth AS (SELECT person_id, bucket, sent, received, avg(a) OVER w AS a, avg(b) OVER w AS b FROM vol
               WINDOW w AS (PARTITION BY person_id ORDER BY bucket ROWS 3 PRECEDING)),
    sizes AS (SELECT chat_id, block_no, bool_or(is_from_me) AS me, count(*) AS n, min(ts_local) AS t0 FROM flow GROUP BY 1, 2),
    blk AS (SELECT person_id, {bucket(unit, 't0')} AS bucket, avg(n) FILTER (me) AS x, avg(n) FILTER (NOT me) AS y
            FROM sizes JOIN pairs USING (chat_id) GROUP BY 1, 2),
    dbl AS (SELECT person_id, {bucket(unit, 'ts_local')} AS bucket, sum(double_text * is_from_me::INT) AS x,
                   sum(double_text * (NOT is_from_me)::INT) AS y FROM flow JOIN pairs USING (chat_id) GROUP BY 1, 2),
    st AS (SELECT person_id, {bucket(unit, 't0')} AS bucket, avg(first_mine::INT) AS x
           FROM sess JOIN pairs USING (chat_id) GROUP BY 1, 2)
    SELECT person_id, bucket, sent, received, {r9('smooth.a', 'median_reply_me')}, {r9('smooth.b', 'median_reply_them')},
           {r('blk.x', 'texts_per_reply_me')}, {r('blk.y', 'texts_per_reply_them')},
           coalesce(dbl.x, 0)::BIGINT AS double_texts_me, coalesce(dbl.y, 0)::BIGINT AS double_texts_them,
           {r('st.x', 'initiation_me')}
    FROM smooth LEFT JOIN blk USING (person_id, bucket) LEFT JOIN dbl USING (person_id, bucket)
    LEFT JOIN st USING (person_id, bucket)"""


TREND_COLUMNS = dict(
    person_id="n", bucket="s", sent="n", received="n", median_reply_me="r", median_reply_them="r",
    texts_per_reply_me="d", texts_per_reply_them="d", double_texts_me="n", double_texts_them="n", initiation_me="d")


@register("q8_person_monthly_trends", trends_sql("month"))
def _(a: Archive):
    return shape(p.trends(a.star, a.flow), **TREND_COLUMNS)


@register("q8_person_daily_trends", trends_sql("day"))
def _(a: Archive):
    return shape(p.trends(a.star, a.flow, "day"), **TREND_COLUMNS)


@register("q9_person_hot_days", f"""
    SELECT contact_id AS person_id, {bucket('day', 'ts_local')} AS date, count(*) AS count,
           count(*) FILTER (is_from_me) AS sent, count(*) FILTER (NOT is_from_me) AS received,
           row_number() OVER (PARTITION BY contact_id ORDER BY count(*) DESC, {bucket('day', 'ts_local')}) AS rank
    FROM dm GROUP BY 1, 2 QUALIFY rank <= 8""")
def _(a: Archive):
    return shape(p.hot_days(a.star), person_id="n", date="s", count="n", sent="n", received="n", rank="n")


@register("q10_person_heatmap", """
    SELECT contact_id AS person_id, dayofweek(ts_local) AS weekday, hour(ts_local) AS hour, count(*) AS count
    FROM dm GROUP BY 1, 2, 3""")
def _(a: Archive):
    return shape(p.heatmap(a.star), person_id="n", weekday="n", hour="n", count="n")


@register("q11_compare_persons", f"""
    SELECT p.person_id, p.display_name, {bucket('week', 'ts_local')} AS bucket, count(*) AS total
    FROM dm JOIN persons p ON p.person_id = contact_id WHERE p.person_id IN (1, 2, 3) GROUP BY 1, 2, 3""")
def _(a: Archive):
    return shape(p.compare(a.star, [1, 2, 3], "week"), person_id="n", display_name="s", bucket="s", total="n")


@register("q12_person_day_transcripts", f"""
    WITH lines AS (
        SELECT contact_id, {bucket('day', 'ts_local')} AS date,
               row_number() OVER (PARTITION BY contact_id, ts_local::DATE ORDER BY ts_local, msg_id) AS i,
               strftime(ts_local, '%H:%M') || ' ' || CASE WHEN is_from_me THEN 'You' ELSE p.display_name END || ': '
                 || left(text, 200) AS line
        FROM dm JOIN persons p ON p.person_id = contact_id WHERE text IS NOT NULL QUALIFY i <= 400)
    SELECT contact_id AS person_id, date, count(*) AS lines,
           left(string_agg(line, chr(10) ORDER BY i), 12000) AS transcript FROM lines GROUP BY 1, 2""")
def _(a: Archive):
    return shape(p.day_transcripts(a.star), person_id="n", date="s", lines="n", transcript="s")
