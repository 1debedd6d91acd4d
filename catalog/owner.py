"""Overview and owner queries Q13-Q26."""
from __future__ import annotations

from palaver.plans import owner as o

from .base import Archive, register, shape
from .persons import bucket, r


def _overview(unit: str) -> str:
    return f"""
    SELECT {bucket(unit, 'ts_local')} AS bucket, count(*) FILTER (is_from_me) AS sent,
           count(*) FILTER (NOT is_from_me) AS received FROM messages GROUP BY 1"""


@register("q13_overview_monthly", _overview("month"))
def _(a: Archive):
    return shape(o.overview_series(a.messages), bucket="s", sent="n", received="n")


@register("q13_overview_daily", _overview("day"))
def _(a: Archive):
    return shape(o.overview_series(a.messages, "day"), bucket="s", sent="n", received="n")


@register("q14_owner_totals", f"""
    SELECT count(*) AS sent_total, {r('avg(char_len)', 'avg_chars')}, sum(emoji_count)::BIGINT AS emoji_total,
           count(*) FILTER (grp) AS sent_in_groups, count(*) FILTER (NOT grp) AS sent_in_dms
    FROM messages WHERE is_from_me""")
def _(a: Archive):
    return shape(o.totals(a.star), sent_total="n", avg_chars="d", emoji_total="n", sent_in_groups="n", sent_in_dms="n")


@register("q15_owner_top_words", """
    SELECT word, count(*) AS count FROM words WHERE is_from_me GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def _(a: Archive):
    return shape(o.top_words(a.word_uses), word="s", count="n")


@register("q16_owner_repeated_sentences", """
    SELECT trim(text) AS text, count(*) AS count FROM messages WHERE is_from_me AND length(trim(text)) >= 8
    GROUP BY 1 HAVING count >= 3 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(a: Archive):
    return shape(o.repeated_sentences(a.said), text="s", count="n")


@register("q17_owner_top_emojis", """
    SELECT emoji, count(*) AS count FROM emoji_uses JOIN messages USING (msg_id) WHERE is_from_me
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(a: Archive):
    return shape(o.top_emojis(a.star), emoji="s", count="n")


@register("q18_owner_reactions", "SELECT kind, count(*) AS count FROM tapbacks WHERE is_from_me GROUP BY 1")
def _(a: Archive):
    return shape(o.reactions_given(a.tapbacks), kind="s", count="n")


@register("q19_owner_heatmap", """
    SELECT dayofweek(ts_local) AS weekday, hour(ts_local) AS hour, count(*) AS count FROM messages
    WHERE is_from_me GROUP BY 1, 2""")
def _(a: Archive):
    return shape(o.heatmap(a.messages), weekday="n", hour="n", count="n")


@register("q19_owner_busiest_day", f"""
    SELECT {bucket('day', 'ts_local')} AS date, count(*) AS count FROM messages WHERE is_from_me
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def _(a: Archive):
    return shape(o.busiest_day(a.messages), date="s", count="n")


@register("q20_owner_reply_habits", f"""
    WITH sizes AS (SELECT chat_id, block_no, bool_or(is_from_me) AS me, count(*) AS n FROM flow GROUP BY 1, 2)
    SELECT {r('avg(n) FILTER (me)', 'avg_texts_per_reply')},
           (SELECT count(*) FROM flow WHERE double_text = 1 AND is_from_me) AS double_texts FROM sizes""")
def _(a: Archive):
    return shape(o.reply_habits(a.flow), avg_texts_per_reply="d", double_texts="n")


@register("q21_word_context", r"""
    SELECT trim(text) AS text, count(*) AS count FROM messages
    WHERE is_from_me AND regexp_matches(replace(lower(text), '’', ''''), '\bthing\b')
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def _(a: Archive):
    return shape(o.word_context(a.said, "thing"), text="s", count="n")


@register("q22_vernacular_timeline", """
    SELECT strftime(ts_local, '%Y') AS year, word, count(*) AS count,
           row_number() OVER (PARTITION BY strftime(ts_local, '%Y') ORDER BY count(*) DESC, word) AS rank
    FROM words WHERE is_from_me GROUP BY 1, 2 QUALIFY rank <= 8""")
def _(a: Archive):
    return shape(o.vernacular_timeline(a.word_uses), year="s", word="s", count="n", rank="n")


@register("q23_owner_calendar", f"""
    SELECT {bucket('day', 'ts_local')} AS date, count(*) AS count FROM messages WHERE is_from_me GROUP BY 1""")
def _(a: Archive):
    return shape(o.calendar(a.messages), date="s", count="n")


@register("q24_catchphrase_timeline", """
    SELECT strftime(ts_local, '%Y') AS year, trim(text) AS text, count(*) AS count,
           row_number() OVER (PARTITION BY strftime(ts_local, '%Y') ORDER BY count(*) DESC, trim(text)) AS rank
    FROM messages WHERE is_from_me AND length(trim(text)) >= 8
    GROUP BY 1, 2 HAVING count(*) >= 2 QUALIFY rank <= 5""")
def _(a: Archive):
    return shape(o.catchphrase_timeline(a.said), year="s", text="s", count="n", rank="n")


@register("q25_owner_hot_days", f"""
    WITH d AS (SELECT {bucket('day', 'ts_local')} AS date, * FROM messages),
    days AS (SELECT date, count(*) AS count, count(*) FILTER (is_from_me) AS sent FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
    tops AS (SELECT date, display_name, row_number() OVER (PARTITION BY date ORDER BY count(*) DESC, display_name) AS i
             FROM d JOIN persons USING (person_id) WHERE NOT starts_with(display_name, 'urn:') GROUP BY 1, 2)
    SELECT days.date, days.count, days.sent, tops.display_name AS top_contact
    FROM days LEFT JOIN tops ON tops.date = days.date AND i = 1""")
def _(a: Archive):
    return shape(o.hot_days(a.star), date="s", count="n", sent="n", top_contact="s")


@register("q26_owner_day_transcripts", f"""
    WITH rws AS (
        SELECT {bucket('day', 'ts_local')} AS date, m.chat_id, m.ts_local, m.msg_id, c.is_group, c.name,
               p.display_name AS sender,
               strftime(ts_local, '%H:%M') || ' ' || CASE WHEN is_from_me THEN 'You'
                 ELSE coalesce(p.display_name, 'Someone') END || ': ' || left(text, 200) AS line,
               row_number() OVER (PARTITION BY m.ts_local::DATE, m.chat_id ORDER BY m.ts_local, m.msg_id) AS i
        FROM messages m JOIN chats c USING (chat_id) LEFT JOIN persons p ON p.person_id = m.person_id
        WHERE text IS NOT NULL),
    ch AS (
        SELECT date, chat_id, least(count(*), 80) AS shown, min(ts_local) AS began,
               arg_min(msg_id, i) AS began_id,
               CASE WHEN any_value(is_group)
                    THEN '— Group chat: ' || coalesce(nullif(any_value(name), ''), 'unnamed') || ' —'
                    ELSE '— Conversation with ' || coalesce(arg_max(sender, i) FILTER (sender IS NOT NULL), 'unknown') || ' —'
               END AS header,
               string_agg(line, chr(10) ORDER BY i) FILTER (i <= 80) AS body
        FROM rws GROUP BY 1, 2),
    pick AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY shown DESC, began, began_id) AS place FROM ch
             QUALIFY place <= 8)
    SELECT date, count(*) AS chats,
           left(string_agg(header || chr(10) || body, chr(10) || chr(10) ORDER BY place), 16000) AS transcript
    FROM pick GROUP BY 1""")
def _(a: Archive):
    return shape(o.day_transcripts(a.star), date="s", chats="n", transcript="s")
