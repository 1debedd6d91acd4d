"""Source, sink and row-derivation queries S1-S10 and D1-D18 (artifact reads live with their builders)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palaver.functions import text as tx, timefn as tf
from palaver.functions.body import body_text
from palaver.plans import ingest
from palaver.session import shared_dir
from palaver.sources.events import with_overrides
from palaver.sources.raw import attachment_scan, contact_names, message_rows, message_scan, read_star, write_star
from palaver.sources.schemas import STAR

from .base import Archive, r6, register, shape, stamp
from .persons import r

TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


def ts(column: str) -> str:
    return TS.format(column)


@register("s1_message_scan", """
    SELECT msg_id, guid, chat_id, CASE WHEN event_type = 'signup' THEN NULL ELSE text END AS text,
           event_type = 'signup' AS has_body, (epoch_us(ts) - 978307200000000) * 1000 AS date,
           mine::INT::BIGINT AS is_from_me, code AS associated_message_type, item::BIGINT AS item_type,
           CASE WHEN code > 0 THEN 'p:0/g' || (msg_id - 1) END AS associated_message_guid
    FROM raw_rows""")
def _(a: Archive):
    rows = message_scan(a.raw).withColumn("has_body", F.col("body").isNotNull())
    return shape(rows, msg_id="n", guid="s", chat_id="n", text="s", has_body="b", date="n", is_from_me="n",
                 associated_message_type="n", item_type="n", associated_message_guid="s")


@register("s2_attachment_scan", "SELECT msg_id, mime_type, total_bytes FROM attachments")
def _(a: Archive):
    return shape(attachment_scan(a.raw), msg_id="n", mime_type="s", total_bytes="n")


@register("s3_handle_chat_member_scans", """
    SELECT 'handle' AS kind, peer::BIGINT AS id, CASE WHEN peer % 13 = 0 THEN 'urn:biz:' || peer
                                             ELSE '+1 (5) ' || (100000000 + peer) END AS value FROM people
    UNION ALL SELECT 'handle', 1000000000 + peer, 'Person' || peer || '@Example.COM' FROM people
              WHERE peer % 13 <> 0 AND peer % 4 = 0
    UNION ALL SELECT 'chat', chat_id, CASE WHEN is_group THEN '43' ELSE '45' END FROM chats
    UNION ALL SELECT DISTINCT 'member', c + 1, peer::VARCHAR FROM ev""")
def _(a: Archive):
    handles = a.raw["handle"].select(F.lit("handle").alias("kind"), F.col("handle_id").alias("id"), F.col("id").alias("value"))
    chats = a.raw["chat"].select(F.lit("chat").alias("kind"), F.col("chat_id").alias("id"), F.col("style").cast("string").alias("value"))
    members = a.raw["chat_handle"].select(F.lit("member").alias("kind"), F.col("chat_id").alias("id"), F.col("handle_id").cast("string").alias("value"))
    return shape(handles.union(chats).union(members), kind="s", id="n", value="s")


@register("s4_contact_names", """
    SELECT '5' || (100000000 + peer) AS norm, 'Person ' || peer AS name FROM people WHERE peer % 13 <> 0
    UNION ALL SELECT 'person' || peer || '@example.com', 'Person ' || peer FROM people WHERE peer % 13 <> 0""")
def _(a: Archive):
    return contact_names(a.raw).select("norm", "name")


@register("s5_persons_with_overrides", """
    WITH h AS (
        SELECT peer::BIGINT AS handle_id, peer, CASE WHEN peer % 13 = 0 THEN 'urn:biz:' || peer
               WHEN peer % 17 = 0 THEN 'Crew' ELSE 'Person ' || peer END AS named,
               CASE WHEN peer % 13 = 0 THEN 'unmatched' WHEN peer % 17 = 0 THEN 'override' ELSE 'contacts' END AS source,
               CASE WHEN peer % 13 <> 0 AND peer % 11 = 0 THEN 'Pal ' || peer END AS renamed FROM people
        UNION ALL SELECT 1000000000 + peer, peer, 'Person ' || peer, 'contacts', NULL FROM people
                  WHERE peer % 13 <> 0 AND peer % 4 = 0),
    k AS (SELECT named, min(handle_id) AS first, arg_min(source, handle_id) AS source,
                 arg_max(renamed, handle_id) FILTER (renamed IS NOT NULL) AS renamed FROM h GROUP BY 1)
    SELECT dense_rank() OVER (ORDER BY first) AS person_id, coalesce(renamed, named) AS display_name, source FROM k""")
def _(a: Archive):
    return shape(ingest.resolve_persons(with_overrides(a.raw))[0], person_id="n", display_name="s", source="s")


@register("s6_star_schema_round_trip", """
    SELECT 'messages' AS name, count(*) AS n FROM messages UNION ALL SELECT 'persons', count(*) FROM persons
    UNION ALL SELECT 'chats', count(*) FROM chats UNION ALL SELECT 'chat_members', count(*) FROM chat_members
    UNION ALL SELECT 'tapbacks', count(*) FROM tapbacks UNION ALL SELECT 'attachments', count(*) FROM attachments
    UNION ALL SELECT 'emoji_uses', count(*) FROM emoji_uses
    UNION ALL SELECT 'word_uses', count(*) FROM (SELECT DISTINCT chat_id, person_id, is_from_me, strftime(ts_local, '%Y') AS year, word FROM words)
    UNION ALL SELECT 'handles', count(*) + count(*) FILTER (peer % 13 <> 0 AND peer % 4 = 0) FROM people""")
def _(a: Archive):
    folder = f"{shared_dir(a.spark)}/copy-{uuid.uuid4().hex}"
    star = {name: a.star[name] for name in STAR}
    write_star(star, folder)
    write_star(star, folder)  # a second full rebuild leaves the same rows
    out = None
    for name, df in read_star(a.spark, folder, shared="shared_text" in a.star).items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@register("d1_source_time", f"""
    SELECT msg_id, {ts('ts')} AS sent_at, CASE WHEN mine THEN {ts("ts + INTERVAL 60 SECOND")} END AS read_at,
           {ts("TIMESTAMP '2001-01-01' + INTERVAL 1 SECOND * (msg_id + 1)")} AS legacy_at FROM raw_rows""")
def _(a: Archive):
    return message_rows(a.raw).select(
        "msg_id", stamp(tf.source_time(F.col("date"))).alias("sent_at"),
        stamp(tf.source_time(F.col("date_read"))).alias("read_at"),
        stamp(tf.source_time(F.col("msg_id") + 1)).alias("legacy_at"))


@register("d2_normalize_handle", """
    SELECT peer::BIGINT AS handle_id, CASE WHEN peer % 13 = 0 THEN peer::VARCHAR ELSE '5' || (100000000 + peer) END AS norm FROM people
    UNION ALL SELECT 1000000000 + peer, 'person' || peer || '@example.com' FROM people WHERE peer % 13 <> 0 AND peer % 4 = 0""")
def _(a: Archive):
    return a.raw["handle"].select(F.col("handle_id").cast("bigint").alias("handle_id"), tx.normalize_handle(F.col("id")).alias("norm"))


@register("d3_body_text", """
    SELECT event_id AS msg_id, d.text || ' 🎉🎉' AS text
    FROM events JOIN documents d ON d.doc_id = event_id % (SELECT count(*) FROM documents) WHERE event_type = 'signup'""")
def _(a: Archive):
    return a.raw["message"].where(F.col("body").isNotNull()).select("msg_id", body_text(F.col("body")).alias("text"))


@register("d4_text_stats", "SELECT msg_id, char_len, word_count, emoji_count FROM messages")
def _(a: Archive):
    rows = a.said.select("msg_id", *[c.alias(n) for n, c in tx.text_stats(F.col("text")).items()])
    return shape(rows, msg_id="n", char_len="n", word_count="n", emoji_count="n")


@register("d5_emoji_uses", "SELECT msg_id, emoji FROM emoji_uses")
def _(a: Archive):
    return ingest.emoji_uses(a.said)


@register("d6_text_fallback", "SELECT msg_id, text FROM raw_rows")
def _(a: Archive):
    return a.raw["message"].select(
        "msg_id", F.coalesce(F.nullif(F.col("text"), F.lit("")), body_text(F.col("body"))).alias("text"))


@register("d7_message_and_reaction_split", """
    SELECT CASE WHEN code = 0 THEN 'message' ELSE CASE code WHEN 2000 THEN 'love' WHEN 2001 THEN 'like'
           WHEN 2002 THEN 'dislike' WHEN 2003 THEN 'laugh' WHEN 2004 THEN 'emphasize' ELSE 'question' END END AS kind,
           count(*) AS n
    FROM raw_rows WHERE (code = 0 AND item = 0) OR code BETWEEN 2000 AND 2005 GROUP BY 1""")
def _(a: Archive):
    real = ingest.real_messages(message_rows(a.raw)).select(F.lit("message").alias("kind"))
    return real.unionByName(ingest.reactions(message_rows(a.raw)).select("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@register("d8_reaction_target", "SELECT msg_id, target_guid FROM tapbacks")
def _(a: Archive):
    return ingest.reactions(message_rows(a.raw)).select("msg_id", "target_guid")


@register("d9_person_resolution", "SELECT person_id, display_name, source FROM persons")
def _(a: Archive):
    return shape(a.persons, person_id="n", display_name="s", source="s")


@register("d10_person_attribution", """
    SELECT msg_id, coalesce(person_id, 0) AS person_id, person_id IS NULL AS unattributed FROM messages""")
def _(a: Archive):
    rows = a.messages.select("msg_id", F.coalesce("person_id", F.lit(0)).alias("person_id"),
                             F.col("person_id").isNull().alias("unattributed"))
    return shape(rows, msg_id="n", person_id="n", unattributed="b")


@register("d11_membership", "SELECT chat_id, person_id, participant_count FROM chat_members JOIN chats USING (chat_id)")
def _(a: Archive):
    rows = a.chat_members.join(a.chats, "chat_id")
    return shape(rows, chat_id="n", person_id="n", participant_count="n")


@register("d12_group_flag", "SELECT chat_id, is_group, coalesce(name, '') AS name FROM chats")
def _(a: Archive):
    return a.chats.select(F.col("chat_id").cast("bigint").alias("chat_id"), "is_group", F.coalesce("name", F.lit("")).alias("name"))


@register("d13_local_time", f"""
    SELECT msg_id, {ts("ts_utc AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York'")} AS new_york,
           {ts("ts_utc AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Kolkata'")} AS kolkata FROM messages""")
def _(a: Archive):
    return a.messages.select("msg_id", *[
        stamp(tf.local_time(F.col("ts_utc"), zone)).alias(name)
        for name, zone in (("new_york", "America/New_York"), ("kolkata", "Asia/Kolkata"))])


@register("d14_has_attachment", "SELECT msg_id, has_attachment, is_audio FROM messages")
def _(a: Archive):
    return a.messages.select("msg_id", "has_attachment", "is_audio")


@register("d15_sessions", f"SELECT msg_id, session_id, {ts('ts_utc')} AS ts_utc FROM messages")
def _(a: Archive):
    rows = a.messages.select("msg_id", "chat_id", "ts_utc", "is_from_me").join(a.chats, "chat_id")
    return shape(ingest.with_sessions(rows), msg_id="n", session_id="s", ts_utc="t")


@register("d16_response_seconds", f"SELECT msg_id, {r('response_seconds', 'response_seconds')} FROM messages WHERE response_seconds IS NOT NULL")
def _(a: Archive):
    return a.messages.where(F.col("response_seconds").isNotNull()).select("msg_id", r6("response_seconds").alias("response_seconds"))


@register("d17_null_times_and_flags", """
    SELECT count(*) AS kept, count(*) FILTER (is_from_me) AS mine, count(*) FILTER (is_audio) AS audio FROM base_rows""")
def _(a: Archive):
    return a.messages.where(F.col("ts_utc").isNotNull()).agg(
        F.count(F.lit(1)).alias("kept"), F.count_if("is_from_me").alias("mine"), F.count_if("is_audio").alias("audio"))


@register("d18_ingest_summary", "SELECT (SELECT count(*) FROM base_rows) AS messages, (SELECT count(*) FROM chats) AS chats")
def _(a: Archive):
    return ingest.ingest_summary(a.raw)
