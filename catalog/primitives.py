"""Small queries for single predicates, joins, aggregates, windows, orders and functions."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from palaver.functions import text as tx, timefn as tf, vectors as v
from palaver.operators.bands import blocks_of, cover_of
from palaver.operators.ordered import with_even_slice, with_previous, with_running_sum
from palaver.operators.percentiles import exact_percentiles
from palaver.operators.topk import seeded_sample, top_per_group
from palaver.plans import common, groups as g, persons as p

from .base import AS_OF, Archive, r6, register, shape
from .oracle import FOLDED, STOP_LIST
from .persons import bucket, r, r9


def n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


# ---------------------------------------------------------------- filters

@register("f1_direct_only", "SELECT chat_id, count(*) AS n FROM messages WHERE NOT grp GROUP BY 1")
def _(a: Archive):
    direct = a.chats.where(~F.col("is_group")).select("chat_id")
    return shape(a.messages.groupBy("chat_id").agg(n()).join(direct, "chat_id", "left_semi"), chat_id="n", n="n")


@register("f2_group_only", "SELECT chat_id, count(*) AS n FROM messages WHERE grp GROUP BY 1")
def _(a: Archive):
    return shape(a.messages.groupBy("chat_id").agg(n()).join(g.groups(a.star), "chat_id", "left_semi"), chat_id="n", n="n")


@register("f3_direct_or_own_in_groups", """
    SELECT cm.person_id, count(*) AS n FROM messages m JOIN chat_members cm USING (chat_id)
    WHERE NOT m.grp OR m.person_id = cm.person_id GROUP BY 1""")
def _(a: Archive):
    rows = p.time_series(a.star, "month", include_groups=True)
    return shape(rows.groupBy("person_id").agg(F.sum(F.col("sent") + F.col("received")).alias("n")), person_id="n", n="n")


@register("f4_rolling_window", f"""
    SELECT count(*) FILTER (ts_local >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS week, count(*) AS everything FROM messages""")
def _(a: Archive):
    return a.messages.agg(
        F.count_if(tf.since(F.col("ts_local"), AS_OF, 7)).alias("week"),
        F.count_if(tf.since(F.col("ts_local"), AS_OF, 0)).alias("everything"))


@register("f5_known_names", "SELECT person_id, display_name FROM persons WHERE display_name NOT LIKE 'urn:%'")
def _(a: Archive):
    return shape(a.persons.where(p.known_name()), person_id="n", display_name="s")


@register("f6_member_filter", """
    SELECT chat_id, CASE WHEN is_from_me THEN 0 ELSE person_id END AS member_id, count(*) AS n FROM messages WHERE grp GROUP BY ALL""")
def _(a: Archive):
    return shape(g.group_messages(a.star).groupBy("chat_id", "member_id").agg(n()), chat_id="n", member_id="n", n="n")


@register("f7_text_present", """
    SELECT count(*) FILTER (text IS NOT NULL) AS present, count(*) FILTER (length(trim(text)) > 0) AS filled,
           count(*) FILTER (length(trim(text)) >= 100) AS long FROM messages""")
def _(a: Archive):
    size = F.char_length(F.trim("text"))
    return a.said.agg(F.count("text").alias("present"), F.count_if(size > 0).alias("filled"), F.count_if(size >= 100).alias("long"))


@register("f8_whole_word", rf"SELECT doc_id FROM documents WHERE regexp_matches({FOLDED}, '\bthe\b')")
def _(a: Archive):
    return a.given("documents").where(tx.contains_word(F.col("text"), "the")).select("doc_id")


@register("f9_stopwords", f"""
    WITH w AS (SELECT unnest(regexp_split_to_array({FOLDED}, '[^a-z'']+')) AS word FROM documents)
    SELECT word, count(*) AS n FROM w WHERE length(word) >= 3 AND word NOT IN ({STOP_LIST}) GROUP BY 1""")
def _(a: Archive):
    return common.word_rows(a.given("documents")).groupBy("word").agg(n())


@register("f10_single_day", f"SELECT chat_id, count(*) AS n FROM messages WHERE {bucket('day', 'ts_local')} = '2024-01-15' GROUP BY 1")
def _(a: Archive):
    return shape(a.messages.where(tf.on_day(F.col("ts_local"), "2024-01-15")).groupBy("chat_id").agg(n()), chat_id="n", n="n")


@register("f11_contentful_texts", r"""
    SELECT lang, count(*) AS n FROM documents
    WHERE length(text) >= 18 AND len(list_filter(regexp_split_to_array(text, '[\t-\r\x1c-\x20\x85\p{Z}]+'), lambda w: w <> '')) >= 4
    GROUP BY 1""")
def _(a: Archive):
    text = F.col("text")
    return a.given("documents").where((F.char_length(text) >= 18) & (tx.word_count(text) >= 4)).groupBy("lang").agg(n())


@register("f12_contentful_sessions", """
    SELECT session_id, count(*) AS n, sum(word_count)::BIGINT AS words FROM messages WHERE length(trim(text)) > 0
    GROUP BY 1 HAVING count(*) >= 3 AND sum(word_count) >= 20""")
def _(a: Archive):
    said = a.said.where(F.char_length(F.trim("text")) > 0)
    return said.groupBy("session_id").agg(n(), F.sum("word_count").alias("words")).where("n >= 3 AND words >= 20")


@register("f13_length_band_counts", """
    WITH c AS (SELECT n_chars AS len, count(*) AS k FROM documents GROUP BY 1)
    SELECT a.len, sum(b.k)::BIGINT AS n FROM c a JOIN c b
      ON b.len BETWEEN floor(a.len * 0.6::DOUBLE)::BIGINT AND floor(a.len * 1.4::DOUBLE)::BIGINT + 1 GROUP BY 1""")
def _(a: Archive):
    sizes = a.given("documents").groupBy(F.col("n_chars").alias("len")).agg(n("k"))
    held = sizes.select("k", F.explode(blocks_of(F.col("len"))).alias("b")).groupBy("b.level", "b.block").agg(F.sum("k").alias("k"))
    low, high = F.floor(F.col("len") * 0.6), F.floor(F.col("len") * 1.4) + 1
    wanted = sizes.select("len", F.explode(cover_of(low, high)).alias("b")).select("len", "b.level", "b.block")
    return wanted.join(held, ["level", "block"]).groupBy("len").agg(F.sum("k").alias("n"))


# ------------------------------------------------------------------ joins

@register("j1_messages_chats_members_persons", """
    SELECT p.display_name, count(*) AS n FROM dm JOIN persons p ON p.person_id = contact_id GROUP BY 1""")
def _(a: Archive):
    per_chat = a.messages.groupBy("chat_id").agg(n("k")).join(p.contacts_of(a.star), "chat_id")
    return per_chat.join(a.persons, "person_id").groupBy("display_name").agg(F.sum("k").alias("n"))


@register("j2_left_join_default", """
    SELECT p.person_id, coalesce(k, 0) AS n FROM persons p
    LEFT JOIN (SELECT person_id, count(*) AS k FROM tapbacks WHERE kind = 'love' GROUP BY 1) USING (person_id)""")
def _(a: Archive):
    loves = a.tapbacks.where("kind = 'love'").groupBy("person_id").agg(n("k"))
    rows = a.persons.join(loves, "person_id", "left").select("person_id", F.coalesce("k", F.lit(0)).alias("n"))
    return shape(rows, person_id="n", n="n")


@register("j3_full_outer_buckets", f"""
    WITH b AS (SELECT {bucket('day', 'ts_local')} AS bucket, count(*) AS blocks FROM flow WHERE new_block = 1 GROUP BY 1),
    d AS (SELECT {bucket('day', 'ts_local')} AS bucket, count(*) AS doubles FROM flow WHERE double_text = 1 GROUP BY 1)
    SELECT coalesce(b.bucket, d.bucket) AS bucket, coalesce(blocks, 0) AS blocks, coalesce(doubles, 0) AS doubles
    FROM b FULL JOIN d ON b.bucket = d.bucket""")
def _(a: Archive):
    day = tf.bucket("day", F.col("ts_local")).alias("bucket")
    blocks = a.flow.where("new_block = 1").groupBy(day).agg(n("blocks"))
    doubles = a.flow.where("double_text = 1").groupBy(day).agg(n("doubles"))
    return blocks.join(doubles, "bucket", "full").select(
        "bucket", F.coalesce("blocks", F.lit(0)).cast("bigint").alias("blocks"), F.coalesce("doubles", F.lit(0)).cast("bigint").alias("doubles"))


@register("j4_literal_on_bridge", "SELECT chat_id, count(*) AS n FROM dm WHERE contact_id = 2 GROUP BY 1")
def _(a: Archive):
    chosen = p.contacts_of(a.star).where("person_id = 2")
    return shape(a.messages.join(chosen.select("chat_id"), "chat_id", "left_semi").groupBy("chat_id").agg(n()), chat_id="n", n="n")


@register("j5_reaction_targets", """
    SELECT t.target_guid, t.kind, m.chat_id, m.is_from_me AS target_mine FROM tapbacks t JOIN messages m ON m.guid = t.target_guid""")
def _(a: Archive):
    rows = common.reaction_targets(a.tapbacks.select("target_guid", "kind"), a.messages)
    return shape(rows, target_guid="s", kind="s", chat_id="n", target_mine="b")


@register("j6_emoji_message_chat_member", "SELECT contact_id AS person_id, emoji, count(*) AS n FROM emoji_uses JOIN dm USING (msg_id) GROUP BY 1, 2")
def _(a: Archive):
    rows = a.emoji_uses.join(a.messages.select("msg_id", "chat_id"), "msg_id").groupBy("chat_id", "emoji").agg(n("k"))
    rows = rows.join(p.contacts_of(a.star), "chat_id").groupBy("person_id", "emoji").agg(F.sum("k").alias("n"))
    return shape(rows, person_id="n", emoji="s", n="n")


@register("j7_exists_and_scalar_subquery", f"""
    SELECT vec_id, {r("list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7))", 'similarity')}
    FROM embeddings WHERE EXISTS (SELECT 1 FROM embeddings WHERE vec_id = 7)""")
def _(a: Archive):
    target = a.given("embeddings").where("vec_id = 7").select("embedding")
    rows = a.given("embeddings").where(target.exists()).withColumn("target", target.scalar())
    return rows.select("vec_id", r6(v.cosine(F.col("embedding"), F.col("target"))).alias("similarity"))


@register("j8_scalar_aggregates", f"""
    SELECT {r("(SELECT avg(char_len) FROM messages WHERE is_from_me)", 'mine')}, {r("(SELECT avg(char_len) FROM messages WHERE NOT is_from_me)", 'theirs')},
           (SELECT count(*) FROM messages WHERE has_attachment) AS files""")
def _(a: Archive):
    size = F.col("char_len")
    return a.messages.agg(
        r6(F.avg(F.when(common.mine(), size))).alias("mine"), r6(F.avg(F.when(~common.mine(), size))).alias("theirs"),
        F.count_if("has_attachment").alias("files"))


@register("j9_float_tolerance", f"""
    WITH lay AS (SELECT vec_id, unnest([0.0, 0.05, 0.1]) + 1e-12 AS spread, embedding FROM embeddings)
    SELECT e.vec_id, {r('lay.embedding[1]::DOUBLE', 'x')} FROM embeddings e JOIN lay ON lay.vec_id = e.vec_id AND abs(lay.spread - 0.05) < 1e-9""")
def _(a: Archive):
    points = a.given("embeddings")
    layouts = points.select("vec_id", F.explode(F.array(*[F.lit(s + 1e-12) for s in (0.0, 0.05, 0.1)])).alias("spread"), F.col("embedding")[0].alias("x"))
    chosen = layouts.where(F.abs(F.col("spread") - 0.05) < 1e-9)
    return points.select("vec_id").join(chosen, "vec_id").select("vec_id", r6("x").alias("x"))


@register("j10_left_join_filtered_side", """
    SELECT m.chat_id, count(*) FILTER (p.person_id IS NULL) AS unnamed, count(p.person_id) AS named FROM messages m
    LEFT JOIN persons p ON p.person_id = m.person_id AND p.display_name NOT LIKE 'urn:%' GROUP BY 1""")
def _(a: Archive):
    named = a.persons.where(p.known_name()).select("person_id", F.lit(True).alias("known"))
    rows = a.messages.groupBy("chat_id", "person_id").agg(n("k")).join(named, "person_id", "left").groupBy("chat_id").agg(
        F.sum(F.when(F.col("known").isNull(), F.col("k")).otherwise(0)).alias("unnamed"),
        F.sum(F.when(F.col("known"), F.col("k")).otherwise(0)).alias("named"))
    return shape(rows, chat_id="n", unnamed="n", named="n")


@register("j12_uncached_texts", """
    SELECT count(*) AS n FROM (SELECT DISTINCT trim(text) AS t FROM messages WHERE ts_local >= TIMESTAMP '2024-01-11' AND length(trim(text)) > 0) x
    WHERE NOT EXISTS (SELECT 1 FROM messages m WHERE m.ts_local < TIMESTAMP '2024-01-11' AND trim(m.text) = x.t)""")
def _(a: Archive):
    text = F.trim("text").alias("t")
    split = F.lit("2024-01-11").cast("timestamp_ntz")
    cached = a.said.where(F.col("ts_local") < split).select(text)
    fresh = a.said.where((F.col("ts_local") >= split) & (F.char_length(F.trim("text")) > 0)).select(text).distinct()
    return fresh.join(cached, "t", "left_anti").agg(n())


@register("j13_label_reuse", """
    WITH s AS (SELECT label, count(*) AS size FROM embeddings GROUP BY 1),
    old AS (SELECT label, size, 'topic ' || label AS name FROM s WHERE label % 2 = 0)
    SELECT s.label::BIGINT AS label, s.size, coalesce(old.name, 'unlabeled') AS name FROM s LEFT JOIN old USING (label, size)""")
def _(a: Archive):
    sizes = a.given("embeddings").groupBy("label").agg(n("size"))
    old = sizes.where(F.pmod("label", F.lit(2)) == 0).withColumn("name", F.concat(F.lit("topic "), F.col("label").cast("string")))
    rows = sizes.join(old, ["label", "size"], "left").withColumn("name", F.coalesce("name", F.lit("unlabeled")))
    return shape(rows, label="n", size="n", name="s")


@register("j14_members_of_existing_groups", "SELECT cm.chat_id, cm.person_id FROM chat_members cm WHERE cm.chat_id IN (SELECT chat_id FROM groups)")
def _(a: Archive):
    return shape(a.chat_members.join(g.groups(a.star), "chat_id", "left_semi"), chat_id="n", person_id="n")


# ------------------------------------------------------------- aggregates

@register("a1_filtered_counts", """
    SELECT count(*) AS total, count(*) FILTER (is_from_me) AS sent, count(*) FILTER (NOT is_from_me) AS received FROM messages""")
def _(a: Archive):
    return a.messages.agg(n("total"), *common.sent_received())


@register("a2_median", f"SELECT chat_id, is_from_me, {r9('median(response_seconds)', 'median')} FROM messages WHERE response_seconds IS NOT NULL GROUP BY 1, 2")
def _(a: Archive):
    rows = exact_percentiles(a.messages, ["chat_id", "is_from_me"], common.reply_micros(), {"median": 0.5}, 1e6)
    return shape(rows, chat_id="n", is_from_me="b", median="r")


@register("a3_percentiles", f"""
    SELECT event_type, {r9('quantile_cont(value, 0.1)', 'p10')}, {r9('quantile_cont(value, 0.9)', 'p90')}, {r9('quantile_cont(value, 0.99)', 'p99')}
    FROM events GROUP BY 1""")
def _(a: Archive):
    cents = F.round(F.col("value") * 100).cast("long")
    rows = exact_percentiles(a.given("events"), ["event_type"], cents, {"p10": 0.1, "p90": 0.9, "p99": 0.99}, 100.0)
    return shape(rows, event_type="s", p10="r", p90="r", p99="r")


@register("a4_first_and_last_sender", "SELECT session_id, first_mine, last_mine FROM sess")
def _(a: Archive):
    return common.session_facts(a.messages).select("session_id", F.col("first_from_me").alias("first_mine"), F.col("last_from_me").alias("last_mine"))


@register("a5_any_value", "SELECT chat_id, block_no, any_value(is_from_me) AS is_from_me, count(*) AS n FROM flow GROUP BY 1, 2")
def _(a: Archive):
    return shape(common.block_facts(a.flow), chat_id="n", block_no="n", is_from_me="b", n="n")


@register("a6_rates", f"SELECT event_type, {r('avg((value > 50)::INT)', 'rate')}, {r('avg(value) FILTER (value > 50)', 'mean_high')} FROM events GROUP BY 1")
def _(a: Archive):
    high = F.col("value") > 50
    return a.given("events").groupBy("event_type").agg(
        r6(common.rate(high)).alias("rate"), r6(F.avg(F.when(high, F.col("value")))).alias("mean_high"))


@register("a7_distinct_counts", """
    SELECT chat_id, count(DISTINCT session_id) AS sessions, count(DISTINCT session_id) FILTER (is_from_me) AS joined FROM messages GROUP BY 1""")
def _(a: Archive):
    rows = a.messages.groupBy("chat_id").agg(
        F.count_distinct("session_id").alias("sessions"), F.count_distinct(F.when(common.mine(), F.col("session_id"))).alias("joined"))
    return shape(rows, chat_id="n", sessions="n", joined="n")


@register("a8_sums", "SELECT chat_id, coalesce(sum(emoji_count), 0)::BIGINT AS emojis, sum(char_len)::BIGINT AS chars FROM messages GROUP BY 1")
def _(a: Archive):
    rows = a.messages.groupBy("chat_id").agg(F.coalesce(F.sum("emoji_count"), F.lit(0)).alias("emojis"), F.sum("char_len").alias("chars"))
    return shape(rows, chat_id="n", emojis="n", chars="n")


@register("a9_time_span", "SELECT chat_id, date_diff('second', min(ts_utc), max(ts_utc)) AS seconds FROM messages GROUP BY 1")
def _(a: Archive):
    return shape(a.messages.groupBy("chat_id").agg(tf.seconds_between(F.min("ts_utc"), F.max("ts_utc")).alias("seconds")), chat_id="n", seconds="n")


@register("a10_having_two_conditions", """
    SELECT session_id, count(*) AS n FROM messages WHERE text IS NOT NULL AND NOT grp
    GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (NOT is_from_me) >= 2""")
def _(a: Archive):
    direct = a.chats.where(~F.col("is_group")).select("chat_id")
    rows = a.said.where(F.col("text").isNotNull()).groupBy("chat_id", "session_id").agg(n(), F.count_if(~common.mine()).alias("theirs"))
    return rows.where("n >= 3 AND theirs >= 2").join(direct, "chat_id", "left_semi").select("session_id", "n")


@register("a11_group_by_expressions", "SELECT dayofweek(ts) AS weekday, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def _(a: Archive):
    rows = a.given("events").groupBy(tf.weekday(F.col("ts")).alias("weekday"), F.hour("ts").alias("hour")).agg(n())
    return shape(rows, weekday="n", hour="n", n="n")


@register("a12_distinct", f"SELECT DISTINCT chat_id, {bucket('day', 'ts_local')} AS day FROM messages")
def _(a: Archive):
    return shape(a.messages.select("chat_id", tf.bucket("day", F.col("ts_local")).alias("day")).distinct(), chat_id="n", day="s")


@register("a13_two_levels", f"SELECT chat_id, {r('avg(n)', 'mean_size')}, max(n) AS largest FROM sess GROUP BY 1")
def _(a: Archive):
    rows = common.session_facts(a.messages).groupBy("chat_id").agg(F.avg("n").alias("mean_size"), F.max("n").alias("largest"))
    return shape(rows, chat_id="n", mean_size="d", largest="n")


@register("a14_multiset_top", """
    SELECT chat_id, word, count(*) AS n, row_number() OVER (PARTITION BY chat_id ORDER BY count(*) DESC, word) AS rank FROM words
    GROUP BY 1, 2 QUALIFY rank <= 3""")
def _(a: Archive):
    counts = a.word_uses.groupBy("chat_id", "word").agg(F.sum("count").alias("n"))
    return shape(top_per_group(counts, ["chat_id"], [F.desc("n"), F.asc("word")], 3), chat_id="n", word="s", n="n", rank="n")


@register("a15_multiset_difference", """
    SELECT word, count(*) - count(*) FILTER (is_from_me) AS n FROM words GROUP BY 1 HAVING count(*) > count(*) FILTER (is_from_me)""")
def _(a: Archive):
    counts = a.word_uses.groupBy("word").agg(F.sum(F.when(~common.mine(), F.col("count"))).alias("n"))
    return shape(counts.where("n > 0"), word="s", n="n")


# ---------------------------------------------------------------- windows

@register("w1_previous_row", f"""
    SELECT msg_id, coalesce(lag(is_from_me) OVER w, false) AS prev_mine, coalesce(lag(session_id) OVER w, '') AS prev_session
    FROM messages WINDOW w AS (PARTITION BY chat_id ORDER BY ts_utc, msg_id)""")
def _(a: Archive):
    order = ["ts_utc", "msg_id"]
    rows = with_even_slice(a.messages.select("msg_id", "chat_id", "ts_utc", "is_from_me", "session_id"), ["chat_id"], order)
    rows = with_previous(rows, ["chat_id"], order, ["is_from_me", "session_id"])
    return rows.select("msg_id", F.coalesce("prev_is_from_me", F.lit(False)).alias("prev_mine"), F.coalesce("prev_session_id", F.lit("")).alias("prev_session"))


@register("w2_block_numbers", "SELECT msg_id, new_block::BIGINT AS new_block, double_text::BIGINT AS double_text, block_no FROM flow")
def _(a: Archive):
    return shape(a.flow, msg_id="n", new_block="n", double_text="n", block_no="n")


@register("w3_global_order_blocks", """
    WITH f AS (SELECT msg_id, chat_id, ts_utc, CASE WHEN lag(is_from_me) OVER w = is_from_me AND lag(session_id) OVER w = session_id
                                               THEN 0 ELSE 1 END AS nb
               FROM messages WINDOW w AS (ORDER BY chat_id, ts_utc, msg_id)),
    b AS (SELECT msg_id, chat_id, sum(nb) OVER (ORDER BY chat_id, ts_utc, msg_id ROWS UNBOUNDED PRECEDING) AS k FROM f)
    SELECT msg_id, (k - min(k) OVER (PARTITION BY chat_id) + 1)::BIGINT AS block_no FROM b""")
def _(a: Archive):
    return shape(a.flow, msg_id="n", block_no="n")


@register("w4_latest_run_of_days", """
    WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events),
    x AS (SELECT *, max(day) OVER (PARTITION BY user_id) AS top, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS i FROM d)
    SELECT user_id, count(*) AS run FROM x WHERE top - day = i - 1 GROUP BY 1""")
def _(a: Archive):
    days = a.given("events").select("user_id", F.to_date("ts").alias("day")).distinct()
    whole = Window.partitionBy("user_id")
    rows = days.withColumn("top", F.max("day").over(whole)).withColumn("i", F.row_number().over(whole.orderBy(F.desc("day"))))
    return rows.where(F.date_diff("top", "day") == F.col("i") - 1).groupBy("user_id").agg(n("run"))


@register("w5_trailing_average", f"""
    SELECT chat_id, day, {r('avg(k) OVER (PARTITION BY chat_id ORDER BY day ROWS 3 PRECEDING)', 'smooth')}
    FROM (SELECT chat_id, {bucket('day', 'ts_local')} AS day, count(*) AS k FROM messages GROUP BY 1, 2)""")
def _(a: Archive):
    daily = a.messages.groupBy("chat_id", tf.bucket("day", F.col("ts_local")).alias("day")).agg(n("k"))
    trailing = Window.partitionBy("chat_id").orderBy("day").rowsBetween(-3, 0)
    return shape(daily.withColumn("smooth", F.avg("k").over(trailing)), chat_id="n", day="s", smooth="d")


@register("w6_top_per_group", """
    SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS rank
    FROM documents GROUP BY 1, 2 QUALIFY rank <= 3""")
def _(a: Archive):
    counts = a.given("documents").groupBy("lang", "source").agg(n())
    return shape(top_per_group(counts, ["lang"], [F.desc("n"), F.asc("source")], 3), lang="s", source="s", n="n", rank="n")


@register("w7_rank_by_aggregate", f"""
    SELECT {bucket('day', 'ts')} AS day, event_type, row_number() OVER (PARTITION BY {bucket('day', 'ts')} ORDER BY sum(value) DESC, event_type) AS place
    FROM events GROUP BY 1, 2""")
def _(a: Archive):
    sums = a.given("events").groupBy(tf.bucket("day", F.col("ts")).alias("day"), "event_type").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("s"))
    place = Window.partitionBy("day").orderBy(F.desc("s"), "event_type")
    return shape(sums.withColumn("place", F.row_number().over(place)), day="s", event_type="s", place="n")


@register("w8_row_numbers_chat_and_session", """
    SELECT msg_id, row_number() OVER (PARTITION BY chat_id ORDER BY ts_utc, msg_id) AS in_chat,
           row_number() OVER (PARTITION BY chat_id, session_id ORDER BY ts_utc, msg_id) AS in_session FROM messages""")
def _(a: Archive):
    rows = with_even_slice(a.messages.select("msg_id", "chat_id", "session_id", "ts_utc"), ["chat_id"], ["ts_utc", "msg_id"])
    rows = with_running_sum(rows, ["chat_id"], ["ts_utc", "msg_id"], F.lit(1), "in_chat")
    rows = with_running_sum(rows, ["chat_id", "session_id"], ["ts_utc", "msg_id"], F.lit(1), "in_session")
    return shape(rows, msg_id="n", in_chat="n", in_session="n")


# ------------------------------------------------- order, limits, set operations

@register("l1_order_limit_tie_break", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(a: Archive):
    return a.given("events").groupBy("user_id").agg(n()).orderBy(F.desc("n"), "user_id").limit(20)


@register("l2_top_kinds_per_person", """
    SELECT person_id, kind, count(*) AS n, row_number() OVER (PARTITION BY person_id ORDER BY count(*) DESC, kind) AS rank
    FROM tapbacks WHERE person_id IS NOT NULL GROUP BY 1, 2 QUALIFY rank <= 2""")
def _(a: Archive):
    counts = a.tapbacks.where(F.col("person_id").isNotNull()).groupBy("person_id", "kind").agg(n())
    return shape(top_per_group(counts, ["person_id"], [F.desc("n"), F.asc("kind")], 2), person_id="n", kind="s", n="n", rank="n")


@register("l3_limit_then_join", """
    WITH best AS (SELECT chat_id FROM messages GROUP BY 1 ORDER BY count(*) DESC, chat_id LIMIT 5)
    SELECT chat_id, is_from_me, count(*) AS n FROM messages JOIN best USING (chat_id) GROUP BY 1, 2""")
def _(a: Archive):
    counts = a.messages.groupBy("chat_id", "is_from_me").agg(n())
    best = counts.groupBy("chat_id").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "chat_id").limit(5)
    return shape(counts.join(best, "chat_id", "left_semi"), chat_id="n", is_from_me="b", n="n")


@register("l4_seeded_sample", "SELECT doc_id, lang FROM documents ORDER BY md5('7,' || doc_id), doc_id LIMIT 25")
def _(a: Archive):
    return seeded_sample(a.given("documents").select("doc_id", "lang"), 25, 7, "doc_id")


@register("l5_similarity_top_k", f"""
    SELECT vec_id, {r("list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3))", 'similarity')}
    FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 12""")
def _(a: Archive):
    target = a.given("embeddings").where("vec_id = 3").select("embedding").scalar()
    rows = a.given("embeddings").withColumn("target", target)
    return rows.select("vec_id", r6(v.cosine(F.col("embedding"), F.col("target"))).alias("similarity")).orderBy(
        F.desc("similarity"), "vec_id").limit(12)


@register("u1_union_all", "SELECT text, 'documents' AS origin FROM documents UNION ALL SELECT text, 'conversations' FROM conversations")
def _(a: Archive):
    return a.given("documents").select("text", F.lit("documents").alias("origin")).unionByName(
        a.given("conversations").select("text", F.lit("conversations").alias("origin")))


# -------------------------------------------------------------- functions

@register("x1_buckets", f"SELECT event_id, {bucket('day', 'ts')} AS day, {bucket('week', 'ts')} AS week, {bucket('month', 'ts')} AS month FROM events")
def _(a: Archive):
    return a.given("events").select("event_id", *[tf.bucket(u, F.col("ts")).alias(u) for u in tf.BUCKETS])


@register("x2_labels", "SELECT event_id, strftime(ts, '%Y') AS year, strftime(ts, '%Y-%m') AS month FROM events")
def _(a: Archive):
    return a.given("events").select("event_id", tf.year_label(F.col("ts")).alias("year"), tf.month_label(F.col("ts")).alias("month"))


@register("x3_weekday_and_hour", "SELECT event_id, dayofweek(ts) AS weekday, hour(ts) AS hour FROM events")
def _(a: Archive):
    return shape(a.given("events").select("event_id", tf.weekday(F.col("ts")).alias("weekday"), F.hour("ts").alias("hour")), event_id="n", weekday="n", hour="n")


@register("x4_second_boundaries", """
    SELECT event_id, date_diff('second', TIMESTAMP '2024-01-01', ts) AS since_start, date_diff('second', ts, ts + INTERVAL 900 MILLISECOND) AS next FROM events""")
def _(a: Archive):
    ts = F.col("ts")
    return a.given("events").select(
        "event_id", tf.seconds_between(F.lit("2024-01-01").cast("timestamp_ntz"), ts).alias("since_start"),
        tf.seconds_between(ts, ts + F.expr("INTERVAL 0.9 SECOND")).alias("next"))


@register("x5_days_before", f"SELECT DISTINCT user_id, strftime(DATE '{AS_OF[:10]}' - (user_id % 30)::INT, '%Y-%m-%d') AS day FROM events")
def _(a: Archive):
    day = F.date_sub(F.lit(AS_OF).cast("date"), F.pmod("user_id", F.lit(30)).cast("int"))
    return a.given("events").select("user_id", F.date_format(day, "yyyy-MM-dd").alias("day")).distinct()


@register("x6_clock", "SELECT event_id, strftime(ts, '%H:%M') AS clock FROM events")
def _(a: Archive):
    return a.given("events").select("event_id", F.date_format("ts", "HH:mm").alias("clock"))


@register("x7_split_words", f"""
    SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array({FOLDED}, '[^a-z'']+')) AS word FROM documents) GROUP BY 1""")
def _(a: Archive):
    return a.given("documents").select(F.explode(tx.split_words(F.col("text"))).alias("word")).groupBy("word").agg(n())


@register("x8_found_words", f"""
    SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all({FOLDED}, '[a-z'']+')) AS word FROM documents) GROUP BY 1""")
def _(a: Archive):
    return a.given("documents").select(F.explode(tx.found_words(F.col("text"))).alias("word")).groupBy("word").agg(n())


@register("x9_ngrams", f"""
    WITH w AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[a-z'']+') AS w FROM documents),
    g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM w
          UNION ALL SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w)
    SELECT gram, count(*) AS n FROM g GROUP BY 1""")
def _(a: Archive):
    grams = a.given("documents").select(F.explode(tx.ngrams(tx.found_words(F.col("text")))).alias("gram"))
    return grams.groupBy("gram").agg(n())


@register("x10_group_name_fallback", "SELECT chat_id, coalesce(nullif(name, ''), 'Group ' || chat_id) AS name FROM chats")
def _(a: Archive):
    return a.chats.select(F.col("chat_id").cast("bigint").alias("chat_id"), tx.group_name(F.col("name"), F.col("chat_id")).alias("name"))


@register("x11_text_functions", f"SELECT doc_id, length(trim(text)) AS len, {FOLDED} AS folded, left(text, 200) AS head FROM documents")
def _(a: Archive):
    text = F.col("text")
    rows = a.given("documents").select("doc_id", F.char_length(F.trim(text)).alias("len"), tx.fold(text).alias("folded"), F.left(text, F.lit(200)).alias("head"))
    return shape(rows, doc_id="n", len="n", folded="s", head="s")


@register("x12_cosine", f"""
    SELECT a.vec_id, {r('list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])', 'similarity')}
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(a: Archive):
    e = a.given("embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", r6(v.cosine(F.col("embedding"), F.col("other"))).alias("similarity"))


@register("x13_guarded_ratio", f"""
    SELECT user_id, {r("sum(value) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'purchase' AND value > 1), 0)", 'ratio')}
    FROM events GROUP BY 1""")
def _(a: Archive):
    bought = F.col("event_type") == "purchase"
    ratio = F.try_divide(F.sum(F.when(bought, F.col("value"))), F.count_if(bought & (F.col("value") > 1)))
    return a.given("events").groupBy("user_id").agg(r6(ratio).alias("ratio"))


@register("x14_content_hash", "SELECT doc_id, sha1(text) AS hash FROM documents")
def _(a: Archive):
    return a.given("documents").select("doc_id", F.sha1(F.encode(F.col("text"), "UTF-8")).alias("hash"))


@register("x15_json_round_trip", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS json FROM events")
def _(a: Archive):
    parsed = F.from_json("props", "k bigint")
    return a.given("events").select("event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("json"))
