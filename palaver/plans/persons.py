"""Plans per contact, for all contacts at once.

Facts are summed per conversation first and only then matched with the contacts of the
conversation, so a hot conversation shrinks map-side before anything is shuffled.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import timefn as tf
from ..operators.topk import top_per_group
from ..sources.raw import Tables, with_text
from .common import (
    block_facts, direct_contacts, mine, rate, reaction_targets, reply_percentiles, sent_received,
    session_facts,
)

def known_name() -> Column:
    return ~F.col("display_name").like("urn:%")


def contacts_of(star: Tables) -> DataFrame:
    return direct_contacts(star["chats"], star["chat_members"])


def direct_messages(star: Tables, messages: DataFrame | None = None) -> DataFrame:
    """Messages of direct conversations with the contact of each."""
    rows = star["messages"] if messages is None else messages
    return rows.join(contacts_of(star).withColumnRenamed("person_id", "contact_id"), "chat_id")


def reply_rows(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("response_seconds").isNotNull()).select("chat_id", "is_from_me", "response_seconds")


def volumes(messages: DataFrame, contacts: DataFrame) -> DataFrame:
    per_chat = messages.groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("total"), *sent_received(),
        F.min("ts_local").alias("first_ts"), F.max("ts_local").alias("last_ts"))
    return per_chat.join(contacts, "chat_id").groupBy("person_id").agg(
        F.sum("total").alias("total"), F.sum("sent").alias("sent"), F.sum("received").alias("received"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def session_metrics(messages: DataFrame, contacts: DataFrame) -> DataFrame:
    """Initiation, size, duration and unanswered endings of sessions."""
    return session_facts(messages).join(contacts, "chat_id").groupBy("person_id").agg(
        rate(F.col("first_from_me")).alias("initiation_rate_me"),
        F.avg("n").alias("avg_session_messages"),
        F.avg("seconds").alias("avg_session_seconds"),
        F.count_if("last_from_me").alias("ghosts_by_them"),
        F.count_if(~F.col("last_from_me")).alias("ghosts_by_me"),
        F.count(F.lit(1)).alias("sessions"))


def block_metrics(flow: DataFrame, contacts: DataFrame) -> DataFrame:
    """Mean reply-block size and double texts of both sides."""
    blocks = block_facts(flow).join(contacts, "chat_id").groupBy("person_id").agg(
        F.avg(F.when(mine(), F.col("n"))).alias("avg_reply_block_me"),
        F.avg(F.when(~mine(), F.col("n"))).alias("avg_reply_block_them"))
    doubles = flow.groupBy("chat_id").agg(
        F.count_if((F.col("double_text") == 1) & mine()).alias("me"),
        F.count_if((F.col("double_text") == 1) & ~mine()).alias("them"))
    doubles = doubles.join(contacts, "chat_id").groupBy("person_id").agg(
        F.sum("me").alias("double_texts_me"), F.sum("them").alias("double_texts_them"))
    return blocks.join(doubles, "person_id")


def streaks(messages: DataFrame, contacts: DataFrame, as_of: str) -> DataFrame:
    """Consecutive days up to the last active day, alive if that day is yesterday or later."""
    days = (
        messages.select("chat_id", F.to_date("ts_local").alias("day")).distinct()
        .join(contacts, "chat_id").select("person_id", "day").distinct()
    )
    backwards = Window.partitionBy("person_id").orderBy(F.desc("day"))
    whole = Window.partitionBy("person_id")
    return (
        days.withColumn("last_day", F.max("day").over(whole))
        .withColumn("age", F.row_number().over(backwards) - 1)
        .where((F.col("day") == F.date_sub("last_day", F.col("age")))
               & (F.col("last_day") >= F.date_sub(F.lit(as_of).cast("date"), 1)))
        .groupBy("person_id").agg(F.count(F.lit(1)).alias("streak_days"))
    )


def leaderboard(star: Tables, flow: DataFrame, as_of: str, days: int | None = None) -> DataFrame:
    """The contact leaderboard. With ``days`` pass the flow of the same window of messages."""
    contacts = contacts_of(star)
    messages = star["messages"].where(tf.since(F.col("ts_local"), as_of, days))
    replies = reply_rows(messages).join(contacts, "chat_id")
    medians = reply_percentiles(replies, ["person_id"], {"median_response_seconds": 0.5})
    return (
        star["persons"].where(known_name())
        .join(volumes(messages, contacts), "person_id")
        .join(session_metrics(messages, contacts), "person_id")
        .join(block_metrics(flow, contacts), "person_id")
        .join(medians, "person_id", "left")
        .join(streaks(messages, contacts, as_of), "person_id", "left")
        .withColumn("streak_days", F.coalesce("streak_days", F.lit(0)))
        .select(
            "person_id", "display_name", "total", "sent", "received", "first_ts", "last_ts",
            "median_response_seconds_me", "median_response_seconds_them", "initiation_rate_me",
            "avg_session_messages", "avg_session_seconds", "ghosts_by_them", "ghosts_by_me",
            "avg_reply_block_me", "avg_reply_block_them", "double_texts_me", "double_texts_them", "streak_days")
        .orderBy(F.desc("total"), "person_id")
    )


def monthly_timeline(star: Tables, top: int = 40) -> DataFrame:
    """Messages per month of the busiest contacts; the limit comes before the name filter."""
    per_month = (
        star["messages"].groupBy("chat_id", tf.month_label(F.col("ts_local")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
        .join(contacts_of(star), "chat_id")
        .groupBy("person_id", "bucket").agg(F.sum("n").alias("count"))
    )
    best = per_month.groupBy("person_id").agg(F.sum("count").alias("total")).orderBy(
        F.desc("total"), "person_id").limit(top)
    return (
        per_month.join(best.select("person_id"), "person_id", "left_semi")
        .join(star["persons"].where(known_name()), "person_id")
        .select("bucket", "person_id", "display_name", "count")
        .orderBy("bucket", F.desc("count"), "person_id")
    )


def time_series(star: Tables, unit: str = "week", include_groups: bool = False) -> DataFrame:
    """Sent and received per bucket and person; optionally with the person's own group messages."""
    bucket = tf.bucket(unit, F.col("ts_local")).alias("bucket")
    direct = (
        star["messages"].groupBy("chat_id", bucket).agg(*sent_received())
        .join(contacts_of(star), "chat_id").select("person_id", "bucket", "sent", "received")
    )
    if include_groups:
        member = star["chat_members"].join(star["chats"].where("is_group").select("chat_id"), "chat_id")
        own = (
            star["messages"].where(F.col("person_id").isNotNull())
            .groupBy("chat_id", "person_id", bucket).agg(*sent_received())
            .join(member, ["chat_id", "person_id"], "left_semi")
            .select("person_id", "bucket", "sent", "received")
        )
        direct = direct.unionByName(own)
    return direct.groupBy("person_id", "bucket").agg(
        F.sum("sent").alias("sent"), F.sum("received").alias("received")).orderBy("person_id", "bucket")


def person_stats(star: Tables, flow: DataFrame) -> DataFrame:
    """Counts, reply percentiles, mean length, sessions, blocks and block ratio per person."""
    contacts = contacts_of(star)
    messages = star["messages"]
    lengths = messages.groupBy("chat_id").agg(
        F.count_if(mine()).alias("n_me"), F.count_if(~mine()).alias("n_them"),
        F.sum(F.when(mine(), F.col("char_len"))).alias("c_me"),
        F.sum(F.when(~mine(), F.col("char_len"))).alias("c_them"))
    core = lengths.join(contacts, "chat_id").groupBy("person_id").agg(
        F.sum("n_me").alias("sent"), F.sum("n_them").alias("received"),
        (F.sum("n_me") + F.sum("n_them")).alias("total"),
        F.try_divide(F.sum("c_me"), F.sum("n_me")).alias("avg_chars_me"),
        F.try_divide(F.sum("c_them"), F.sum("n_them")).alias("avg_chars_them"))
    replies = reply_rows(messages).join(contacts, "chat_id")
    tails = reply_percentiles(replies, ["person_id"], {"median_response_seconds": 0.5, "p90_response_seconds": 0.9})
    return (
        star["persons"].join(core, "person_id").join(session_metrics(messages, contacts), "person_id")
        .join(block_metrics(flow, contacts), "person_id").join(tails, "person_id", "left")
        .withColumn("reply_block_ratio", F.try_divide("avg_reply_block_them", "avg_reply_block_me"))
        .drop("source")
    )


def top_words(star: Tables, k: int = 10) -> DataFrame:
    """Most used words per person and side."""
    uses = star["word_uses"].select("chat_id", "is_from_me", "word", "count")
    counts = uses.join(contacts_of(star), "chat_id").groupBy("person_id", "is_from_me", "word").agg(F.sum("count").alias("count"))
    return top_per_group(counts, ["person_id", "is_from_me"], [F.desc("count"), F.asc("word")], k)


def top_emojis(star: Tables, k: int = 10) -> DataFrame:
    used = star["emoji_uses"].join(star["messages"].select("msg_id", "chat_id", "is_from_me"), "msg_id")
    counts = used.groupBy("chat_id", "is_from_me", "emoji").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(contacts_of(star), "chat_id").groupBy("person_id", "is_from_me", "emoji").agg(
        F.sum("n").alias("count"))
    return top_per_group(counts, ["person_id", "is_from_me"], [F.desc("count"), F.asc("emoji")], k)


def reactions_by_kind(star: Tables) -> DataFrame:
    """Reactions of a person anywhere, and mine to that person's messages."""
    theirs = star["tapbacks"].where(F.col("person_id").isNotNull()).groupBy("person_id", "kind").agg(
        F.count(F.lit(1)).alias("count")).withColumn("direction", F.lit("from_them"))
    targets = reaction_targets(star["tapbacks"].where("is_from_me").select("target_guid", "kind"), star["messages"])
    from_me = (
        targets.where(~F.col("target_mine") & F.col("target_person").isNotNull())
        .groupBy(F.col("target_person").alias("person_id"), "kind")
        .agg(F.count(F.lit(1)).alias("count")).withColumn("direction", F.lit("from_me"))
    )
    return theirs.unionByName(from_me)


def trends(star: Tables, flow: DataFrame, unit: str = "month") -> DataFrame:
    """Per person and bucket: volume, smoothed reply medians, texts per reply, double texts, initiation."""
    contacts = contacts_of(star)
    keys = ["person_id", "bucket"]
    direct = star["messages"].join(contacts.withColumnRenamed("person_id", "contact"), "chat_id").select(
        F.col("contact").alias("person_id"), tf.bucket(unit, F.col("ts_local")).alias("bucket"),
        "is_from_me", "response_seconds")
    volume = direct.groupBy(*keys).agg(*sent_received())
    medians = reply_percentiles(direct.where(F.col("response_seconds").isNotNull()), keys, {"median": 0.5})
    trailing = Window.partitionBy("person_id").orderBy("bucket").rowsBetween(-3, 0)
    base = volume.join(medians, keys, "left").select(
        *keys, "sent", "received",
        F.avg("median_me").over(trailing).alias("median_reply_me"),
        F.avg("median_them").over(trailing).alias("median_reply_them"))

    blocks = block_facts(flow).join(contacts, "chat_id").groupBy(
        "person_id", tf.bucket(unit, F.col("t0")).alias("bucket")).agg(
        F.avg(F.when(mine(), F.col("n"))).alias("texts_per_reply_me"),
        F.avg(F.when(~mine(), F.col("n"))).alias("texts_per_reply_them"))
    doubles = flow.groupBy("chat_id", tf.bucket(unit, F.col("ts_local")).alias("bucket")).agg(
        F.count_if((F.col("double_text") == 1) & mine()).alias("me"),
        F.count_if((F.col("double_text") == 1) & ~mine()).alias("them"))
    doubles = doubles.join(contacts, "chat_id").groupBy(*keys).agg(
        F.sum("me").alias("double_texts_me"), F.sum("them").alias("double_texts_them"))
    starts = session_facts(star["messages"]).join(contacts, "chat_id").groupBy(
        "person_id", tf.bucket(unit, F.col("t0")).alias("bucket")).agg(
        rate(F.col("first_from_me")).alias("initiation_me"))
    zero = F.lit(0)
    return (
        base.join(blocks.join(doubles, keys, "full"), keys, "full").join(starts, keys, "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("sent", "received", "double_texts_me", "double_texts_them")})
        .orderBy(*keys)
    )


def hot_days(star: Tables, k: int = 8) -> DataFrame:
    """The busiest days of each person."""
    per_day = star["messages"].groupBy("chat_id", tf.bucket("day", F.col("ts_local")).alias("date")).agg(*sent_received())
    per_day = per_day.join(contacts_of(star), "chat_id").groupBy("person_id", "date").agg(
        F.sum("sent").alias("sent"), F.sum("received").alias("received")).withColumn(
        "count", F.col("sent") + F.col("received"))
    return top_per_group(per_day, ["person_id"], [F.desc("count"), F.asc("date")], k)


def heatmap(star: Tables) -> DataFrame:
    cells = star["messages"].groupBy(
        "chat_id", tf.weekday(F.col("ts_local")).alias("weekday"), F.hour("ts_local").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"))
    return cells.join(contacts_of(star), "chat_id").groupBy("person_id", "weekday", "hour").agg(
        F.sum("n").alias("count"))


def compare(star: Tables, ids: list[int], unit: str = "month") -> DataFrame:
    """Volume series of several persons side by side."""
    chosen = contacts_of(star).where(F.col("person_id").isin(*ids))
    series = star["messages"].groupBy("chat_id", tf.bucket(unit, F.col("ts_local")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))
    return (
        series.join(chosen, "chat_id").groupBy("person_id", "bucket").agg(F.sum("n").alias("total"))
        .join(star["persons"].select("person_id", "display_name"), "person_id")
    )


def day_transcripts(star: Tables, day: str | None = None, max_lines: int = 400, max_chars: int = 12_000) -> DataFrame:
    """One transcript per person and day: the first lines of the day, clipped in length.

    The line limit is applied before rows meet, so a transcript is gathered from at most
    ``max_lines`` clipped lines.
    """
    messages = with_text(star).where(F.col("text").isNotNull())
    if day:
        messages = messages.where(tf.on_day(F.col("ts_local"), day))
    lines = direct_messages(star, messages).select(
        F.col("contact_id").alias("person_id"), tf.bucket("day", F.col("ts_local")).alias("date"),
        "ts_local", "msg_id", "is_from_me", F.left(F.col("text"), F.lit(200)).alias("said"))
    lines = top_per_group(lines, ["person_id", "date"], [F.asc("ts_local"), F.asc("msg_id")], max_lines)
    who = F.when(mine(), F.lit("You")).otherwise(F.col("display_name"))
    line = F.concat(F.date_format("ts_local", "HH:mm"), F.lit(" "), who, F.lit(": "), F.col("said"))
    named = lines.join(star["persons"].select("person_id", "display_name"), "person_id").withColumn("line", line)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    return named.groupBy("person_id", "date").agg(
        F.count(F.lit(1)).alias("lines"), F.left(F.array_join(ordered, "\n"), F.lit(max_chars)).alias("transcript"))
