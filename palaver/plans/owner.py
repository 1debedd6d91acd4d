"""Plans about the owner of the archive, and over all messages."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx, timefn as tf
from ..operators.topk import top_per_group
from ..sources.raw import Tables, with_text
from .common import block_facts, mine, sent_received


def overview_series(messages: DataFrame, unit: str = "month") -> DataFrame:
    return messages.groupBy(tf.bucket(unit, F.col("ts_local")).alias("bucket")).agg(*sent_received()).orderBy("bucket")


def totals(star: Tables) -> DataFrame:
    """Messages sent, mean length, emojis, and the split between groups and direct chats."""
    per_chat = star["messages"].where(mine()).groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("char_len").alias("chars"), F.sum("emoji_count").alias("emojis"))
    n = F.col("n")
    return per_chat.join(star["chats"].select("chat_id", "is_group"), "chat_id").agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("sent_total"), F.try_divide(F.sum("chars"), F.sum(n)).alias("avg_chars"),
        F.coalesce(F.sum("emojis"), F.lit(0)).alias("emoji_total"),
        F.coalesce(F.sum(F.when(F.col("is_group"), n)), F.lit(0)).alias("sent_in_groups"),
        F.coalesce(F.sum(F.when(~F.col("is_group"), n)), F.lit(0)).alias("sent_in_dms"))


def top_words(word_uses: DataFrame, k: int = 15) -> DataFrame:
    return word_uses.where(mine()).groupBy("word").agg(F.sum("count").alias("count")).orderBy(
        F.desc("count"), "word").limit(k)


def repeated_sentences(messages: DataFrame, min_chars: int = 8, min_count: int = 3, k: int = 10) -> DataFrame:
    text = F.trim("text")
    return (
        messages.where(mine() & (F.char_length(text) >= min_chars)).groupBy(text.alias("text"))
        .agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count)
        .orderBy(F.desc("count"), "text").limit(k)
    )


def top_emojis(star: Tables, k: int = 10) -> DataFrame:
    own = star["messages"].where(mine()).select("msg_id")
    return star["emoji_uses"].join(own, "msg_id", "left_semi").groupBy("emoji").agg(
        F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "emoji").limit(k)


def reactions_given(tapbacks: DataFrame) -> DataFrame:
    return tapbacks.where(mine()).groupBy("kind").agg(F.count(F.lit(1)).alias("count"))


def heatmap(messages: DataFrame) -> DataFrame:
    return messages.where(mine()).groupBy(
        tf.weekday(F.col("ts_local")).alias("weekday"), F.hour("ts_local").alias("hour")).agg(
        F.count(F.lit(1)).alias("count"))


def calendar(messages: DataFrame) -> DataFrame:
    """Messages sent per day."""
    return messages.where(mine()).groupBy(tf.bucket("day", F.col("ts_local")).alias("date")).agg(
        F.count(F.lit(1)).alias("count")).orderBy("date")


def busiest_day(messages: DataFrame) -> DataFrame:
    return calendar(messages).orderBy(F.desc("count"), "date").limit(1)


def reply_habits(flow: DataFrame) -> DataFrame:
    """Mean texts per reply and double texts of the owner over all conversations."""
    doubles = flow.agg(F.count_if((F.col("double_text") == 1) & mine()))
    return block_facts(flow).agg(
        F.avg(F.when(mine(), F.col("n"))).alias("avg_texts_per_reply")).withColumn("double_texts", doubles.scalar())


def word_context(messages: DataFrame, word: str, k: int = 5) -> DataFrame:
    """Most frequent own messages that contain a word."""
    return (
        messages.where(mine() & F.col("text").isNotNull() & tx.contains_word(F.col("text"), word))
        .groupBy(F.trim("text").alias("text")).agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "text").limit(k)
    )


def vernacular_timeline(word_uses: DataFrame, k: int = 8) -> DataFrame:
    counts = word_uses.where(mine()).groupBy("year", "word").agg(F.sum("count").alias("count"))
    return top_per_group(counts, ["year"], [F.desc("count"), F.asc("word")], k)


def catchphrase_timeline(messages: DataFrame, min_chars: int = 8, min_count: int = 2, k: int = 5) -> DataFrame:
    text = F.trim("text")
    counts = (
        messages.where(mine() & (F.char_length(text) >= min_chars))
        .groupBy(tf.year_label(F.col("ts_local")).alias("year"), text.alias("text"))
        .agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count)
    )
    return top_per_group(counts, ["year"], [F.desc("count"), F.asc("text")], k)


def hot_days(star: Tables, k: int = 10) -> DataFrame:
    """The busiest days with the contact who had most messages that day."""
    date = tf.bucket("day", F.col("ts_local")).alias("date")
    daily = star["messages"].groupBy(date, "person_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(mine()).alias("own"))
    days = daily.groupBy("date").agg(F.sum("n").alias("count"), F.sum("own").alias("sent")).orderBy(
        F.desc("count"), "date").limit(k)
    named = star["persons"].where(~F.col("display_name").like("urn:%"))
    tops = (
        daily.join(days.select("date"), "date", "left_semi").join(named, "person_id")
        .groupBy("date", "display_name").agg(F.sum("n").alias("n"))
    )
    first = top_per_group(tops, ["date"], [F.desc("n"), F.asc("display_name")], 1)
    return days.join(first.select("date", F.col("display_name").alias("top_contact")), "date", "left").orderBy(
        F.desc("count"), "date")


def day_transcripts(star: Tables, day: str | None = None, max_lines: int = 80, max_chats: int = 8,
                    max_chars: int = 16_000) -> DataFrame:
    """One transcript per day: the busiest conversations, each with a header and its first lines."""
    messages = with_text(star).where(F.col("text").isNotNull())
    if day:
        messages = messages.where(tf.on_day(F.col("ts_local"), day))
    rows = (
        messages.select(
            tf.bucket("day", F.col("ts_local")).alias("date"), "chat_id", "person_id", "ts_local", "msg_id",
            "is_from_me", F.left(F.col("text"), F.lit(200)).alias("said"))
        .join(star["chats"].select("chat_id", "is_group", "name"), "chat_id")
        .join(star["persons"].select("person_id", F.col("display_name").alias("sender")), "person_id", "left")
    )
    who = F.when(mine(), F.lit("You")).otherwise(F.coalesce("sender", F.lit("Someone")))
    order = F.struct("ts_local", "msg_id")
    chat_day = rows.groupBy("date", "chat_id").agg(
        F.least(F.count(F.lit(1)), F.lit(max_lines)).alias("shown"), F.min(order).alias("began"),
        F.any_value("is_group").alias("is_group"), F.any_value("name").alias("name"),
        F.max_by("sender", F.when(F.col("sender").isNotNull(), order)).alias("counterpart"))
    busiest = top_per_group(chat_day, ["date"], [F.desc("shown"), F.asc("began")], max_chats, "place")
    header = F.when(
        F.col("is_group"),
        F.concat(F.lit("— Group chat: "), F.coalesce(F.nullif("name", F.lit("")), F.lit("unnamed")), F.lit(" —")),
    ).otherwise(F.concat(F.lit("— Conversation with "), F.coalesce("counterpart", F.lit("unknown")), F.lit(" —")))
    line = F.concat(F.date_format("ts_local", "HH:mm"), F.lit(" "), who, F.lit(": "), F.col("said"))
    lines = top_per_group(
        rows.withColumn("line", line), ["date", "chat_id"], [F.asc("ts_local"), F.asc("msg_id")], max_lines)
    texts = lines.groupBy("date", "chat_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("body"))
    parts = busiest.join(texts, ["date", "chat_id"]).withColumn("part", F.concat(header, F.lit("\n"), F.col("body")))
    joined = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]), "\n\n")
    return parts.groupBy("date").agg(
        F.count(F.lit(1)).alias("chats"), F.left(joined, F.lit(max_chars)).alias("transcript"))
