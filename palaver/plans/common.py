"""Pieces shared by the person, owner and group plans."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.timefn import seconds_between
from ..operators.percentiles import exact_percentiles

def mine() -> Column:
    return F.col("is_from_me")

def sent_received() -> list[Column]:
    return [F.count_if(mine()).alias("sent"), F.count_if(~mine()).alias("received")]

def direct_contacts(chats: DataFrame, members: DataFrame) -> DataFrame:
    """(chat_id, person_id) of direct conversations."""
    return members.join(chats.where(~F.col("is_group")).select("chat_id"), "chat_id")

def reply_micros() -> Column:
    """Response time in whole microseconds, the integer form of ``response_seconds``."""
    return F.round(F.col("response_seconds") * 1e6).cast("long")

def reply_percentiles(rows: DataFrame, keys: list[str], probabilities: dict[str, float]) -> DataFrame:
    """Exact percentiles of my and their reply times as ``<name>_me`` and ``<name>_them``."""
    long = exact_percentiles(rows, [*keys, "is_from_me"], reply_micros(), probabilities, scale=1e6)
    return long.groupBy(*keys).agg(*[
        F.max(F.when(mine() == side, F.col(name))).alias(f"{name}_{who}")
        for name in probabilities for who, side in (("me", True), ("them", False))
    ])

def session_facts(messages: DataFrame) -> DataFrame:
    """One row per session: size, duration, who began and who ended it."""
    order = F.struct("ts_utc", "msg_id")
    return messages.groupBy("chat_id", "session_id").agg(
        F.count(F.lit(1)).alias("n"),
        seconds_between(F.min("ts_utc"), F.max("ts_utc")).alias("seconds"),
        F.min("ts_local").alias("t0"),
        F.min_by("is_from_me", order).alias("first_from_me"),
        F.max_by("is_from_me", order).alias("last_from_me"),
    )

def rate(flag: Column) -> Column:
    return F.avg(F.when(flag, 1.0).otherwise(0.0))

def block_facts(flow: DataFrame) -> DataFrame:
    """One row per reply block."""
    return flow.groupBy("chat_id", "block_no").agg(
        F.any_value("is_from_me").alias("is_from_me"), F.count(F.lit(1)).alias("n"), F.min("ts_local").alias("t0"))

def word_rows(messages: DataFrame, *keep: str) -> DataFrame:
    """One row per vocabulary word of the texts."""
    return (
        messages.where(F.col("text").isNotNull())
        .select(*keep, F.explode(tx.split_words(F.col("text"))).alias("word"))
        .where(tx.is_vocabulary(F.col("word")))
    )

def reaction_targets(tapbacks: DataFrame, messages: DataFrame) -> DataFrame:
    """Reactions with the message they point at: chat, author and side of the target."""
    target = messages.select(
        F.col("guid").alias("target_guid"), "chat_id", F.col("person_id").alias("target_person"),
        F.col("is_from_me").alias("target_mine"))
    return tapbacks.join(target, "target_guid")
