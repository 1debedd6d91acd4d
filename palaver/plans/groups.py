"""Plans per group conversation and member, for all groups at once.

Member 0 is the owner; the owner's rows in groups carry no person.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx, timefn as tf
from ..operators.topk import top_per_group
from ..sources.raw import Tables
from .common import mine, reaction_targets

OWNER = 0


def member_of(flag: Column, person: Column) -> Column:
    return F.when(flag, OWNER).otherwise(person)


def groups(star: Tables) -> DataFrame:
    return star["chats"].where("is_group").select(
        "chat_id", tx.group_name(F.col("name"), F.col("chat_id")).alias("name"), "participant_count")


def group_messages(star: Tables) -> DataFrame:
    """Group messages with the member who wrote them."""
    return star["messages"].join(groups(star).select("chat_id"), "chat_id").withColumn(
        "member_id", member_of(mine(), F.col("person_id")))


def members(star: Tables) -> DataFrame:
    """Members of each group and the owner, with names."""
    people = star["chat_members"].join(star["persons"], "person_id").select(
        "chat_id", F.col("person_id").alias("member_id"), "display_name")
    ids = groups(star).select("chat_id")
    owner = ids.withColumns({"member_id": F.lit(OWNER), "display_name": F.lit("You")})
    return people.join(ids, "chat_id", "left_semi").unionByName(owner)


def leaderboard(star: Tables, as_of: str, days: int | None = None) -> DataFrame:
    rows = star["messages"].where(tf.since(F.col("ts_local"), as_of, days))
    totals = rows.groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("total"), F.avg(F.when(mine(), 1.0).otherwise(0.0)).alias("my_share"),
        F.min("ts_local").alias("first_ts"), F.max("ts_local").alias("last_ts"))
    return totals.join(groups(star), "chat_id").select(
        "chat_id", "name", F.col("participant_count").alias("participants"), "total", "my_share", "first_ts",
        "last_ts").orderBy(F.desc("total"), "chat_id")


def time_series(star: Tables, unit: str = "week") -> DataFrame:
    series = star["messages"].groupBy("chat_id", tf.bucket(unit, F.col("ts_local")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(mine()).alias("mine"))
    return series.join(groups(star).select("chat_id"), "chat_id", "left_semi")


def heatmap(star: Tables) -> DataFrame:
    cells = star["messages"].groupBy(
        "chat_id", tf.weekday(F.col("ts_local")).alias("weekday"), F.hour("ts_local").alias("hour")).agg(
        F.count(F.lit(1)).alias("count"))
    return cells.join(groups(star).select("chat_id"), "chat_id", "left_semi")


def member_stats(star: Tables) -> DataFrame:
    """Share, length and session behaviour of every member, silent ones included."""
    rows = group_messages(star)
    keys = ["chat_id", "member_id"]
    core = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.avg("char_len").alias("avg_chars"),
        F.count_distinct("session_id").alias("sessions_participated"))
    whole = rows.groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("session_id").alias("sessions_total"))
    ended = (
        rows.groupBy("chat_id", "session_id").agg(F.max_by("member_id", F.struct("ts_utc", "msg_id")).alias("member_id"))
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("sessions_ended"))
    )
    zero = F.lit(0)
    return (
        members(star).join(whole, "chat_id", "left").join(core, keys, "left").join(ended, keys, "left")
        .withColumns({c: F.coalesce(c, zero) for c in (
            "count", "total", "sessions_total", "sessions_participated", "sessions_ended")})
        .withColumn("share", F.coalesce(F.try_divide("count", "total"), F.lit(0.0)))
        .withColumn("sessions_ghosted", F.col("sessions_total") - F.col("sessions_participated"))
        .drop("total")
    )


def member_words(star: Tables, k: int = 10) -> DataFrame:
    uses = star["word_uses"].join(groups(star).select("chat_id"), "chat_id", "left_semi")
    counts = uses.groupBy("chat_id", member_of(mine(), F.col("person_id")).alias("member_id"), "word").agg(F.sum("count").alias("count"))
    return top_per_group(counts, ["chat_id", "member_id"], [F.desc("count"), F.asc("word")], k)


def member_emojis(star: Tables, k: int = 5) -> DataFrame:
    rows = group_messages(star).select("msg_id", "chat_id", "member_id")
    counts = star["emoji_uses"].join(rows, "msg_id").groupBy("chat_id", "member_id", "emoji").agg(
        F.count(F.lit(1)).alias("count"))
    return top_per_group(counts, ["chat_id", "member_id"], [F.desc("count"), F.asc("emoji")], k)


def member_reactions(star: Tables) -> DataFrame:
    """Reactions given by kind, and received in total (kind 'received'), per group member."""
    actors = star["tapbacks"].withColumn("actor", member_of(mine(), F.col("person_id"))).select(
        "target_guid", "actor", "kind")
    targets = reaction_targets(actors, star["messages"]).join(groups(star).select("chat_id"), "chat_id", "left_semi")
    given = targets.groupBy("chat_id", F.col("actor").alias("member_id"), "kind").agg(F.count(F.lit(1)).alias("count"))
    received = targets.groupBy(
        "chat_id", member_of(F.col("target_mine"), F.col("target_person")).alias("member_id")).agg(
        F.count(F.lit(1)).alias("count")).withColumn("kind", F.lit("received"))
    both = given.withColumn("direction", F.lit("given")).unionByName(received.withColumn("direction", F.lit("received")))
    return both.join(members(star).select("chat_id", "member_id"), ["chat_id", "member_id"], "left_semi")


def member_series(star: Tables, unit: str = "week") -> DataFrame:
    return group_messages(star).where(F.col("member_id").isNotNull()).groupBy(
        "chat_id", "member_id", tf.bucket(unit, F.col("ts_local")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("count"))


def stats(star: Tables) -> DataFrame:
    """One row per group and author: share of voice, reactions received, and the group's totals."""
    rows = group_messages(star)
    voices = rows.groupBy("chat_id", "member_id").agg(
        F.count(F.lit(1)).alias("count"), F.avg("char_len").alias("avg_chars"))
    names = star["persons"].select(F.col("person_id").alias("member_id"), "display_name")
    others = voices.where(F.col("member_id") != OWNER).join(names, "member_id").select(
        "chat_id", F.col("member_id").alias("person_id"), "display_name", "count", "avg_chars", "member_id")
    owner = voices.where(F.col("member_id") == OWNER).select(
        "chat_id", F.lit(None).cast("int").alias("person_id"), F.lit("You").alias("display_name"), "count",
        "avg_chars", "member_id")
    received = reaction_targets(star["tapbacks"].select("target_guid"), star["messages"]).groupBy(
        "chat_id", F.coalesce("target_person", F.lit(OWNER)).alias("member_id")).agg(
        F.count(F.lit(1)).alias("tapbacks_received"))
    whole = rows.groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("total"), F.avg(F.when(mine(), 1.0).otherwise(0.0)).alias("my_share"),
        F.count_distinct("session_id").alias("session_count"))
    daily = rows.groupBy("chat_id", tf.bucket("day", F.col("ts_local")).alias("busiest_date")).agg(
        F.count(F.lit(1)).alias("busiest_count"))
    busiest = top_per_group(daily, ["chat_id"], [F.desc("busiest_count"), F.asc("busiest_date")], 1).drop("rank")
    return (
        others.unionByName(owner)
        .join(received, ["chat_id", "member_id"], "left").drop("member_id")
        .join(whole, "chat_id").join(busiest, "chat_id").join(groups(star).select("chat_id", "name"), "chat_id")
        .withColumn("share", F.col("count") / F.col("total"))
        .withColumn("tapbacks_received", F.coalesce("tapbacks_received", F.lit(0)))
        .drop("total")
    )
