"""Reshaping for charts and lists: pivots, dense calendars, re-rankings, badges."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ordered import with_rank


def pivot_series(series: DataFrame, names: dict[int, str]) -> DataFrame:
    """Rows per bucket with one column per named person."""
    return series.groupBy("bucket").pivot("person_id", list(names)).agg(F.sum("total")).select(
        "bucket", *[F.col(str(i)).alias(n) for i, n in names.items()]).orderBy("bucket")


def dense_calendar(days: DataFrame) -> DataFrame:
    """Every day of every observed year with its count, week column (Sunday first) and weekday."""
    counts = days.select(F.col("date").cast("date").alias("day"), "count")
    years = counts.select(F.year("day").alias("year")).distinct()
    first = F.make_date("year", F.lit(1), F.lit(1))
    every = years.select("year", first.alias("first"), F.explode(F.sequence(first, F.make_date("year", F.lit(12), F.lit(31)))).alias("day"))
    weekday = F.dayofweek("day") - 1
    week = F.floor((F.dayofyear("day") - 1 + F.dayofweek("first") - 1) / 7)
    return every.join(counts, "day", "left").select(
        "year", F.date_format("day", "yyyy-MM-dd").alias("date"), week.alias("week"), weekday.alias("weekday"),
        F.coalesce("count", F.lit(0)).alias("count"))


def trailing_volume(series: DataFrame, window: int = 3) -> DataFrame:
    """Sum over the last observed buckets, missing ones counted as zero."""
    buckets = series.agg(F.array_sort(F.collect_set("bucket"))).scalar()
    people = series.select("person_id").distinct().withColumn("_b", buckets)
    dense = people.select("person_id", F.explode("_b").alias("bucket")).join(series, ["person_id", "bucket"], "left")
    w = Window.partitionBy("person_id").orderBy("bucket").rowsBetween(1 - window, 0)
    return dense.select("person_id", "bucket", F.sum(F.coalesce("count", F.lit(0))).over(w).alias("volume"))


def quiet_days(last_ts: Column, as_of: str) -> Column:
    seconds = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(last_ts.cast("timestamp"))
    return seconds / 86400.0


def rerank(people: DataFrame, metric: str, as_of: str, hide_quiet: bool = False, top: int | None = None,
           shown: int | None = None) -> DataFrame:
    """Contacts ordered by any metric, missing values last; ``rank`` numbers all of them, or the ``top`` busiest only.

    ``shown`` keeps the busiest contacts with the ranks they have among all.
    """
    rows = people.where(quiet_days(F.col("last_ts"), as_of) <= 30) if hide_quiet else people
    busy = [F.desc("total"), F.asc("person_id")]
    busiest = rows.orderBy(*busy).limit(top) if top else rows
    order = [F.desc_nulls_last(metric), F.asc("person_id")]
    ranked = with_rank(busiest.withColumn("_board", F.lit(0)), ["_board"], order, "rank").drop("_board")
    return ranked.orderBy(*busy).limit(shown) if shown else ranked


def badges(people: DataFrame, as_of: str) -> DataFrame:
    quiet = quiet_days(F.col("last_ts"), as_of)
    badge = F.when(F.col("streak_days") >= 3, "fire").when(quiet > 30, "moon").otherwise("")
    days = F.when(F.col("streak_days") >= 3, F.col("streak_days")).when(quiet > 30, F.floor(quiet)).otherwise(0)
    return people.select("person_id", badge.alias("badge"), days.alias("days"))


def rerank_groups(groups: DataFrame, metric: str) -> DataFrame:
    return groups.orderBy(F.desc(metric), "chat_id")


def scaled_ranking(voice: DataFrame, metric: str) -> DataFrame:
    """Voice metric scaled to 5..105 between its smallest and largest value."""
    low, high = voice.agg(F.min(metric)).scalar(), voice.agg(F.max(metric)).scalar()
    rows = voice.withColumns({"_low": low, "_high": high})
    span = F.greatest(F.lit(1e-9), F.col("_high") - F.col("_low"))
    return rows.withColumn("scaled", (F.col(metric) - F.col("_low")) / span * 100 + 5).drop("_low", "_high").orderBy(F.desc(metric))


def year_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Sessions per community and year; communities absent in a year have no row."""
    return docs.join(labels.where("cluster_id >= 0"), "id").groupBy(
        F.date_format("start_ts", "yyyy").alias("year"), "cluster_id").agg(F.count(F.lit(1)).alias("n"))


def inner_communities(fine: DataFrame, coarse: DataFrame, share: float = 0.5) -> DataFrame:
    """Fine communities with at least half their members inside a coarse one."""
    cells = fine.where("cluster_id >= 0").join(coarse.withColumnRenamed("cluster_id", "outer_id"), "id").groupBy(
        "cluster_id", "outer_id").agg(F.count(F.lit(1)).alias("inside"))
    total = cells.groupBy("cluster_id").agg(F.sum("inside").alias("total"))
    return cells.join(total, "cluster_id").where(F.col("inside") >= share * F.col("total"))


def parsed_transcript(rows: DataFrame, text: str = "snippet") -> DataFrame:
    """Flattened transcripts back to (sender, text) rows; a part without a sender continues the one before.

    A flattened transcript is clipped text, so its parts are few.
    """
    parts = rows.select("id", F.posexplode(F.split(F.col(text), " · ")).alias("pos", "part"))
    sender = F.regexp_extract("part", r"^([A-Za-z][\w.'\-]{0,20}): ", 1)
    parts = parts.withColumn("sender", sender).withColumn(
        "said", F.when(F.col("sender") != "", F.substr(F.col("part"), F.char_length("sender") + 3)).otherwise(F.col("part")))
    running = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("line", F.sum(F.when(F.col("sender") != "", 1).otherwise(0)).over(running)).where("line > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"]), " · ")
    return parts.groupBy("id", "line").agg(F.max("sender").alias("sender"), joined.alias("text")).where(F.trim("text") != "").withColumn(
        "is_from_me", F.col("sender") == "Me")


def dense_heatmap(cells: DataFrame) -> DataFrame:
    """All 7 x 24 cells per person with the count scaled to the person's largest cell."""
    grid = cells.select("person_id").distinct().select("person_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday")).select(
        "person_id", "weekday", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    top = F.greatest(F.max("count").over(Window.partitionBy("person_id")), F.lit(1))
    filled = grid.join(cells, ["person_id", "weekday", "hour"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return filled.withColumn("scale", F.col("count") / top)
