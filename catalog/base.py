"""Archive built from the driver tables, and the query register."""
from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palaver.plans import ingest
from palaver.session import materialize, shared_dir
from palaver.sources.events import raw_archive, with_messages
from palaver.sources.raw import Tables, with_text

from .oracle import with_prelude

AS_OF = "2024-01-31 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Archive:
    """Star schema and derived tables of one folder, written once per application."""

    _known: dict[tuple[str, str], "Archive"] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> "Archive":
        key = (spark.sparkContext.applicationId, folder.rstrip("/"))
        if key not in cls._known:
            cls._known[key] = cls(spark, folder)
        return cls._known[key]

    def given(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    @cached_property
    def raw(self) -> Tables:
        """Raw tables; rows of messages and all of people land in the shared folder, texts are joined where they are read."""
        raw = raw_archive(self.spark, self.folder)
        raw |= {name: materialize(raw[name], name) for name in ("message_row", "handle", "contact", "contact_phone", "contact_email")}
        return raw | with_messages(raw["message_row"], raw["shared_text"])

    @cached_property
    def star(self) -> Tables:
        """The star schema; a table is written when a query first reads it."""
        return ingest.StarTables(self.raw, f"{shared_dir(self.spark)}/star-{uuid.uuid4().hex}")

    @property
    def said(self) -> DataFrame:
        """Messages with their texts."""
        return with_text(self.star)

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("persons", "handles", "chats", "chat_members", "messages", "tapbacks", "attachments", "emoji_uses", "word_uses"):
            return self.star[name]
        raise AttributeError(name)

    @cached_property
    def flow(self) -> DataFrame:
        return materialize(ingest.message_flow(self.messages), "flow")

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived table written once and shared by the queries that use it."""
        kept = self.__dict__.setdefault("_kept", {})
        if name not in kept:
            kept[name] = materialize(build(), name)
        return kept[name]


def register(name: str, sql: str | None = None):
    """Register a query ``f(archive)``; ``sql`` is its check, written over the prelude tables."""

    def add(fn: Callable[[Archive], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Archive.of(spark, folder))
        if sql is not None:
            ORACLES[name] = with_prelude(sql)
        return fn

    return add


def r6(c: Column | str) -> Column:
    """Double rounded to six digits, without negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def stamp(c: Column | str) -> Column:
    """Timestamp as text, so that both engines compare the same value."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def shape(df: DataFrame, **columns: str) -> DataFrame:
    """Select output columns by kind: n = bigint, d = double of six digits, r = reply
    seconds of nine digits (halves of a microsecond stay exact), s = as is, t = timestamp text."""
    kinds = {"r": lambda c: F.round(F.col(c), 9) + F.lit(0.0), "n": lambda c: F.col(c).cast("bigint"), "d": r6, "s": lambda c: F.col(c), "t": stamp,
             "b": lambda c: F.col(c).cast("boolean")}
    return df.select(*[kinds[k](c).alias(c) for c, k in columns.items()])
