"""Registered queries over the driver tables, each with its check query for DuckDB."""
from . import ingest, persons, owner, groups, primitives, language, sessions, graph, quiz, client  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
