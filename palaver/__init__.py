"""Conversation analytics as PySpark jobs: sources, functions, operators and plans."""
