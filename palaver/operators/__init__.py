"""Skew-safe DataFrame operators shared by the plans."""
