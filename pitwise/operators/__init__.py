"""Operators: each takes and returns ``DataFrame``."""
