"""Typed readers and idempotent writers."""
