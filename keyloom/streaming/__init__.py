"""Incremental forms on append-only logs (extensions)."""
