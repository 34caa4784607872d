"""Incremental updates."""
