"""Keyed state: conversations and event streams."""
