"""Keyed state and event-time operators."""
