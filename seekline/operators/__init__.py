"""Seekline operators."""
