"""Seekline streaming."""
