"""Seekline sources."""
