"""Seekline plans."""
