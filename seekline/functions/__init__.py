"""Seekline functions."""
