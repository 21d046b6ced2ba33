"""Operators for large-scale text preparation; nothing else in the library imports this subpackage."""
