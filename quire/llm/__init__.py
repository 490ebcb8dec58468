"""Operators for preparing text corpora; nothing else in quire imports this package."""
