"""Operators for building training corpora; nothing else in gridloom imports this package."""
