"""Relational operators over canonical node/edge tables and pattern tables."""
