"""Relational, statistical and screening operators."""
