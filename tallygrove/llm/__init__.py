"""Operators for large training-data tables; nothing outside this subpackage imports it."""
