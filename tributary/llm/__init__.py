"""Operators for training data, with their queries and SQL."""

from importlib import import_module

_MODULES = ["consensus", "sources", "overlap", "answers", "packing", "mixing", "spans"]
QUERIES: dict = {}
SQL: dict = {}
for _name in _MODULES:
    _module = import_module(f"{__name__}.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
