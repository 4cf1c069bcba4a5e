"""Every query of the library outside llm, by name, with its SQL."""

import importlib

BOOKS = ["scans", "pairs", "stats", "windows", "network", "served", "risk", "streams"]

QUERIES: dict = {}
SQL: dict = {}
for _name in BOOKS:
    _book = importlib.import_module(f"lagweave.plans.{_name}").book
    QUERIES |= _book.queries
    SQL |= _book.sql
