"""All queries of the library and their SQL."""

from __future__ import annotations

from textloom.plans import answers, files, inputs, learning, metrics, processors, splits, streams, text

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _part in (text, splits, metrics, streams, processors, inputs, learning, files, answers):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
