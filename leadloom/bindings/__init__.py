"""The operators bound to the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

from leadloom.bindings import cards, crawls, discovery, exchange, scores, states, streams, summaries, texts

_MODULES = [texts, cards, discovery, states, scores, summaries, exchange, streams, crawls]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
