"""Queries over the test tables that stand in for the application's data, each with its SQL where SQL can express it."""

from __future__ import annotations

from glossalake.plans import files, glossary, logs, matching, slides, tasks, texts

MODULES = (glossary, texts, logs, tasks, slides, matching, files)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
