"""The queries of this subpackage and their SQL, as `__spark_entry__.py` registers them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("packing", "sharding", "language", "sentencepiece_codec", "neighbours", "simhash", "toxicity", "quality", "pii", "extraction", "spelling", "mining", "repeats")


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"siltstone.llm.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"siltstone.llm.{name}").ORACLE_SQL
    return found
