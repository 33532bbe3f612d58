"""Operators of a training-data pipeline, each in a module of its own."""

from __future__ import annotations

from . import bpe, conversations, extract, filter_audit, neardup, packing, quality, secrets, sharding, token_store, topk, toxicity, warc

MODULES = (secrets, neardup, toxicity, warc, token_store, quality, sharding, bpe, packing, topk, filter_audit, extract, conversations)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
