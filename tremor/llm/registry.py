"""Queries of the subpackage and their SQL; each operator module registers its own."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

MODULES = ("bpe", "embed_dedup", "mixing", "packing", "url_tree", "lm", "topk", "repeats", "langid", "simhash", "phrases", "hard_negatives", "secrets")


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def load_all() -> tuple[dict, dict]:
    for m in MODULES:
        import_module(f"tremor.llm.{m}")
    return QUERIES, ORACLES
