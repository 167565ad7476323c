"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
import pkgutil

import fieldtrace.llm

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def load():
    for module in pkgutil.iter_modules(fieldtrace.llm.__path__):
        importlib.import_module(f"fieldtrace.llm.{module.name}")
    return dict(QUERIES), dict(ORACLES)
