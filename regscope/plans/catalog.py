"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their twins.

Every query reads the landed tables (through the derived ``packages`` table
or directly) and runs over them whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def register(name: str, twin: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if twin is not None:
            TWINS[name] = twin
        return fn
    return deco


def r6(c, alias=None):
    col = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return col.alias(alias or (c if isinstance(c, str) else None))




def _load():
    # Topic modules register themselves on import.
    from . import q_core, q_text, q_semantic, q_model, q_maint, q_archive, q_stream, q_registry  # noqa: F401


_load()
