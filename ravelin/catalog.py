"""Every query of the library by name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analytics, causal, diagnostics, equations, monitoring, network, profiles, reporting, shapes, spatial, stateful, utility

_MODULES = (reporting, monitoring, equations, spatial, shapes, network, analytics, causal, diagnostics, profiles, stateful, utility)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for m in _MODULES for k, q in m.SQL.items()}
