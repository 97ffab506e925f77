"""All queries over the driver's tables with their SQL counterparts, gathered from the plan modules."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import plans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _, _name, _ in pkgutil.iter_modules(plans.__path__):
    _module = importlib.import_module(f"{plans.__name__}.{_name}")
    QUERIES |= getattr(_module, "QUERIES", {})
    ORACLES |= getattr(_module, "ORACLES", {})
