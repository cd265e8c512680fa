"""Registered queries: each pairs a Spark job over the driver tables with its reference SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import use_utc

MODULES = (
    "sources",
    "scalars",
    "joins",
    "sequences",
    "quality",
    "profiles",
    "panels",
    "windows",
    "inference",
    "resampling",
    "frames",
    "linear",
    "alerts",
    "composites",
)
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    """Result form shared with the SQL side: 6 decimals, zone-free timestamps."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, 6)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a query; without SQL it gets a rows-only check."""

    def add(fn):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(use_utc(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def load() -> tuple[dict, dict]:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return dict(_QUERIES), dict(_SQL)
