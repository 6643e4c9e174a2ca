"""The query registry behind ``__spark_entry__``.

``register(name, sql=...)`` records a callable ``(spark, sf_dir) ->
DataFrame`` and, when SQL can express it, the DuckDB oracle text over the
driver's views.  Query modules are imported for their side effect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def to_boundary(df: DataFrame) -> DataFrame:
    """Decimals leave as doubles (the oracle compares doubles)."""
    cols = [F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return to_boundary(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _load():
    from . import q_accounts, q_metrics, q_models, q_people, q_profile  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
