"""Registry of named queries: Spark job + DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from kelasflow.plans.tables import tables_for
from kelasflow.sources.catalog import Tables
from kelasflow.sources.fixture_sql import with_fixtures


@dataclass
class Registered:
    name: str
    job: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.job(tables_for(spark, sf_dir))


REGISTRY: dict[str, Registered] = {}


def register(name: str, sql: str | None = None, ctes: str = ""):
    """Decorator: register ``job(tables) -> DataFrame`` under ``name`` with
    its oracle SELECT (fixture CTEs are prepended)."""
    def deco(fn):
        REGISTRY[name] = Registered(name, fn, with_fixtures(sql, ctes) if sql else None)
        return fn
    return deco


def register_twin(name: str, batch_twin: str):
    """Decorator: register a streaming job whose oracle is the SQL of an
    already registered batch job."""
    def deco(fn):
        REGISTRY[name] = Registered(name, fn, REGISTRY[batch_twin].sql)
        return fn
    return deco


def load_all() -> dict[str, Registered]:
    from kelasflow.plans import (reg_activity, reg_audit, reg_changes, reg_courses,  # noqa: F401
                                 reg_derived, reg_forum, reg_progress, reg_roster, reg_streams)
    return REGISTRY
