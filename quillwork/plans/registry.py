"""Named queries: how plan modules declare them and how they are gathered."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table

MODULES = ("compaction", "filters", "joins", "aggregates", "ranking", "statistics", "strings", "ingest", "similarity", "quality", "learning", "incremental")


def hash_sql(rows: str, line: str, more: str = "") -> str:
    """SQL for ``identity.content_hash`` of the lines of a table or sub-query; ``more`` adds columns."""
    return f"""WITH l AS (SELECT sha256({line}) AS h FROM {rows}), c AS (SELECT h, h || '*' || count(*) AS e, count(*) AS n FROM l GROUP BY h),
  b AS (SELECT ('0x' || substring(h, 1, 8))::BIGINT % 4096 AS b, sha256(string_agg(e, chr(10) ORDER BY e)) AS h, sum(n)::BIGINT AS n FROM c GROUP BY 1)
SELECT sha256(string_agg(b || ':' || h, chr(10) ORDER BY b || ':' || h)) AS content_hash, sum(n)::BIGINT AS n_lines{more} FROM b"""


class Tables:
    """The tables of a data directory, by name: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)


class Plan:
    """Collects a module's queries and their SQL."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def wrap(fn):
            @functools.wraps(fn)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return fn(Tables(spark, sf_dir))

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return fn

        return wrap


def gather(package: str, modules: tuple[str, ...]) -> tuple[dict, dict]:
    """The QUERIES and SQL of the named modules."""
    queries, sql = {}, {}
    for m in modules:
        mod = importlib.import_module(f"{package}.{m}")
        clash = queries.keys() & mod.QUERIES.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        queries |= mod.QUERIES
        sql |= mod.SQL
    return queries, sql


def core() -> tuple[dict, dict]:
    return gather("quillwork.plans", MODULES)
