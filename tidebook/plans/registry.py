"""Registry of runnable queries with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.clock import iso
from tidebook.plans.fixtures import oracle_text, view
from tidebook.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Views:
    """Fixture views of one data folder, by attribute: `v.v_order`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._views: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if not name.startswith("v_"):
            raise AttributeError(name)
        if name not in self._views:
            self._views[name] = view(self.spark, self.folder, name)
        return self._views[name]


def shown(rows: DataFrame) -> DataFrame:
    """Result columns in exchangeable types: ISO times, date texts, doubles for decimals."""
    columns = []
    for name, kind in rows.dtypes:
        c = F.col(name)
        if kind.startswith("decimal"):
            c = c.cast("double")
        elif kind.startswith("timestamp"):
            c = iso(c)
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        columns.append(c.alias(name))
    return rows.select(*columns)


def query(name: str, oracle: str | None = None):
    """Register `build(views) -> DataFrame` as a query."""
    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return shown(build(Views(prepare(spark), folder)))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle_text(oracle)
        return build

    return register


# Checking SQL pieces.
def iso_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%gZ')"
