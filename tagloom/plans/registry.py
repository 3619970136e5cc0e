"""Where queries register: a key of the operator inventory, the query, and its SQL over the adapter views if SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagloom.plans.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Views:
    """v.tag_position and so on: the adapter views; v.base(name): a table as it is."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(key: str, *views: str, sql: str | None = None) -> Callable:
    """Registers f(v) under key; sql may use the named views."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[key] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[key] = with_views(sql, *views) if views else sql
        return f

    return add
