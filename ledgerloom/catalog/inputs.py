"""Bound tables as the queries use them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import fx
from ledgerloom.sources.bindings import AS_OF, bind

TODAY = dt.date.fromisoformat(AS_OF)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, sf_dir, "ledger")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, sf_dir, "categories")


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.resolve_conversion(ledger(spark, sf_dir), bind(spark, sf_dir, "fx_rates"))
