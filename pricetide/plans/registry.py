"""Registered queries: functions of a Domain, with the same rows as SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.session import ship
from pricetide.sources.domain import Domain

F_ROUND = "round({0}, 6) AS {0}"
queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
oracle: dict[str, str] = {}


def query(name: str, sql: str | None = None, rounded: str = "") -> Callable:
    """Register a function of a Domain under a name that begins with the operators it covers.

    Columns named in ``rounded`` are rounded to six places on both sides: engines interpolate and sum in other orders.
    """
    places = {c: F_ROUND.format(c) for c in rounded.split()}

    def put(f: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            df = f(Domain(spark, folder))
            return df.withColumns({c: F.round(c, 6) for c in places}) if places else df

        queries[name] = run
        if sql:
            oracle[name] = f"SELECT * REPLACE ({', '.join(places.values())}) FROM ({sql})" if places else sql
        return f

    return put
