"""All registered queries outside the optional training-data part, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import relational_queries, span_queries, version_queries
from lodestone.session import ship

FLAGSHIP = "agg_group"


def _ready(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _ready(f) for part in (relational_queries, span_queries, version_queries) for name, f in part.Q.items()}
ORACLES: dict[str, str] = {name: sql for part in (relational_queries, span_queries, version_queries) for name, sql in part.SQL.items()}
