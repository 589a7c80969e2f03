"""All queries over the driver's tables, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldbook.plans import activity, encoding, facets, imports, links, outreach, search, streams, text, workflow  # noqa: F401  each registers its queries
from fieldbook.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["search_ranked"](spark, sf_dir)
