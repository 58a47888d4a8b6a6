"""The registered core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seamline.plans import ball_queries, eval_queries, source_queries, text_queries
from seamline.session import read_table as t


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from seamline.operators.drift_sources import all_changes

    return all_changes(t(spark, d, "kaggle_commentary"), t(spark, d, "metrics"))


def p3_commentary(spark: SparkSession, d: str) -> DataFrame:
    from seamline.operators.drift_sources import unified_commentary

    return unified_commentary(t(spark, d, "kaggle_commentary"))


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    from seamline.operators.drift_sources import unified_runs

    return unified_runs(t(spark, d, "metrics"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from seamline.sources.commentary_lines import rejects

    return rejects(t(spark, d, "kaggle_commentary"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p3_commentary": p3_commentary,
    "p3_runs": p3_runs,
    "p4_found": p4_found,
    **ball_queries.QUERIES,
    **text_queries.QUERIES,
    **eval_queries.QUERIES,
    **source_queries.QUERIES,
}
ORACLE: dict[str, str] = {**ball_queries.ORACLE, **text_queries.ORACLE, **eval_queries.ORACLE, **source_queries.ORACLE}
