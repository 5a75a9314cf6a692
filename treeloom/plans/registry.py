"""Named queries and their SQL oracles, gathered from the query families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeloom.plans import expressions, tables, texts, trees

FAMILIES = (tables, texts, expressions, trees)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expressions.category_mean_scr(spark, sf_dir)


def queries() -> dict:
    return {name: q for family in FAMILIES for name, q in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
