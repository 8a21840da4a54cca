"""Ranked summaries of the gold tables; keys break ties so that results repeat."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path
from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.sources.layers import row_counts, write_layer

MONTH_KEYS = ("usage_month", "campus_id", "source_system")


def top_monthly_usage(monthly: DataFrame, limit: int = 20) -> DataFrame:
    """Months with the highest consumption."""
    return monthly.orderBy(F.desc("total_consumption"), *MONTH_KEYS).limit(limit)


def peak_demand_by_meter(peaks: DataFrame, limit: int = 20) -> DataFrame:
    """Meters with the highest demand."""
    return peaks.orderBy(F.desc("peak_demand_kw"), "campus_id", "meter_id").limit(limit)


def monthly_emissions_summary(emissions: DataFrame, limit: int = 20) -> DataFrame:
    """Months with the highest emissions."""
    return (
        emissions.select(
            "campus_id", "source_system", "usage_month", "total_consumption",
            "emissions_factor_kg_co2e_per_kwh", "estimated_emissions_kg_co2e",
        )
        .orderBy(F.desc("estimated_emissions_kg_co2e"), *MONTH_KEYS)
        .limit(limit)
    )


def source_usage_summary(monthly: DataFrame) -> DataFrame:
    """Monthly rows, consumption and readings per source."""
    return (
        monthly.groupBy("source_system")
        .agg(
            F.count(F.lit(1)).alias("monthly_rows"),
            F.sum("total_consumption").alias("total_consumption"),
            F.sum("reading_count").alias("total_readings"),
        )
        .orderBy(F.desc("total_consumption"), "source_system")
    )


def run_sql_report(spark: SparkSession, file: Path, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Lazy result of one SQL file.

    A name in braces stands for the frame of that name in ``tables``, or else for the stored table of the
    layer it begins with (``{gold_peak_demand}``: ``gold.gold_peak_demand``). No view of the session is touched.
    """
    text = file.read_text(encoding="utf-8").strip().rstrip(";")
    names = {name for _, name, _, _ in Formatter().parse(text) if name}
    given = tables or {}
    frames = {n: given[n] if n in given else spark.table(f"{n.partition('_')[0]}.{n}") for n in names}
    return spark.sql(text, **frames)


def run_sql_reports(
    spark: SparkSession, query_dir: str | Path, tables: Mapping[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """File stem -> lazy result for every ``*.sql`` file of a folder, in name order."""
    reports = {file.stem: file for file in sorted(Path(query_dir).glob("*.sql"))}
    if not reports:
        raise FileNotFoundError(f"{query_dir} holds no report files (*.sql)")
    return {name: run_sql_report(spark, file, tables) for name, file in reports.items()}


def save_sql_reports(
    spark: SparkSession,
    query_dir: str | Path,
    layer: str = "report",
    root: str | None = None,
    tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Run the SQL files of a folder, store each result as ``layer.<stem>``, and count its rows."""
    stored = {
        (layer, name): write_layer(result, f"{layer}.{name}", root=root)
        for name, result in run_sql_reports(spark, query_dir, tables).items()
    }
    return row_counts(stored)
