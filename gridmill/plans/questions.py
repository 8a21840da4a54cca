"""Fixed metric questions, each a named query on the layer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.functions import count_where
from gridmill.plans.marts import MONTH_KEYS


def table_row_count(table: DataFrame) -> DataFrame:
    """How many rows does a table have?"""
    return table.agg(F.count(F.lit(1)).alias("row_count"))


def top_peak_demand(peaks: DataFrame) -> DataFrame:
    """Which meters have the highest peak demand?"""
    return (
        peaks.select("campus_id", "meter_id", "peak_timestamp", "peak_demand_kw", "peak_demand_kva")
        .orderBy(F.desc("peak_demand_kw"), "campus_id", "meter_id")
        .limit(10)
    )


def top_monthly_usage(monthly: DataFrame) -> DataFrame:
    """Which months have the highest usage?"""
    return (
        monthly.select("campus_id", "source_system", "usage_month", "total_consumption")
        .orderBy(F.desc("total_consumption"), *MONTH_KEYS)
        .limit(10)
    )


def top_high_usage(baseline: DataFrame) -> DataFrame:
    """Which hours stand out most against the baseline?"""
    return (
        baseline.where("is_high_usage_candidate")
        .select(
            "campus_id", "source_system", "meter_id", "building_id", "usage_hour", "actual_consumption",
            "expected_consumption", "residual_consumption", "efficiency_opportunity_score",
        )
        .orderBy(
            F.desc("efficiency_opportunity_score"), F.desc("residual_consumption"),
            "campus_id", "source_system", "meter_id", F.asc_nulls_last("building_id"), "usage_hour",
        )
        .limit(10)
    )


def events_meeting_target(responses: DataFrame) -> DataFrame:
    """How many simulated events met their target?"""
    return responses.agg(
        F.count(F.lit(1)).alias("simulated_events"),
        count_where(F.col("target_met")).alias("events_meeting_target"),
    )


def rows_per_match_status(time_varying: DataFrame) -> DataFrame:
    """How many hours matched an hourly factor, fell back, or found none?"""
    return (
        time_varying.groupBy("factor_match_status")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .orderBy("factor_match_status")
    )


# Question name -> (query, table it reads); the row-count question takes any table.
QUESTIONS = {
    "table_row_count": (table_row_count, None),
    "top_peak_demand": (top_peak_demand, "gold.gold_peak_demand"),
    "top_monthly_usage": (top_monthly_usage, "gold.gold_monthly_electricity_usage"),
    "top_high_usage": (top_high_usage, "gold.gold_weather_normalized_usage"),
    "events_meeting_target": (events_meeting_target, "gold.gold_demand_response_simulation"),
    "rows_per_match_status": (rows_per_match_status, "gold.gold_hourly_time_varying_emissions"),
}
