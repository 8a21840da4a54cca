"""Weather-normalised usage baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions import count_where, day_number, floor_to_hour, ratio, round_half_up
from gridmill.names import METER_KEYS

# Stored model label, candidate threshold, band width.
MODEL_VERSION = "grouped_median_weather_time_v1"
CANDIDATE_THRESHOLD = 0.25
BAND_WIDTH_C = 5


def hourly_weather(weather: DataFrame) -> DataFrame:
    """Average weather per campus and hour, over observations with an air temperature."""
    return (
        weather.where(F.col("air_temperature").isNotNull())
        .select(
            "campus_id",
            floor_to_hour(F.col("timestamp").cast("timestamp_ntz")).alias("usage_hour"),
            "air_temperature",
            "apparent_temperature",
            "relative_humidity",
        )
        .groupBy("campus_id", "usage_hour")
        .agg(
            *[
                F.avg(name).alias(name)
                for name in ("air_temperature", "apparent_temperature", "relative_humidity")
            ]
        )
    )


def weather_baseline(hourly: DataFrame, weather_by_hour: DataFrame) -> DataFrame:
    """Usage against the median of the same meter, hour, weekday, month and temperature band.

    The median is a window over those keys, so rows are shuffled once and need no join back to an
    aggregate. The window stays small for any data: hourly usage has one row per meter and hour, so
    a group holds at most five rows (equal weekdays of one month) per year of history, even if one
    meter owns most of the table.
    """
    weather = weather_by_hour.select(
        "campus_id", "usage_hour", "air_temperature", "apparent_temperature", "relative_humidity"
    )
    observed = (
        hourly.where(F.col("total_consumption") >= 0)
        .select(*METER_KEYS, "usage_hour", F.col("total_consumption").alias("actual_consumption"))
        .join(weather, ["campus_id", "usage_hour"])
        .withColumns(
            {
                "usage_date": F.col("usage_hour").cast("date"),
                "hour_of_day": F.hour("usage_hour"),
                "day_of_week": day_number("usage_hour"),
                "usage_month_number": F.month("usage_hour"),
                "temperature_band_c": F.floor(F.col("air_temperature") / BAND_WIDTH_C).cast("double")
                * BAND_WIDTH_C,
            }
        )
    )
    alike = Window.partitionBy(
        *METER_KEYS, "hour_of_day", "day_of_week", "usage_month_number", "temperature_band_c"
    )
    residual = F.col("actual_consumption") - F.col("expected_consumption")
    percent = F.col("residual_percent")
    above = F.col("residual_consumption") > 0
    return (
        observed.withColumn("expected_consumption", F.median("actual_consumption").over(alike))
        .withColumn("residual_consumption", residual)
        .withColumn("residual_percent", ratio(residual, F.col("expected_consumption")))
        .select(
            *METER_KEYS,
            "usage_hour",
            "usage_date",
            "actual_consumption",
            "expected_consumption",
            "residual_consumption",
            "residual_percent",
            "air_temperature",
            "apparent_temperature",
            "relative_humidity",
            "hour_of_day",
            "day_of_week",
            "usage_month_number",
            "temperature_band_c",
            F.lit(MODEL_VERSION).alias("baseline_model_version"),
            F.coalesce((percent >= CANDIDATE_THRESHOLD) & above, F.lit(False)).alias("is_high_usage_candidate"),
            F.when(percent.isNull() | ~above, 0.0)
            .otherwise(F.least(F.lit(100.0), round_half_up(percent * 100, 2)))
            .alias("efficiency_opportunity_score"),
        )
    )


def weather_baseline_stats(baseline: DataFrame) -> DataFrame:
    """Scored rows and high-usage candidates."""
    return baseline.agg(
        F.count(F.lit(1)).alias("row_count"),
        count_where(F.col("is_high_usage_candidate")).alias("high_usage_candidate_count"),
    )
