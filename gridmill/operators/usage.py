"""Gold usage roll-ups and peak demand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.functions import floor_to_hour, month_start
from gridmill.names import METER_KEYS


def hourly_usage(building: DataFrame, nmi: DataFrame, submeter: DataFrame) -> DataFrame:
    """Consumption per meter and hour over the three silver sources (one row per meter and hour)."""
    sources = [
        source.select(
            "campus_id",
            "source_system",
            "meter_id",
            (F.col("building_id") if "building_id" in source.columns else F.lit(None).cast("long")).alias(
                "building_id"
            ),
            "reading_timestamp",
            floor_to_hour("reading_timestamp").alias("usage_hour"),
            "consumption",
        )
        for source in (building, nmi, submeter)
    ]
    return (
        reduce(DataFrame.unionByName, sources)
        .groupBy(*METER_KEYS, "usage_hour")
        .agg(
            F.sum("consumption").alias("total_consumption"),
            F.count(F.lit(1)).alias("reading_count"),
            F.min("reading_timestamp").alias("first_reading_timestamp"),
            F.max("reading_timestamp").alias("last_reading_timestamp"),
        )
    )


def daily_usage(hourly: DataFrame) -> DataFrame:
    """Usage per campus, source and day with the number of distinct meters.

    Meters are first folded within (campus, source, day, meter); the distinct count is then a plain
    count of non-NULL meters and every step combines on the map side.
    """
    per_meter = (
        hourly.withColumn("usage_date", F.col("usage_hour").cast("date"))
        .groupBy("campus_id", "source_system", "usage_date", "meter_id")
        .agg(F.sum("total_consumption").alias("total_consumption"), F.sum("reading_count").alias("reading_count"))
    )
    return per_meter.groupBy("campus_id", "source_system", "usage_date").agg(
        F.sum("total_consumption").alias("total_consumption"),
        F.sum("reading_count").alias("reading_count"),
        F.count("meter_id").alias("meter_count"),
    )


def monthly_usage(daily: DataFrame) -> DataFrame:
    """Usage per campus, source and month."""
    return daily.groupBy("campus_id", "source_system", month_start("usage_date").alias("usage_month")).agg(
        F.sum("total_consumption").alias("total_consumption"),
        F.sum("reading_count").alias("reading_count"),
        F.max("meter_count").alias("max_daily_meter_count"),
    )


def peak_demand(nmi: DataFrame) -> DataFrame:
    """The reading with the highest demand of each grid connection, the earliest on ties.

    An arg-max aggregate: each task sends one candidate per meter, however many readings one has.
    """
    reading = F.struct("reading_timestamp", "demand_kw", "demand_kva", "consumption")
    rank = F.struct(-F.col("demand_kw"), F.col("reading_timestamp"))
    return (
        nmi.groupBy("campus_id", "meter_id")
        .agg(F.min_by(reading, rank).alias("peak"))
        .select(
            "campus_id",
            "meter_id",
            F.col("peak.reading_timestamp").alias("peak_timestamp"),
            F.col("peak.demand_kw").alias("peak_demand_kw"),
            F.col("peak.demand_kva").alias("peak_demand_kva"),
            F.col("peak.consumption").alias("consumption_at_peak"),
        )
    )
