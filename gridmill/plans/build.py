"""Full refresh of every layer table, each step reading the stored tables before it."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from gridmill.functions import month_start
from gridmill.names import QUALITY_TABLE
from gridmill.operators.baseline import hourly_weather, weather_baseline
from gridmill.operators.emissions import emissions_monthly, emissions_time_varying
from gridmill.operators.quality import (
    BUILDING_TABLE,
    NMI_TABLE,
    SUBMETER_TABLE,
    quality_checks,
    require_quality,
)
from gridmill.operators.reconcile import reconcile_daily, reconcile_monthly
from gridmill.operators.scenarios import event_response_scenarios, shift_scenarios
from gridmill.operators.silver import clean_building_readings, clean_nmi_readings, clean_submeter_readings
from gridmill.operators.usage import daily_usage, hourly_usage, monthly_usage, peak_demand
from gridmill.session import run_folder
from gridmill.sources.layers import store, table_inventory, write_layer
from gridmill.sources.raw import BRONZE_METADATA, FEED_SCHEMAS, ingest_bronze
from gridmill.sources.reference import load_emissions_factors, load_grid_intensity, register_reference


def build_silver(
    building: DataFrame,
    nmi: DataFrame,
    submeter: DataFrame,
    time_zone: str | None = None,
    root: str | None = None,
) -> tuple[DataFrame, ...]:
    """Store the three silver tables, time-ordered inside each file."""
    save = partial(write_layer, sort_by=["reading_timestamp"], root=root)
    return (
        save(clean_building_readings(building, time_zone), BUILDING_TABLE),
        save(clean_nmi_readings(nmi, time_zone), NMI_TABLE),
        save(clean_submeter_readings(submeter, time_zone), SUBMETER_TABLE),
    )


def build_all(
    spark: SparkSession,
    building: DataFrame,
    nmi: DataFrame,
    submeter: DataFrame,
    weather: DataFrame,
    campus_meta: DataFrame,
    factors: DataFrame,
    intensity: DataFrame,
    region_code: str = "VIC1",
    time_zone: str | None = None,
    event: dict | None = None,
    shift: dict | None = None,
    stop_on_failed_checks: bool = True,
    root: str | None = None,
) -> DataFrame:
    """Build silver, check it, then build gold; returns the table inventory.

    ``time_zone`` is the clock that readings stored as instants are read on; ``root`` is where the
    tables lie if not in the warehouse.
    """
    save = partial(write_layer, root=root)
    silver = build_silver(building, nmi, submeter, time_zone, root)
    checks = save(quality_checks(*silver, campus_meta), QUALITY_TABLE)
    if stop_on_failed_checks:
        require_quality(checks)

    # The month is stored as a partition, so that a job on one event day opens one month of files.
    hourly = save(
        hourly_usage(*silver).withColumn("usage_month", month_start("usage_hour")),
        "gold.gold_hourly_electricity_usage",
        partition_by=["usage_month"],
        sort_by=["usage_hour"],
    )
    daily = save(daily_usage(hourly), "gold.gold_daily_electricity_usage")
    monthly = save(monthly_usage(daily), "gold.gold_monthly_electricity_usage")
    save(peak_demand(silver[1]), "gold.gold_peak_demand")

    daily_gap = save(reconcile_daily(daily), "gold.gold_daily_nmi_building_reconciliation")
    save(reconcile_monthly(daily_gap), "gold.gold_monthly_nmi_building_reconciliation")

    factors = register_reference(factors, "reference_emissions_factors", root=root)
    intensity = register_reference(
        intensity, "reference_grid_carbon_intensity_hourly", stamp=True, root=root
    )
    emissions = save(emissions_monthly(monthly, factors), "gold.gold_electricity_emissions")
    by_month = {"partition_by": ["usage_month"], "sort_by": ["usage_hour"]}
    varying = emissions_time_varying(hourly, emissions, intensity, region_code)
    save(
        varying.withColumn("usage_month", month_start("usage_hour")),
        "gold.gold_hourly_time_varying_emissions",
        **by_month,
    )
    # Stored first, so that the planner knows how small it is before it lays out the large side.
    by_hour = store(hourly_weather(weather), f"{run_folder(spark, 'build')}/hourly_weather")
    scored = weather_baseline(hourly, by_hour)
    save(scored.withColumn("usage_month", month_start("usage_hour")), "gold.gold_weather_normalized_usage", **by_month)
    save(shift_scenarios(hourly, **(shift or {})), "gold.gold_peak_shift_simulation")
    save(event_response_scenarios(hourly, **(event or {})), "gold.gold_demand_response_simulation")
    return table_inventory(spark)


def build_from_raw(
    spark: SparkSession,
    raw_dir: str,
    factors_path: str,
    intensity_path: str,
    max_bad_records: int = 0,
    root: str | None = None,
    **options,
) -> DataFrame:
    """From a folder of raw files and two reference files to all layers; returns the table inventory.

    The folder has the feeds of ``FEED_SCHEMAS`` and the campus metadata by their names. ``options`` go to
    ``build_all``.
    """
    ingest_bronze(spark, raw_dir, FEED_SCHEMAS, root=root, max_bad_records=max_bad_records)
    feeds = [spark.table(f"bronze.{name}") for name in FEED_SCHEMAS]
    campus_meta = spark.table(f"bronze.{BRONZE_METADATA}")
    factors = load_emissions_factors(spark, factors_path)
    intensity = load_grid_intensity(spark, intensity_path)
    return build_all(spark, *feeds, campus_meta, factors, intensity, root=root, **options)
