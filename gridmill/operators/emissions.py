"""Static and hourly-varying emissions estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.functions import count_where, month_start

ANY_SOURCE = "*"
MATCHED, FALLBACK, MISSING = "matched_hourly_factor", "fallback_static_factor", "missing_hourly_factor"


def distinct_choices(
    factors: DataFrame, country: str = "Australia", energy_type: str = "electricity"
) -> DataFrame:
    """The factors that can ever be chosen: one per source, year and default flag, lowest id first."""
    detail = (
        "factor_id", "country", "region", "energy_type", "emissions_factor_kg_co2e_per_kwh",
        "factor_source_name", "factor_source_url", "notes",
    )
    return (
        factors.where((F.col("energy_type") == energy_type) & (F.col("country") == country))
        .groupBy(F.col("source_system").alias("factor_source"), "factor_year", "is_default")
        .agg(F.min_by(F.struct(*detail), F.col("factor_id")).alias("detail"))
    )


def emissions_monthly(
    monthly: DataFrame, factors: DataFrame, country: str = "Australia", energy_type: str = "electricity"
) -> DataFrame:
    """Monthly usage times its best factor; usage without any factor is left out.

    A factor for the source beats one for any source, then the usage year beats other years, then a
    specific factor beats a default one, then the newest year wins; ``factor_id`` settles the rest.
    Each usage row looks under two names, its own source and the wildcard, which makes the wildcard
    rule an equality join. At most two factors per source and year take part, so the join widens
    usage by a handful of years, and the best match is an arg-min that combines on the map side.
    ``monthly`` is read once.
    """
    keys = ("campus_id", "source_system", "usage_month", "total_consumption")
    year = F.year("usage_month")
    lookups = monthly.select(*keys, F.explode(F.array("source_system", F.lit(ANY_SOURCE))).alias("factor_source"))
    applicable = lookups.join(distinct_choices(factors, country, energy_type), "factor_source").where(
        (F.col("factor_year") <= year) | F.col("is_default")
    )
    # Compared field by field, lowest first; missing flags and years go last.
    preference = F.struct(
        F.col("factor_source") == ANY_SOURCE,
        ~F.coalesce(F.col("factor_year") == year, F.lit(False)),
        F.coalesce(F.col("is_default").cast("int"), F.lit(2)),
        F.col("factor_year").isNull(),
        -F.col("factor_year"),
        F.col("detail.factor_id"),
    )
    best = applicable.groupBy(*keys).agg(
        F.min_by(F.struct("factor_year", "is_default", "detail"), preference).alias("best")
    )
    factor = F.col("best.detail.emissions_factor_kg_co2e_per_kwh")
    return best.select(
        *keys,
        F.col("best.detail.factor_id").alias("factor_id"),
        F.col("best.detail.country").alias("factor_country"),
        F.col("best.detail.region").alias("factor_region"),
        F.col("best.detail.energy_type").alias("energy_type"),
        F.col("best.factor_year").alias("factor_year"),
        factor.alias("emissions_factor_kg_co2e_per_kwh"),
        F.col("best.detail.factor_source_name").alias("factor_source_name"),
        F.col("best.detail.factor_source_url").alias("factor_source_url"),
        F.col("best.is_default").alias("used_default_factor"),
        F.col("best.detail.notes").alias("factor_notes"),
        (F.col("total_consumption") * factor).alias("estimated_emissions_kg_co2e"),
    )


def emissions_monthly_stats(emissions: DataFrame, factors: DataFrame) -> DataFrame:
    """Rows built, factors loaded, rows on a default factor."""
    factor_count = factors.agg(F.count(F.lit(1)).alias("factor_count"))
    return emissions.agg(
        F.count(F.lit(1)).alias("row_count"),
        count_where(F.col("used_default_factor")).alias("default_factor_count"),
    ).select("row_count", factor_count.scalar().alias("factor_count"), "default_factor_count")


def emissions_time_varying(
    hourly: DataFrame, emissions: DataFrame, intensity: DataFrame, region_code: str = "VIC1"
) -> DataFrame:
    """Hourly usage with the static estimate and, where the hour is covered, the hourly one.

    Hours without an intensity keep a NULL hourly estimate; only source and status fall back.
    """
    usage = hourly.select(
        "usage_hour", "campus_id", "source_system", "meter_id", "building_id", "total_consumption",
        month_start("usage_hour").alias("usage_month"),
    )
    static = emissions.select(
        "campus_id",
        "source_system",
        "usage_month",
        F.col("emissions_factor_kg_co2e_per_kwh").alias("static_emissions_factor_kg_co2e_per_kwh"),
        F.col("factor_source_name").alias("static_source_name"),
        F.col("factor_source_url").alias("static_source_url"),
    )
    by_hour = intensity.where(F.col("region_code") == region_code).select(
        F.col("interval_start_hour").alias("usage_hour"),
        F.col("emissions_intensity_kg_co2e_per_kwh").alias("time_varying_emissions_factor_kg_co2e_per_kwh"),
        "source_name",
        "source_url",
    )
    joined = usage.join(static, ["campus_id", "source_system", "usage_month"], "left").join(
        by_hour, "usage_hour", "left"
    )
    static_factor = F.col("static_emissions_factor_kg_co2e_per_kwh")
    hourly_factor = F.col("time_varying_emissions_factor_kg_co2e_per_kwh")
    return joined.select(
        "usage_hour",
        "campus_id",
        "source_system",
        "meter_id",
        "building_id",
        "total_consumption",
        static_factor,
        (F.col("total_consumption") * static_factor).alias("static_estimated_emissions_kg_co2e"),
        hourly_factor,
        (F.col("total_consumption") * hourly_factor).alias("time_varying_estimated_emissions_kg_co2e"),
        F.coalesce("source_name", "static_source_name").alias("factor_source_name"),
        F.coalesce("source_url", "static_source_url").alias("factor_source_url"),
        F.when(hourly_factor.isNotNull(), MATCHED)
        .when(static_factor.isNotNull(), FALLBACK)
        .otherwise(MISSING)
        .alias("factor_match_status"),
    )


def emissions_match_stats(time_varying: DataFrame, intensity: DataFrame) -> DataFrame:
    """Reference rows, hourly rows, and hourly rows per match status."""
    reference_rows = intensity.agg(F.count(F.lit(1)).alias("reference_row_count"))
    status = F.col("factor_match_status")
    counted = time_varying.agg(
        F.count(F.lit(1)).alias("gold_row_count"),
        *[count_where(status == name).alias(f"{name}_count") for name in (MATCHED, FALLBACK, MISSING)],
    )
    return counted.select(reference_rows.scalar().alias("reference_row_count"), *counted.columns)
