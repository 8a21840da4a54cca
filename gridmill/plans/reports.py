"""Report queries on the gold tables.

``campuses`` and ``sources`` are selections: ``None`` takes all, an empty list takes none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions import count_where, day_number, day_title, in_list, month_start, ratio
from gridmill.names import METER_KEYS
from gridmill.plans.marts import MONTH_KEYS

Selection = Sequence | None


def _row_count(alias: str) -> Column:
    return F.count(F.lit(1)).alias(alias)


def _sums(*names: str) -> list[Column]:
    return [F.sum(name).alias(name) for name in names]


def _picked(df: DataFrame, campuses: Selection, sources: Selection = None) -> DataFrame:
    return df.where(in_list("campus_id", campuses) & in_list("source_system", sources))


def _by_meter() -> list[Column]:
    return [F.col(name).asc_nulls_last() for name in METER_KEYS]


def filter_options(monthly: DataFrame) -> DataFrame:
    """Campuses and sources to choose from, as (option, value) rows."""
    pairs = F.array(
        F.struct(F.lit("campus_id").alias("option"), F.col("campus_id").cast("string").alias("value")),
        F.struct(F.lit("source_system").alias("option"), F.col("source_system").alias("value")),
    )
    return monthly.select(F.inline(pairs)).distinct().orderBy("option", "value")


def report_monthly_usage(monthly: DataFrame, campuses: Selection = None, sources: Selection = None) -> DataFrame:
    """Monthly usage of the selection."""
    return _picked(monthly, campuses, sources).select(*MONTH_KEYS, "total_consumption").orderBy(*MONTH_KEYS)


def report_executive_summary(
    monthly: DataFrame,
    emissions: DataFrame,
    peaks: DataFrame,
    baseline: DataFrame | None = None,
    shifts: DataFrame | None = None,
    campuses: Selection = None,
    sources: Selection = None,
) -> DataFrame:
    """One row of headline figures; the two optional tables count as zero when absent.

    Each figure is its own small aggregate, put together as scalar subqueries.
    """
    by_month = _picked(monthly, campuses, sources).groupBy("usage_month").agg(*_sums("total_consumption"))
    months = by_month.agg(F.sum("total_consumption").alias("total"))
    last_two = (
        by_month.orderBy(F.desc("usage_month"))
        .limit(2)
        .agg(
            F.max_by("total_consumption", "usage_month").alias("latest"),
            F.when(F.count(F.lit(1)) == 2, F.min_by("total_consumption", "usage_month")).alias("previous"),
        )
    )
    emitted = _picked(emissions, campuses, sources).agg(F.sum("estimated_emissions_kg_co2e").alias("v"))
    peak = peaks.where(in_list("campus_id", campuses)).agg(F.max("peak_demand_kw").alias("v"))

    def or_zero(frame: DataFrame | None) -> Column:
        return F.lit(0.0) if frame is None else F.coalesce(frame.scalar(), F.lit(0.0))

    candidate_rate = best_shift = None
    if baseline is not None:
        candidate_rate = _picked(baseline, campuses, sources).agg(
            ratio(count_where(F.col("is_high_usage_candidate")), F.count(F.lit(1))).alias("v")
        )
    if shifts is not None:
        best_shift = _picked(shifts, campuses, sources).agg(F.max("peak_reduction").alias("v"))
    latest, previous = F.col("latest_month_consumption"), F.col("previous_month_consumption")
    return (
        last_two.select(
            or_zero(months).alias("total_consumption"),
            F.coalesce("latest", F.lit(0.0)).alias("latest_month_consumption"),
            F.coalesce("previous", F.lit(0.0)).alias("previous_month_consumption"),
        )
        .select(
            "*",
            F.coalesce(ratio(latest - previous, previous), F.lit(0.0)).alias("usage_delta_percent"),
            or_zero(emitted).alias("estimated_emissions_kg_co2e"),
            or_zero(peak).alias("peak_demand_kw"),
            or_zero(candidate_rate).alias("high_usage_rate"),
            or_zero(best_shift).alias("best_peak_reduction"),
        )
    )


def report_monthly_by_campus(monthly: DataFrame, campuses: Selection = None, sources: Selection = None) -> DataFrame:
    """Usage per month and campus."""
    return (
        _picked(monthly, campuses, sources)
        .groupBy("usage_month", "campus_id")
        .agg(*_sums("total_consumption"))
        .orderBy("usage_month", "campus_id")
    )


def report_hourly_heatmap(hourly: DataFrame, campuses: Selection = None, sources: Selection = None) -> DataFrame:
    """Average hourly usage per weekday and hour."""
    return (
        _picked(hourly, campuses, sources)
        .groupBy(
            day_title("usage_hour").alias("day_of_week"),
            day_number("usage_hour").alias("day_order"),
            F.hour("usage_hour").alias("hour_of_day"),
        )
        .agg(F.avg("total_consumption").alias("avg_consumption"))
        .orderBy("day_order", "hour_of_day")
    )


def report_heatmap_pivot(heatmap: DataFrame) -> DataFrame:
    """The heatmap as one row per weekday with a column per hour, rounded half-even to one digit."""
    hours = [str(hour) for hour in range(24)]
    wide = (
        heatmap.groupBy("day_of_week", "day_order")
        .pivot("hour_of_day", list(range(24)))
        .agg(F.first("avg_consumption"))
    )
    return wide.orderBy("day_order").select(
        "day_of_week", *[F.bround(F.col(f"`{hour}`"), 1).alias(hour) for hour in hours]
    )


def report_top_usage_entities(
    hourly: DataFrame, campuses: Selection = None, sources: Selection = None, limit: int = 20
) -> DataFrame:
    """Meters with the highest total usage."""
    return (
        _picked(hourly, campuses, sources)
        .groupBy(*METER_KEYS)
        .agg(*_sums("total_consumption"))
        .orderBy(F.desc("total_consumption"), *_by_meter())
        .limit(limit)
    )


def report_peak_demand(peaks: DataFrame, campuses: Selection = None, limit: int = 20) -> DataFrame:
    """The ``limit`` highest peaks."""
    return (
        peaks.where(in_list("campus_id", campuses))
        .select("campus_id", "meter_id", "peak_timestamp", "peak_demand_kw", "peak_demand_kva")
        .orderBy(F.desc("peak_demand_kw"), "campus_id", "meter_id")
        .limit(limit)
    )


def report_emissions(emissions: DataFrame, campuses: Selection = None, sources: Selection = None) -> DataFrame:
    """Monthly emissions of the selection."""
    return (
        _picked(emissions, campuses, sources)
        .select(
            *MONTH_KEYS, "total_consumption", "factor_id", "factor_region", "factor_year",
            "emissions_factor_kg_co2e_per_kwh", "factor_source_name", "used_default_factor",
            "estimated_emissions_kg_co2e",
        )
        .orderBy(*MONTH_KEYS)
    )


def report_emissions_assumptions(emissions: DataFrame) -> DataFrame:
    """The distinct factors in use."""
    return (
        emissions.select(
            "factor_id", "factor_region", "factor_year", "emissions_factor_kg_co2e_per_kwh",
            "factor_source_name", "factor_source_url", "used_default_factor", "factor_notes",
        )
        .distinct()
        .orderBy("factor_region", "factor_year", "factor_id")
    )


def report_reconciliation(reconciliation: DataFrame, campuses: Selection = None, limit: int = 30) -> DataFrame:
    """The ``limit`` months with the largest gap; months with one side only come last."""
    return (
        reconciliation.where(in_list("campus_id", campuses))
        .select(
            "usage_month", "campus_id", "nmi_consumption", "building_consumption",
            "consumption_difference", "difference_ratio_to_nmi",
        )
        .orderBy(F.abs("consumption_difference").desc_nulls_last(), "usage_month", "campus_id")
        .limit(limit)
    )


def _candidate_counts() -> list[Column]:
    flagged = count_where(F.col("is_high_usage_candidate"))
    return [
        _row_count("baseline_rows"),
        flagged.alias("high_usage_candidates"),
        (flagged / F.count(F.lit(1))).alias("high_usage_rate"),
    ]


def report_baseline_summary(baseline: DataFrame, campuses: Selection = None) -> DataFrame:
    """High-usage candidates per campus and source."""
    return (
        _picked(baseline, campuses)
        .groupBy("campus_id", "source_system")
        .agg(
            *_candidate_counts(),
            F.avg("residual_percent").alias("avg_residual_percent"),
            F.max("efficiency_opportunity_score").alias("max_efficiency_opportunity_score"),
        )
        .orderBy(F.desc("high_usage_rate"), F.desc("high_usage_candidates"), "campus_id", "source_system")
    )


def report_actual_expected_trend(
    baseline: DataFrame, campuses: Selection = None, sources: Selection = None
) -> DataFrame:
    """Actual, expected and residual usage per month, campus and source."""
    return (
        _picked(baseline, campuses, sources)
        .groupBy(month_start("usage_hour").alias("usage_month"), "campus_id", "source_system")
        .agg(*_sums("actual_consumption", "expected_consumption", "residual_consumption"))
        .orderBy(*MONTH_KEYS)
    )


def report_trend_all_sources(trend: DataFrame) -> DataFrame:
    """The trend summed over campuses and sources."""
    return (
        trend.groupBy("usage_month")
        .agg(*_sums("actual_consumption", "expected_consumption", "residual_consumption"))
        .orderBy("usage_month")
    )


def report_candidate_rate_trend(
    baseline: DataFrame, campuses: Selection = None, sources: Selection = None
) -> DataFrame:
    """Share of high-usage candidates per month, campus and source."""
    return (
        _picked(baseline, campuses, sources)
        .groupBy(month_start("usage_hour").alias("usage_month"), "campus_id", "source_system")
        .agg(*_candidate_counts())
        .orderBy(*MONTH_KEYS)
    )


def report_temperature_sample(
    baseline: DataFrame, campuses: Selection = None, sources: Selection = None, limit: int = 5000
) -> DataFrame:
    """The first ``limit`` hours with a temperature, for a scatter plot."""
    return (
        _picked(baseline, campuses, sources)
        .where(F.col("air_temperature").isNotNull())
        .orderBy("usage_hour", *_by_meter())
        .limit(limit)
        .select("campus_id", "source_system", "usage_hour", "air_temperature", "actual_consumption")
    )


def report_top_candidates(baseline: DataFrame, campuses: Selection = None, limit: int = 50) -> DataFrame:
    """The ``limit`` strongest high-usage candidates."""
    return (
        _picked(baseline, campuses)
        .where("is_high_usage_candidate")
        .select(
            *METER_KEYS, "usage_hour", "actual_consumption", "expected_consumption",
            "residual_consumption", "residual_percent", "efficiency_opportunity_score",
        )
        .orderBy(
            F.desc("efficiency_opportunity_score"), F.desc("residual_consumption"), *_by_meter(), "usage_hour"
        )
        .limit(limit)
    )


def report_shift_summary(shifts: DataFrame, percent: float, campuses: Selection = None) -> DataFrame:
    """Average effect of one shift percentage per campus and source."""
    return (
        _picked(shifts, campuses)
        .where(F.col("flexible_load_percent") == percent)
        .groupBy("campus_id", "source_system")
        .agg(
            _row_count("simulation_rows"),
            *[
                F.avg(name).alias(f"avg_{name}")
                for name in (
                    "baseline_peak_consumption", "simulated_peak_consumption",
                    "peak_reduction", "peak_reduction_percent",
                )
            ],
            count_where(F.col("total_energy_preserved")).alias("energy_preserved_rows"),
        )
        .orderBy(F.desc("avg_peak_reduction"), "campus_id", "source_system")
    )


def report_shift_comparison(shifts: DataFrame, campuses: Selection = None, sources: Selection = None) -> DataFrame:
    """Shift percentages side by side."""
    return (
        _picked(shifts, campuses, sources)
        .groupBy("flexible_load_percent")
        .agg(
            _row_count("valid_scenarios"),
            F.avg("peak_reduction").alias("avg_peak_reduction"),
            F.avg("peak_reduction_percent").alias("avg_peak_reduction_percent"),
            F.max("peak_reduction").alias("best_peak_reduction"),
            count_where(~F.col("total_energy_preserved")).alias("energy_preservation_failures"),
            count_where(F.col("negative_usage_created")).alias("negative_usage_rows"),
            count_where(F.col("peak_reduction") < 0).alias("worse_peak_rows"),
        )
        .orderBy("flexible_load_percent")
    )


def report_shift_top(
    shifts: DataFrame, percent: float, campuses: Selection = None, limit: int = 50
) -> DataFrame:
    """The ``limit`` largest peak reductions of one shift percentage."""
    return (
        _picked(shifts, campuses)
        .where(F.col("flexible_load_percent") == percent)
        .select(
            *METER_KEYS, "simulation_date", "flexible_load_percent", "baseline_peak_consumption",
            "simulated_peak_consumption", "peak_reduction", "peak_reduction_percent",
            "total_energy_preserved", "notes",
        )
        .orderBy(F.desc("peak_reduction"), *_by_meter(), "simulation_date")
        .limit(limit)
    )


def report_response_summary(
    responses: DataFrame, campuses: Selection = None, sources: Selection = None
) -> DataFrame:
    """Outcome per set of event parameters."""
    met = count_where(F.col("target_met"))
    return (
        _picked(responses, campuses, sources)
        .groupBy(
            "event_date", "start_hour", "end_hour", "target_reduction_percent",
            "flexible_load_percent", "rebound_window_hours",
        )
        .agg(
            _row_count("simulated_events"),
            met.alias("events_meeting_target"),
            (met / F.count(F.lit(1))).alias("target_achievement_rate"),
            *_sums(
                "baseline_event_consumption", "simulated_event_consumption", "target_reduction",
                "achieved_reduction", "unmet_reduction", "rebound_load",
            ),
            count_where(~F.col("total_energy_preserved")).alias("energy_preservation_failures"),
            count_where(F.col("negative_load_created")).alias("negative_load_failures"),
        )
        .orderBy("event_date", "start_hour", "target_reduction_percent")
    )


def report_response_totals(summary: DataFrame) -> DataFrame:
    """Grand totals of the summary; zeros when there is no event."""
    counts = (
        "simulated_events", "events_meeting_target", "energy_preservation_failures", "negative_load_failures",
    )
    loads = ("achieved_reduction", "unmet_reduction", "rebound_load")
    totals = summary.agg(
        *[F.coalesce(F.sum(name), F.lit(0).cast("long")).alias(name) for name in counts],
        *[F.coalesce(F.sum(name), F.lit(0.0)).alias(name) for name in loads],
    )
    rate = F.coalesce(ratio(F.col("events_meeting_target"), F.col("simulated_events")), F.lit(0.0))
    return totals.withColumn("target_achievement_rate", rate)


def report_response_components(
    responses: DataFrame, campuses: Selection = None, sources: Selection = None
) -> DataFrame:
    """Baseline, simulated and rebound load as three rows, from one aggregate."""
    # Labels of the three rows.
    components = {
        "Baseline event load": "baseline_event_consumption",
        "Simulated event load": "simulated_event_consumption",
        "Rebound load": "rebound_load",
    }
    totals = _picked(responses, campuses, sources).agg(*_sums(*components.values()))
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("load_component"), F.col(name).alias("total_consumption"))
            for label, name in components.items()
        ]
    )
    return totals.select(F.inline(rows))


def report_response_top(
    responses: DataFrame, campuses: Selection = None, sources: Selection = None, limit: int = 50
) -> DataFrame:
    """The ``limit`` largest achieved reductions."""
    return (
        _picked(responses, campuses, sources)
        .select(
            *METER_KEYS, "event_date", "start_hour", "end_hour", "target_reduction_percent",
            "flexible_load_percent", "baseline_event_consumption", "simulated_event_consumption",
            "target_reduction", "achieved_reduction", "unmet_reduction", "target_met", "rebound_load",
            "total_energy_preserved", "negative_load_created", "notes",
        )
        .orderBy(F.desc("achieved_reduction"), *_by_meter(), "event_date", "start_hour")
        .limit(limit)
    )
