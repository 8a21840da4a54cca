"""Grid-connection versus building totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.functions import month_start, ratio
from gridmill.names import BUILDING, NMI


def _with_difference(totals: DataFrame) -> DataFrame:
    difference = F.col("nmi_consumption") - F.col("building_consumption")
    return totals.withColumns(
        {
            "consumption_difference": difference,
            "difference_ratio_to_nmi": ratio(difference, F.col("nmi_consumption")),
        }
    )


def reconcile_daily(daily: DataFrame) -> DataFrame:
    """Both totals of each campus and day; a side without readings stays NULL.

    Two conditional sums in one aggregate replace the outer join of two filtered aggregates.
    """
    total = F.col("total_consumption")
    source = F.col("source_system")
    totals = (
        daily.where(source.isin(NMI, BUILDING))
        .groupBy("campus_id", "usage_date")
        .agg(
            F.sum(F.when(source == NMI, total)).alias("nmi_consumption"),
            F.sum(F.when(source == BUILDING, total)).alias("building_consumption"),
        )
    )
    return _with_difference(totals)


def reconcile_monthly(daily_reconciliation: DataFrame) -> DataFrame:
    """Monthly sums of the daily totals, with difference and ratio taken again."""
    totals = daily_reconciliation.groupBy("campus_id", month_start("usage_date").alias("usage_month")).agg(
        F.sum("nmi_consumption").alias("nmi_consumption"),
        F.sum("building_consumption").alias("building_consumption"),
    )
    return _with_difference(totals)
