"""Checks on the silver tables: six rules per table, one result row each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions import count_where

# Table names, keys and required fields per silver table.
BUILDING_TABLE = "silver.silver_building_electricity_readings"
NMI_TABLE = "silver.silver_nmi_electricity_readings"
SUBMETER_TABLE = "silver.silver_submeter_electricity_readings"
KEYS = {
    BUILDING_TABLE: ("campus_id", "meter_id", "reading_timestamp"),
    NMI_TABLE: ("campus_id", "meter_id", "reading_timestamp"),
    SUBMETER_TABLE: ("campus_id", "building_id", "meter_id", "reading_timestamp"),
}
REQUIRED = {
    BUILDING_TABLE: (*KEYS[BUILDING_TABLE], "consumption", "source_system"),
    NMI_TABLE: (*KEYS[NMI_TABLE], "consumption", "demand_kw", "demand_kva", "source_system"),
    SUBMETER_TABLE: (
        *KEYS[SUBMETER_TABLE], "consumption", "current", "voltage", "power", "power_factor", "source_system",
    ),
}


def table_facts(silver: DataFrame, campus_meta: DataFrame, keys: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Everything the six checks need about one table, in one row and one scan.

    Rows fold to one line per key (which finds repeated keys), keys fold to one line per campus
    (which is all the metadata join has to look at), and campuses fold to the totals.
    """
    any_missing = reduce(Column.__or__, [F.col(name).isNull() for name in required])
    per_key = silver.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        count_where(any_missing).alias("missing"),
        count_where(F.col("consumption") < 0).alias("negative"),
    )
    per_campus = per_key.groupBy("campus_id").agg(
        F.sum("n").alias("n"),
        F.sum("missing").alias("missing"),
        F.sum("negative").alias("negative"),
        count_where(F.col("n") > 1).alias("repeated_keys"),
        F.min("reading_timestamp").alias("first_ts"),
        F.max("reading_timestamp").alias("last_ts"),
    )
    known = campus_meta.select(F.col("id").cast("long").alias("campus_id")).distinct().withColumn("known", F.lit(True))
    zero = F.lit(0).cast("long")
    return per_campus.join(known, "campus_id", "left").agg(
        F.coalesce(F.sum("n"), zero).alias("row_count"),
        F.coalesce(F.sum("missing"), zero).alias("missing"),
        F.coalesce(F.sum("negative"), zero).alias("negative"),
        F.coalesce(F.sum("repeated_keys"), zero).alias("repeated_keys"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), zero).alias("unknown_campus"),
    )


def _moment_text(moment: Column) -> Column:
    """A time as text, with six digits where it has a fraction of a second."""
    text = moment.cast("string")
    return F.coalesce(F.when(text.contains("."), F.rpad(text, 26, "0")).otherwise(text), F.lit("None"))


def check_rows(facts: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """The facts of one table as six check rows."""

    def check(name: str, passed: Column, observed: Column, expected: str, description: str) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            F.lit(table).alias("table_name"),
            F.when(passed, "PASS").otherwise("FAIL").alias("status"),
            observed.cast("string").alias("observed_value"),
            F.lit(expected).alias("expected"),
            F.lit(description).alias("description"),
        )

    def none_found(name: str, counter: str, description: str) -> Column:
        return check(name, F.col(counter) == 0, F.col(counter), "0", description)

    first, last = F.col("first_ts"), F.col("last_ts")
    coverage = F.concat_ws(" to ", _moment_text(first), _moment_text(last))
    # Check names, expectations and descriptions.
    checks = F.array(
        check(
            "row_count_positive", F.col("row_count") > 0, F.col("row_count"), "> 0",
            "Silver table should contain rows after transformation.",
        ),
        none_found("required_fields_not_null", "missing", "Required silver fields should not be null."),
        none_found("consumption_non_negative", "negative", "Consumption should be non-negative in silver."),
        none_found(
            "duplicate_key_count", "repeated_keys", f"No duplicate records for key: {', '.join(keys)}."
        ),
        check(
            "timestamp_coverage_present", first.isNotNull() & last.isNotNull(), coverage,
            "non-null min and max", "Timestamp coverage should be present for each silver table.",
        ),
        none_found(
            "campus_reference_exists", "unknown_campus",
            "Silver campus IDs should exist in bronze campus metadata.",
        ),
    )
    return facts.select(F.inline(checks))


def quality_checks(
    building: DataFrame, nmi: DataFrame, submeter: DataFrame, campus_meta: DataFrame
) -> DataFrame:
    """All checks over the three silver tables."""
    silver = {BUILDING_TABLE: building, NMI_TABLE: nmi, SUBMETER_TABLE: submeter}
    return reduce(
        DataFrame.unionByName,
        [
            check_rows(table_facts(df, campus_meta, KEYS[table], REQUIRED[table]), table, KEYS[table])
            for table, df in silver.items()
        ],
    )


def quality_summary(checks: DataFrame) -> DataFrame:
    """Checks per status."""
    return checks.groupBy("status").agg(F.count(F.lit(1)).alias("check_count")).orderBy("status")


def failed_checks(checks: DataFrame) -> DataFrame:
    """The checks that stop a build, with what they found."""
    return checks.where("status = 'FAIL'").select("name", "table_name", "observed_value", "expected")


def require_quality(checks: DataFrame) -> DataFrame:
    """Raise if any check failed; call it on the stored check table."""
    failed = [f"{row.name} on {row.table_name}" for row in failed_checks(checks).collect()]
    if failed:
        raise ValueError(f"{len(failed)} quality checks failed: {'; '.join(sorted(failed))}")
    return checks
