"""The full refresh over the small test tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import event_feed as feed
from gridmill.operators.scenarios import event_response_scenarios
from gridmill.plans.build import build_all, build_from_raw
from gridmill.plans.questions import QUESTIONS
from gridmill.sources.raw import FEED_SCHEMAS

from helpers import values

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return entry.Tables(spark, SF)


@pytest.fixture(scope="module")
def inventory(spark, tables):
    return build_all(
        spark, tables.bronze_building, tables.bronze_nmi, tables.bronze_submeter, tables.bronze_weather,
        tables.campus_meta, tables.factors, tables.intensity,
        event={"event_date": "2024-01-15", "start_hour": 8, "end_hour": 18},
        stop_on_failed_checks=False,
    )


def test_every_table_is_stored(spark, inventory):
    names = {f"{layer}.{table}" for layer, table, _ in values(inventory)}
    assert {table for _, table in QUESTIONS.values() if table} <= names
    assert {"gold.gold_electricity_emissions", "reference.reference_emissions_factors"} <= names
    assert spark.table("quality.quality_check_results").count() == 18


def test_stored_tables_equal_the_lazy_ones(spark, tables, inventory):
    for table, lazy in (
        ("gold.gold_hourly_electricity_usage", tables.hourly),
        ("gold.gold_monthly_electricity_usage", tables.monthly),
        ("gold.gold_weather_normalized_usage", tables.baseline),
        ("gold.gold_peak_shift_simulation", tables.shifts),
    ):
        assert values(spark.table(table).select(*lazy.columns)) == values(lazy)


def test_usage_is_conserved_through_the_layers(spark, inventory):
    def total(table):
        return spark.table(table).selectExpr("sum(total_consumption)").first()[0]

    hourly = total("gold.gold_hourly_electricity_usage")
    assert total("gold.gold_daily_electricity_usage") == hourly
    assert total("gold.gold_monthly_electricity_usage") == hourly
    assert total("gold.gold_hourly_time_varying_emissions") == hourly


def test_event_day_opens_one_month(spark, inventory):
    hourly = spark.table("gold.gold_hourly_electricity_usage")
    plan = event_response_scenarios(hourly, event_date="2024-01-15")._jdf.queryExecution().executedPlan().toString()
    assert "(usage_month#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_questions_run_on_the_stored_tables(spark, inventory):
    for ask, table in QUESTIONS.values():
        assert ask(spark.table(table or "gold.gold_peak_demand")).columns


def test_failed_checks_stop_the_build(spark, tables):
    with pytest.raises(ValueError, match="quality checks failed"):
        build_all(
            spark, tables.bronze_building, tables.bronze_nmi, tables.bronze_submeter, tables.bronze_weather,
            tables.campus_meta, tables.factors, tables.intensity,
        )


def test_build_from_files(spark, tables, inventory, tmp_path):
    """CSV files in, the same gold tables out as from frames; a month filter opens one month of each hourly table."""
    feeds = (tables.bronze_building, tables.bronze_nmi, tables.bronze_submeter, tables.bronze_weather)
    for (name, schema), frame in zip(FEED_SCHEMAS.items(), feeds):
        columns = [column.split()[0] for column in schema.split(", ")]
        full = frame.select(*[frame[c] if c in frame.columns else F.lit(None).cast("string").alias(c) for c in columns])
        full.write.csv(str(tmp_path / "raw" / f"{name.removeprefix('bronze_')}.csv"), header=True, nullValue="N/A")
    tables.campus_meta.coalesce(1).write.csv(str(tmp_path / "raw" / "campus_meta.csv"), header=True)
    texts = {"factors": feed.factor_text_feed(tables.table("supplier")), "intensity": feed.intensity_text_feed(tables.events)}
    for name, frame in texts.items():
        frame.write.csv(str(tmp_path / name), header=True, quoteAll=True)
    found = build_from_raw(
        spark, str(tmp_path / "raw"), str(tmp_path / "factors"), str(tmp_path / "intensity"),
        event={"event_date": "2024-01-15", "start_hour": 8, "end_hour": 18}, stop_on_failed_checks=False,
    )
    assert {row[:2] for row in values(inventory)} <= {row[:2] for row in values(found)}
    assert spark.table("quality.quality_check_results").count() == 18
    for table, lazy in (("hourly_electricity_usage", tables.hourly), ("weather_normalized_usage", tables.baseline)):
        assert values(spark.table(f"gold.gold_{table}").select(*lazy.columns)) == values(lazy)
    for table in ("hourly_electricity_usage", "weather_normalized_usage", "hourly_time_varying_emissions"):
        month = spark.table(f"gold.gold_{table}").where("usage_month = date'2024-01-01'")
        plan = month._jdf.queryExecution().executedPlan().toString()
        assert "(usage_month#" in plan.split("PartitionFilters: [")[1].split("]")[0]
