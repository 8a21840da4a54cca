"""The physical plans: number of shuffles, join kinds, pushed filters and columns read."""

import pytest

import __spark_entry__ as entry
from gridmill.operators import baseline, emissions, quality, reconcile, retrieval, scenarios, silver, usage
from gridmill.plans import marts, reports
from gridmill.sources.layers import store

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The layers as files, as a full build leaves them."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    folder = tmp_path_factory.mktemp("layers")
    lazy = entry.Tables(spark, SF)
    kept = {}

    class Stored:
        spark = lazy.spark

        def __getattr__(self, name):
            if name not in kept:
                kept[name] = store(getattr(lazy, name), f"{folder}/{name}")
            return kept[name]

    return Stored()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning") + plan(df).count("Exchange SinglePartition")


@pytest.mark.parametrize(
    ("build", "expected"),
    [
        (lambda t: silver.clean_building_readings(t.bronze_building), 1),
        (lambda t: silver.clean_nmi_readings(t.bronze_nmi), 1),
        (lambda t: silver.clean_submeter_readings(t.bronze_submeter), 1),
        (lambda t: usage.hourly_usage(t.building, t.nmi, t.submeter), 1),
        (lambda t: usage.daily_usage(t.hourly), 2),
        (lambda t: usage.monthly_usage(t.daily), 1),
        (lambda t: usage.peak_demand(t.nmi), 1),
        (lambda t: reconcile.reconcile_daily(t.daily), 1),
        (lambda t: reconcile.reconcile_monthly(t.recon_daily), 1),
        (lambda t: baseline.hourly_weather(t.bronze_weather), 1),
        (lambda t: baseline.weather_baseline(t.hourly, t.weather), 1),
        (lambda t: emissions.emissions_time_varying(t.hourly, t.emissions, t.intensity), 0),
        (lambda t: scenarios.shift_scenarios(t.hourly), 1),
        (lambda t: scenarios.event_response_scenarios(t.hourly, **entry.EVENT), 1),
        (lambda t: reports.report_hourly_heatmap(t.hourly), 1),
        (lambda t: reports.report_top_usage_entities(t.hourly), 1),
        (lambda t: marts.top_monthly_usage(t.monthly), 0),
        (lambda t: retrieval.keyword_search(t.line_chunks, entry.SEARCH, id_column="doc_id"), 0),
        (lambda t: t.line_chunks, 0),
    ],
)
def test_shuffles(stored, build, expected):
    assert shuffles(build(stored)) == expected


def test_no_job_has_a_nested_loop_or_cross_join(stored):
    t = stored
    for df in (
        emissions.emissions_monthly(t.monthly, t.factors),
        emissions.emissions_time_varying(t.hourly, t.emissions, t.intensity),
        baseline.weather_baseline(t.hourly, t.weather),
        scenarios.shift_scenarios(t.hourly),
        quality.quality_checks(t.building, t.nmi, t.submeter, t.campus_meta),
        reports.report_executive_summary(t.monthly, t.emissions, t.peaks, t.baseline, t.shifts),
    ):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_quality_reads_each_table_once(stored):
    t = stored
    text = plan(quality.quality_checks(t.building, t.nmi, t.submeter, t.campus_meta))
    assert [text.count(f"/{name}]") for name in ("building", "nmi", "submeter")] == [1, 1, 1]


def test_aggregates_combine_before_the_shuffle(stored):
    t = stored
    for df in (
        silver.clean_nmi_readings(t.bronze_nmi), usage.peak_demand(t.nmi), scenarios.shift_scenarios(t.hourly),
        usage.daily_usage(t.hourly), emissions.emissions_monthly(t.monthly, t.factors),
    ):
        assert "partial_" in plan(df) and "Window" not in plan(df)


def test_selections_and_columns_reach_the_scan(stored):
    text = plan(reports.report_monthly_usage(stored.monthly, [4], ["nmi_consumption"]))
    assert "EqualTo(campus_id,4)" in text and "EqualTo(source_system,nmi_consumption)" in text
    read = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert read == "campus_id:bigint,source_system:string,usage_month:date,total_consumption:double"


def test_hourly_reads_no_electrical_columns(stored):
    text = plan(usage.hourly_usage(stored.building, stored.nmi, stored.submeter))
    assert "voltage" not in text and "demand_kva" not in text


def test_joins_survive_without_broadcasts(spark, stored):
    """Above every broadcast threshold the same joins shuffle on their keys and give the same rows."""
    t = stored
    def run():
        varying = emissions.emissions_time_varying(t.hourly, t.emissions, t.intensity)
        scored = baseline.weather_baseline(t.hourly, t.weather)
        return [sorted(map(repr, df.collect())) for df in (varying, scored)], plan(varying)

    rows, text = run()
    assert "BroadcastHashJoin" in text
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled, text = run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in text and "Broadcast" not in text
    assert shuffled == rows
