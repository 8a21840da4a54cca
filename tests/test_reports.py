from datetime import date
from pathlib import Path

import pytest

from gridmill.names import BUILDING, NMI
from gridmill.operators.emissions import emissions_monthly
from gridmill.operators.reconcile import reconcile_daily, reconcile_monthly
from gridmill.operators.scenarios import event_response_scenarios, shift_scenarios
from gridmill.plans import marts, questions, reports
from gridmill.sources.reference import FACTOR_COLUMNS, parse_emissions_factors

from helpers import DAILY, MONTHLY, at, hourly_frame, values
from test_baseline import MONDAYS, scored

JAN, FEB, MAR = date(2024, 1, 1), date(2024, 2, 1), date(2024, 3, 1)
PEAKS = (
    "campus_id bigint, meter_id bigint, peak_timestamp timestamp_ntz, peak_demand_kw double, "
    "peak_demand_kva double, consumption_at_peak double"
)


@pytest.fixture
def monthly(spark):
    return spark.createDataFrame(
        [(1, BUILDING, JAN, 100.0, 4, 1), (1, BUILDING, FEB, 150.0, 4, 2), (2, NMI, FEB, 30.0, 2, 1)], MONTHLY
    )


@pytest.fixture
def emissions(spark, monthly):
    factor = ["f", "Australia", "Victoria", "*", "electricity", "2024", "0.5", "Demo", "", "true", "n"]
    return emissions_monthly(monthly, parse_emissions_factors(spark.createDataFrame([factor], list(FACTOR_COLUMNS))))


@pytest.fixture
def peaks(spark):
    rows = [(1, 20, at("2024-01-01 00:15"), 90.0, 91.0, 60.0), (2, 21, at("2024-01-01 00:15"), 95.0, 96.0, 60.0)]
    return spark.createDataFrame(rows, PEAKS)


def test_selections(monthly):
    assert values(reports.report_monthly_usage(monthly, [1], [BUILDING])) == [
        (JAN, 1, BUILDING, 100.0), (FEB, 1, BUILDING, 150.0),
    ]
    assert values(reports.report_monthly_usage(monthly, [], None)) == []
    assert len(values(reports.report_monthly_usage(monthly))) == 3
    assert values(reports.filter_options(monthly)) == [
        ("campus_id", "1"), ("campus_id", "2"), ("source_system", BUILDING), ("source_system", NMI),
    ]
    assert values(reports.report_monthly_by_campus(monthly)) == [(JAN, 1, 100.0), (FEB, 1, 150.0), (FEB, 2, 30.0)]


def test_executive_summary(spark, monthly, emissions, peaks):
    baseline = scored(spark, dict(zip(MONDAYS, (100, 100, 200))), [(m, 20.0) for m in MONDAYS])
    shifts = shift_scenarios(hourly_frame(spark, {"2024-01-01 08:00": 100, "2024-01-01 10:00": 50}))
    row = reports.report_executive_summary(monthly, emissions, peaks, baseline, shifts, [1], [BUILDING]).first()
    assert row.asDict() == {
        "total_consumption": 250.0, "latest_month_consumption": 150.0, "previous_month_consumption": 100.0,
        "usage_delta_percent": 0.5, "estimated_emissions_kg_co2e": 125.0, "peak_demand_kw": 90.0,
        "high_usage_rate": 1 / 3, "best_peak_reduction": 15.0,
    }


def test_executive_summary_without_optional_tables_or_rows(monthly, emissions, peaks):
    row = reports.report_executive_summary(monthly, emissions, peaks, campuses=[], sources=[]).first()
    assert set(row.asDict().values()) == {0.0}
    one_month = reports.report_executive_summary(monthly, emissions, peaks, campuses=[2]).first()
    assert (one_month.latest_month_consumption, one_month.previous_month_consumption) == (30.0, 0.0)
    assert one_month.usage_delta_percent == 0.0


def test_heatmap_and_pivot(spark):
    hourly = hourly_frame(spark, {"2024-01-07 08:00": 10, "2024-01-14 08:00": 20.5, "2024-01-08 09:00": 7})
    heatmap = reports.report_hourly_heatmap(hourly)
    assert values(heatmap) == [("Monday", 1, 9, 7.0), ("Sunday", 0, 8, 15.25)]
    wide = reports.report_heatmap_pivot(heatmap)
    assert wide.columns == ["day_of_week", *map(str, range(24))]
    rows = [row.asDict() for row in wide.collect()]
    assert [row["day_of_week"] for row in rows] == ["Sunday", "Monday"]
    assert (rows[0]["8"], rows[0]["9"], rows[1]["9"]) == (15.2, None, 7.0)


def test_top_lists(spark, monthly, emissions, peaks):
    hourly = hourly_frame(spark, {"2024-01-01 08:00": 5, "2024-01-01 09:00": 6}).unionByName(
        hourly_frame(spark, {"2024-01-01 08:00": 50}, meter=11, building=3)
    )
    assert values(reports.report_top_usage_entities(hourly, limit=1)) == [(1, BUILDING, 11, 3, 50.0)]
    assert values(reports.report_peak_demand(peaks, [1]), "meter_id") == [(20,)]
    assert [r.meter_id for r in marts.peak_demand_by_meter(peaks).collect()] == [21, 20]
    assert [r.total_consumption for r in marts.top_monthly_usage(monthly, 2).collect()] == [150.0, 100.0]
    assert marts.monthly_emissions_summary(emissions, 1).first().estimated_emissions_kg_co2e == 75.0
    assert values(marts.source_usage_summary(monthly)) == [(BUILDING, 2, 250.0, 8), (NMI, 1, 30.0, 2)]


def test_emissions_reports(emissions):
    assert len(values(reports.report_emissions(emissions, [1]))) == 2
    assert values(reports.report_emissions_assumptions(emissions)) == [
        ("f", "Victoria", 2024, 0.5, "Demo", "", True, "n")
    ]


def test_reconciliation_report_puts_one_sided_months_last(spark):
    days = [(1, NMI, JAN, 100.0), (1, BUILDING, JAN, 80.0), (1, NMI, FEB, 5.0), (1, NMI, MAR, 10.0), (1, BUILDING, MAR, 90.0)]
    daily = spark.createDataFrame([(*row, 1, 1) for row in days], DAILY)
    report = reports.report_reconciliation(reconcile_monthly(reconcile_daily(daily)))
    assert [row.usage_month for row in report.collect()] == [MAR, JAN, FEB]


def test_baseline_reports(spark):
    baseline = scored(spark, dict(zip(MONDAYS, (100, 100, 200))), [(m, 20.0) for m in MONDAYS])
    assert values(reports.report_baseline_summary(baseline, [1])) == [
        (1, BUILDING, 3, 1, pytest.approx(1 / 3), pytest.approx(1 / 3), 100.0)
    ]
    trend = reports.report_actual_expected_trend(baseline)
    assert values(trend) == [(JAN, 1, BUILDING, 400.0, 300.0, 100.0)]
    assert values(reports.report_trend_all_sources(trend)) == [(JAN, 400.0, 300.0, 100.0)]
    assert values(reports.report_candidate_rate_trend(baseline), "high_usage_candidates") == [(1,)]
    assert values(reports.report_temperature_sample(baseline, limit=2), "usage_hour") == [
        (at(MONDAYS[0]),), (at(MONDAYS[1]),),
    ]
    assert values(reports.report_top_candidates(baseline), "usage_hour") == [(at(MONDAYS[2]),)]
    assert values(questions.top_high_usage(baseline), "efficiency_opportunity_score") == [(100.0,)]


def test_shift_reports(spark):
    shifts = shift_scenarios(hourly_frame(spark, {"2024-01-01 08:00": 100, "2024-01-01 10:00": 50}))
    assert values(reports.report_shift_summary(shifts, 0.10)) == [(1, BUILDING, 1, 100.0, 90.0, 10.0, 0.1, 1)]
    assert values(reports.report_shift_comparison(shifts), "flexible_load_percent", "best_peak_reduction") == [
        (0.05, 5.0), (0.1, 10.0), (0.15, 15.0),
    ]
    assert values(reports.report_shift_top(shifts, 0.15), "peak_reduction") == [(15.0,)]


def test_response_reports(spark):
    hourly = hourly_frame(spark, {"2024-01-01 15:00": 100, "2024-01-01 18:00": 20})
    responses = event_response_scenarios(hourly, event_date="2024-01-01")
    summary = reports.report_response_summary(responses)
    assert values(summary, "simulated_events", "events_meeting_target", "target_achievement_rate") == [(1, 1, 1.0)]
    assert values(reports.report_response_components(responses)) == [
        ("Baseline event load", 100.0), ("Rebound load", 15.0), ("Simulated event load", 85.0),
    ]
    assert values(reports.report_response_top(responses), "achieved_reduction") == [(15.0,)]
    assert values(questions.events_meeting_target(responses)) == [(1, 1)]
    totals = reports.report_response_totals(summary).first().asDict()
    assert (totals["simulated_events"], totals["target_achievement_rate"], totals["achieved_reduction"]) == (1, 1.0, 15.0)


def test_response_reports_without_events(spark):
    none = event_response_scenarios(hourly_frame(spark, {"2024-01-01 15:00": 1}), event_date="2023-01-01")
    assert set(reports.report_response_totals(reports.report_response_summary(none)).first().asDict().values()) == {0, 0.0}
    assert values(reports.report_response_components(none), "total_consumption") == [(None,)] * 3


def test_sql_files_run_in_name_order(spark, tmp_path, monthly):
    monthly.createOrReplaceTempView("report_months")
    (tmp_path / "b.sql").write_text("SELECT count(*) AS n FROM report_months;\n", encoding="utf-8")
    (tmp_path / "a.sql").write_text("SELECT * FROM report_months WHERE campus_id = 2", encoding="utf-8")
    results = marts.run_sql_reports(spark, tmp_path)
    assert list(results) == ["a", "b"]
    assert (results["a"].count(), values(results["b"])) == (1, [(3,)])
    with pytest.raises(FileNotFoundError):
        marts.run_sql_reports(spark, tmp_path / "none")
    assert values(marts.save_sql_reports(spark, tmp_path)) == [("report", "a", 1), ("report", "b", 1)]
    assert values(spark.table("report.b")) == [(3,)]


def test_the_shipped_sql_files_equal_the_functions(spark, monthly, emissions, peaks):
    tables = {
        "gold_monthly_electricity_usage": monthly, "gold_electricity_emissions": emissions, "gold_peak_demand": peaks,
    }
    results = marts.run_sql_reports(spark, Path(marts.__file__).parent / "sql", tables)
    assert {name: frame.collect() for name, frame in results.items()} == {
        "top_monthly_usage": marts.top_monthly_usage(monthly).collect(),
        "peak_demand_by_meter": marts.peak_demand_by_meter(peaks).collect(),
        "monthly_emissions_summary": marts.monthly_emissions_summary(emissions).collect(),
        "source_usage_summary": marts.source_usage_summary(monthly).collect(),
    }


def test_questions_name_their_tables(monthly, peaks):
    assert set(questions.QUESTIONS) == {
        "table_row_count", "top_peak_demand", "top_monthly_usage", "top_high_usage",
        "events_meeting_target", "rows_per_match_status",
    }
    assert values(questions.table_row_count(monthly)) == [(3,)]
    assert [row.meter_id for row in questions.top_peak_demand(peaks).collect()] == [21, 20]
    assert questions.top_monthly_usage(monthly).first().total_consumption == 150.0
