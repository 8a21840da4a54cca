"""Operators against plain Python on random small inputs full of ties, gaps and missing values."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest

from gridmill.names import BUILDING, NMI, SUBMETER
from gridmill.operators.emissions import emissions_monthly
from gridmill.operators.scenarios import event_response_scenarios, shift_scenarios
from gridmill.operators.silver import clean_building_readings, clean_nmi_readings, clean_submeter_readings
from gridmill.operators.usage import daily_usage, hourly_usage, monthly_usage, peak_demand

from helpers import MONTHLY, values
from test_silver import BUILDING as RAW_BUILDING
from test_silver import NMI as RAW_NMI
from test_silver import SUBMETER as RAW_SUBMETER

START = datetime(2024, 1, 30)


def some(rng, *options):
    return rng.choice(options)


def raw_rows(seed):
    rng = random.Random(seed)

    def moment():
        return None if rng.random() < 0.03 else START + timedelta(minutes=15 * rng.randrange(0, 4 * 24 * 3))

    def load():
        return None if rng.random() < 0.05 else float(rng.randrange(-2, 12))

    building = [(some(rng, 1, 1, 2, None), some(rng, 10, 10, 10, 11), moment(), load()) for _ in range(900)]
    nmi = [
        (some(rng, "1", "1", "2", "N/A"), some(rng, 20, 21), moment(), load(), some(rng, 5.0, 6.0, None), some(rng, 5.0, 7.0))
        for _ in range(700)
    ]
    submeter = [
        (some(rng, 5, 6, None), 30, some(rng, 1, 2), moment(), load(), 1.0, some(rng, 230.0, 240.0), some(rng, 3.0, 4.0), 0.9)
        for _ in range(700)
    ]
    return building, nmi, submeter


def lowest(rows, keys, tie_order):
    """Complete non-negative rows, the lowest per key."""
    best = {}
    for row in rows:
        if None in row.values() or row["consumption"] < 0:
            continue
        key = tuple(row[k] for k in keys)
        rank = tuple(row[t] for t in tie_order)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, row)
    return [row for _, row in best.values()]


@pytest.fixture(scope="module", params=[1, 2])
def case(request, spark):
    building, nmi, submeter = raw_rows(request.param)
    frames = (
        clean_building_readings(spark.createDataFrame(building, RAW_BUILDING)),
        clean_nmi_readings(spark.createDataFrame(nmi, RAW_NMI)),
        clean_submeter_readings(spark.createDataFrame(submeter, RAW_SUBMETER)),
    )
    names = (
        ("campus_id", "meter_id", "reading_timestamp", "consumption"),
        ("campus_id", "meter_id", "reading_timestamp", "consumption", "demand_kw", "demand_kva"),
        (
            "building_id", "meter_id", "campus_id", "reading_timestamp", "consumption", "current", "voltage",
            "power", "power_factor",
        ),
    )
    rows = [[dict(zip(columns, row)) for row in source] for columns, source in zip(names, (building, nmi, submeter))]
    for row in rows[1]:
        row["campus_id"] = int(row["campus_id"]) if row["campus_id"].isdigit() else None
    key = ("campus_id", "meter_id", "reading_timestamp")
    expected = [
        lowest(rows[0], key, ("consumption",)),
        lowest(rows[1], key, ("consumption", "demand_kw", "demand_kva")),
        lowest(rows[2], (*key, "building_id"), ("consumption", "power", "current", "voltage", "power_factor")),
    ]
    return frames, expected, hourly_usage(*frames).persist()


def hourly_by_hand(expected):
    groups = defaultdict(list)
    for source, rows in zip((BUILDING, NMI, SUBMETER), expected):
        for row in rows:
            hour = row["reading_timestamp"].replace(minute=0)
            groups[row["campus_id"], source, row["meter_id"], row.get("building_id"), hour].append(row)
    return {key: sum(r["consumption"] for r in rows) for key, rows in groups.items()}


def test_silver(case):
    for frame, rows in zip(*case[:2]):
        columns = [c for c in frame.columns if c != "source_system"]
        assert values(frame, *columns) == sorted(tuple(row[c] for c in columns) for row in rows)


def test_roll_ups(case):
    _, expected, hourly = case
    loads = hourly_by_hand(expected)
    keys = ("campus_id", "source_system", "meter_id", "building_id", "usage_hour")
    found = {tuple(row[k] for k in keys): row.total_consumption for row in hourly.collect()}
    assert found == loads
    days, meters = defaultdict(float), defaultdict(set)
    for (campus, source, meter, _, hour), load in loads.items():
        days[campus, source, hour.date()] += load
        meters[campus, source, hour.date()].add(meter)
    daily = daily_usage(hourly)
    assert values(daily, "campus_id", "source_system", "usage_date", "total_consumption", "meter_count") == sorted(
        (*key, load, len(meters[key])) for key, load in days.items()
    )
    months, most = defaultdict(float), defaultdict(int)
    for (campus, source, day), load in days.items():
        key = (campus, source, day.replace(day=1))
        months[key] += load
        most[key] = max(most[key], len(meters[campus, source, day]))
    monthly = monthly_usage(daily)
    assert values(
        monthly, "campus_id", "source_system", "usage_month", "total_consumption", "max_daily_meter_count"
    ) == sorted((*key, load, most[key]) for key, load in months.items())


def test_peaks(case):
    frames, expected, _ = case
    best = {}
    for row in expected[1]:
        key, rank = (row["campus_id"], row["meter_id"]), (-row["demand_kw"], row["reading_timestamp"])
        best[key] = min(best.get(key, rank), rank)
    assert values(peak_demand(frames[1]), "campus_id", "meter_id", "peak_demand_kw", "peak_timestamp") == sorted(
        (*key, -kw, moment) for key, (kw, moment) in best.items()
    )


def test_load_shift(case):
    _, expected, hourly = case
    days = defaultdict(dict)
    for (campus, source, meter, building, hour), load in hourly_by_hand(expected).items():
        days[campus, source, meter, building, hour.date()][hour] = load
    rows = []
    for key, loads in days.items():
        peak_hour = min(loads, key=lambda hour: (-loads[hour], hour))
        low_hour = min(loads, key=lambda hour: (loads[hour], hour))
        if peak_hour == low_hour or abs(peak_hour.hour - low_hour.hour) > 4:
            continue
        for percent in (0.05, 0.10, 0.15):
            peak, low = loads[peak_hour], loads[low_hour]
            new_peak = max(peak - peak * percent, low + peak * percent)
            if new_peak <= peak:
                rows.append((*key, percent, peak_hour, low_hour, peak - new_peak))
    found = values(
        shift_scenarios(hourly), "campus_id", "source_system", "meter_id", "building_id", "simulation_date",
        "flexible_load_percent", "peak_hour", "target_hour", "peak_reduction",
    )
    assert len(rows) > 10
    assert found == sorted(rows, key=lambda row: [(v is None, 0 if v is None else v) for v in row])


def test_event_response(case):
    _, expected, hourly = case
    day = date(2024, 1, 31)
    base, after = defaultdict(float), defaultdict(float)
    for (*meter, hour), load in hourly_by_hand(expected).items():
        if hour.date() == day and 20 <= hour.hour < 22:
            base[tuple(meter)] += load
        if hour.date() == day and 22 <= hour.hour < 25:
            after[tuple(meter)] += load
    rows = [(*meter, load, after[meter], load * 0.15) for meter, load in base.items() if load > 0]
    result = event_response_scenarios(hourly, "2024-01-31", 20, 22)
    assert values(
        result, "campus_id", "source_system", "meter_id", "building_id", "baseline_event_consumption",
        "baseline_rebound_consumption", "achieved_reduction",
    ) == sorted(rows, key=lambda row: [(v is None, 0 if v is None else v) for v in row])


@pytest.mark.parametrize("seed", [3, 4])
def test_factor_choice(spark, seed):
    rng = random.Random(seed)
    factors = [
        (
            f"f{i:02d}", some(rng, "Australia", "Australia", "Norway"), "r", some(rng, "*", BUILDING, NMI),
            some(rng, "electricity", "electricity", "gas"), rng.randrange(2020, 2027), rng.randrange(100) / 100,
            "s", "u", rng.random() < 0.3, "n",
        )
        for i in range(60)
    ]
    usage = [
        (campus, source, date(year, 1, 1), float(rng.randrange(1, 99)), 1, 1)
        for campus in (1, 2) for source in (BUILDING, NMI, SUBMETER) for year in range(2018, 2028)
    ]
    rows = []
    for campus, source, month, load, *_ in usage:
        fitting = [
            f for f in factors
            if f[1] == "Australia" and f[4] == "electricity" and f[3] in (source, "*") and (f[5] <= month.year or f[9])
        ]
        if fitting:
            best = min(fitting, key=lambda f: (f[3] != source, f[5] != month.year, f[9], -f[5], f[0]))
            rows.append((campus, source, month, best[0], load * best[6]))
    schema = (
        "factor_id string, country string, region string, source_system string, energy_type string, factor_year int, "
        "emissions_factor_kg_co2e_per_kwh double, factor_source_name string, factor_source_url string, "
        "is_default boolean, notes string"
    )
    result = emissions_monthly(spark.createDataFrame(usage, MONTHLY), spark.createDataFrame(factors, schema))
    assert values(
        result, "campus_id", "source_system", "usage_month", "factor_id", "estimated_emissions_kg_co2e"
    ) == sorted(rows)
