from statistics import median

import pytest

from gridmill.operators.baseline import hourly_weather, weather_baseline, weather_baseline_stats

from helpers import at, hourly_frame, values

WEATHER = (
    "campus_id bigint, timestamp timestamp_ntz, apparent_temperature double, air_temperature double, "
    "dew_point_temperature double, relative_humidity double, wind_speed string, wind_direction string"
)
MONDAYS = ("2024-01-01 08:00", "2024-01-08 08:00", "2024-01-15 08:00")


def weather(spark, temperatures):
    rows = [(1, at(t), air and air - 1, air, 5.0, 50.0, None, None) for t, air in temperatures]
    return hourly_weather(spark.createDataFrame(rows, WEATHER))


def scored(spark, loads, temperatures):
    return weather_baseline(hourly_frame(spark, loads), weather(spark, temperatures))


def test_hourly_weather_averages_known_temperatures(spark):
    result = weather(
        spark, [("2024-01-01 08:00", 20.0), ("2024-01-01 08:30", 22.0), ("2024-01-01 08:45", None)]
    )
    assert values(result) == [(1, at("2024-01-01 08:00"), 21.0, 20.0, 50.0)]


def test_median_is_the_expectation(spark):
    result = scored(spark, dict(zip(MONDAYS, (100, 100, 200))), [(m, 20.0) for m in MONDAYS])
    picked = values(
        result, "usage_hour", "expected_consumption", "residual_consumption", "residual_percent",
        "is_high_usage_candidate", "efficiency_opportunity_score",
    )
    assert picked[-1] == (at(MONDAYS[2]), 100.0, 100.0, 1.0, True, 100.0)
    assert picked[0] == (at(MONDAYS[0]), 100.0, 0.0, 0.0, False, 0.0)
    assert values(weather_baseline_stats(result)) == [(3, 1)]


def test_calendar_parts_and_band(spark):
    row = scored(spark, {"2024-01-07 23:00": 1}, [("2024-01-07 23:59", 19.99)]).first()
    assert (row.hour_of_day, row.day_of_week, row.usage_month_number, row.temperature_band_c) == (23, 0, 1, 15.0)
    below_zero = scored(spark, {"2024-01-07 23:00": 1}, [("2024-01-07 23:59", -0.5)]).first()
    assert below_zero.temperature_band_c == -5.0


def test_bands_are_apart(spark):
    result = scored(spark, dict(zip(MONDAYS, (100, 300, 200))), list(zip(MONDAYS, (20.0, 25.0, 24.9))))
    assert [e for _, e in values(result, "usage_hour", "expected_consumption")] == [150.0, 300.0, 150.0]


def test_hours_without_weather_and_negative_usage_drop(spark):
    result = scored(spark, dict(zip(MONDAYS, (100, -5, 200))), [(MONDAYS[0], 20.0), (MONDAYS[1], 20.0)])
    assert values(result, "usage_hour") == [(at(MONDAYS[0]),)]


def test_zero_expectation_has_no_percent(spark):
    result = scored(spark, dict(zip(MONDAYS, (0, 0, 9))), [(m, 20.0) for m in MONDAYS])
    assert values(result, "residual_percent", "is_high_usage_candidate", "efficiency_opportunity_score") == [
        (None, False, 0.0)
    ] * 3


@pytest.mark.parametrize(("load", "flag", "score"), [(125, True, 25.0), (124, False, 24.0), (500, True, 100.0)])
def test_threshold_and_score_ceiling(spark, load, flag, score):
    result = scored(spark, dict(zip(MONDAYS, (100, 100, load))), [(m, 20.0) for m in MONDAYS])
    row = result.where("usage_date = '2024-01-15'").first()
    assert (row.is_high_usage_candidate, row.efficiency_opportunity_score) == (flag, score)


def test_missing_building_is_a_group_of_its_own(spark):
    usage = (
        hourly_frame(spark, {MONDAYS[0]: 100, MONDAYS[1]: 200})
        .unionByName(hourly_frame(spark, {MONDAYS[0]: 10}, building=-1))
    )
    result = weather_baseline(usage, weather(spark, [(m, 20.0) for m in MONDAYS]))
    assert values(result, "building_id", "expected_consumption") == [(-1, 10.0), (None, 150.0), (None, 150.0)]


def test_median_equals_brute_force(spark):
    loads = {f"2024-{m:02d}-{d:02d} {h:02d}:00": (m * 31 + d * 7 + h * 3) % 97 for m in (1, 2) for d in range(1, 29) for h in (7, 8)}
    temps = {t: 10.0 + (v % 3) * 6 for t, v in loads.items()}
    result = scored(spark, loads, list(temps.items()))
    groups = {}
    for t, load in loads.items():
        when = at(t)
        groups.setdefault((when.hour, when.weekday(), when.month, temps[t] // 5), []).append(load)
    for row in result.collect():
        key = (row.usage_hour.hour, row.usage_hour.weekday(), row.usage_hour.month, row.air_temperature // 5)
        assert row.expected_consumption == median(groups[key])
