from datetime import date

from gridmill.names import BUILDING, NMI, SUBMETER
from gridmill.operators.usage import daily_usage, hourly_usage, monthly_usage, peak_demand

from helpers import at, values

SILVER = "campus_id bigint, meter_id bigint, reading_timestamp timestamp_ntz, consumption double, source_system string"
SILVER_NMI = (
    "campus_id bigint, meter_id bigint, reading_timestamp timestamp_ntz, consumption double, "
    "demand_kw double, demand_kva double, source_system string"
)
SILVER_SUB = (
    "campus_id bigint, building_id bigint, meter_id bigint, reading_timestamp timestamp_ntz, "
    "consumption double, source_system string"
)


def silver(spark):
    building = spark.createDataFrame(
        [(1, 10, at("2024-01-01 00:00"), 12.5, BUILDING), (1, 10, at("2024-01-01 00:15"), 12.5, BUILDING)], SILVER
    )
    nmi = spark.createDataFrame(
        [
            (1, 20, at("2024-01-01 00:00"), 50.0, 80.0, 81.0, NMI),
            (1, 20, at("2024-01-01 00:15"), 60.0, 90.0, 91.0, NMI),
            (1, 20, at("2024-01-02 00:15"), 61.0, 90.0, 92.0, NMI),
        ],
        SILVER_NMI,
    )
    submeter = spark.createDataFrame([(1, 7, 30, at("2024-02-01 23:59"), 4.0, SUBMETER)], SILVER_SUB)
    return building, nmi, submeter


def test_hourly_sums_and_bounds(spark):
    hourly = hourly_usage(*silver(spark))
    assert hourly.columns == [
        "campus_id", "source_system", "meter_id", "building_id", "usage_hour", "total_consumption",
        "reading_count", "first_reading_timestamp", "last_reading_timestamp",
    ]
    t0, t1 = at("2024-01-01 00:00"), at("2024-01-01 00:15")
    assert (1, BUILDING, 10, None, t0, 25.0, 2, t0, t1) in values(hourly)
    assert values(hourly.where("building_id = 7"), "usage_hour") == [(at("2024-02-01 23:00"),)]


def test_daily_counts_distinct_meters(spark):
    building, nmi, submeter = silver(spark)
    more = spark.createDataFrame([(1, 11, at("2024-01-01 05:00"), 1.0, BUILDING)], SILVER)
    daily = daily_usage(hourly_usage(building.unionByName(more), nmi, submeter))
    assert (1, BUILDING, date(2024, 1, 1), 26.0, 3, 2) in values(daily)


def test_monthly_takes_highest_daily_meter_count(spark):
    monthly = monthly_usage(daily_usage(hourly_usage(*silver(spark))))
    assert values(monthly) == [
        (1, BUILDING, date(2024, 1, 1), 25.0, 2, 1),
        (1, SUBMETER, date(2024, 2, 1), 4.0, 1, 1),
        (1, NMI, date(2024, 1, 1), 171.0, 3, 1),
    ]


def test_peak_demand_takes_highest_then_earliest(spark):
    peaks = peak_demand(silver(spark)[1])
    assert values(peaks) == [(1, 20, at("2024-01-01 00:15"), 90.0, 91.0, 60.0)]


def test_roll_ups_conserve_usage(spark):
    hourly = hourly_usage(*silver(spark))
    daily = daily_usage(hourly)
    monthly = monthly_usage(daily)
    totals = [df.selectExpr("sum(total_consumption)", "sum(reading_count)").first() for df in (hourly, daily, monthly)]
    assert totals[0] == totals[1] == totals[2]


def test_hour_does_not_move_in_a_clock_change(spark):
    """02:30 does not exist on this day in New York; zone-less readings keep it."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        building = spark.createDataFrame([(1, 10, at("2024-03-10 02:30"), 1.0, BUILDING)], SILVER)
        _, nmi, submeter = silver(spark)
        hours = values(hourly_usage(building, nmi, submeter).where("meter_id = 10"), "usage_hour")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert hours == [(at("2024-03-10 02:00"),)]
