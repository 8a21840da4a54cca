"""Small frames for the tests."""

from datetime import datetime

from gridmill.names import BUILDING

HOURLY = (
    "campus_id bigint, source_system string, meter_id bigint, building_id bigint, usage_hour timestamp_ntz, "
    "total_consumption double, reading_count bigint, first_reading_timestamp timestamp_ntz, "
    "last_reading_timestamp timestamp_ntz"
)
DAILY = (
    "campus_id bigint, source_system string, usage_date date, total_consumption double, "
    "reading_count bigint, meter_count bigint"
)
MONTHLY = (
    "campus_id bigint, source_system string, usage_month date, total_consumption double, "
    "reading_count bigint, max_daily_meter_count bigint"
)


def at(text):
    return datetime.fromisoformat(text)


def hourly_frame(spark, loads, campus=1, source=BUILDING, meter=10, building=None):
    """Hourly usage from {"2024-01-01 08:00": kWh} for one meter."""
    rows = [
        (campus, source, meter, building, at(hour), float(load), 1, at(hour), at(hour))
        for hour, load in loads.items()
    ]
    return spark.createDataFrame(rows, HOURLY)


def values(df, *columns):
    """Rows as tuples, sorted with NULL last."""
    picked = df.select(*columns) if columns else df
    return sorted(map(tuple, picked.collect()), key=lambda row: [(v is None, 0 if v is None else v) for v in row])
