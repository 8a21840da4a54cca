from datetime import datetime

from gridmill.operators.silver import clean_building_readings, clean_nmi_readings, clean_submeter_readings

from helpers import at, values

BUILDING = "campus_id bigint, meter_id bigint, timestamp timestamp_ntz, consumption double"
NMI = (
    "campus_id string, meter_id bigint, timestamp timestamp_ntz, consumption double, "
    "demand_kW double, demand_kVA double"
)
SUBMETER = (
    "building_id bigint, id bigint, campus_id bigint, timestamp timestamp_ntz, consumption double, "
    "current double, voltage double, power double, power_factor double"
)
T0, T1 = at("2024-01-01 00:00"), at("2024-01-01 00:15")


def test_building_drops_negatives_and_copies(spark):
    raw = spark.createDataFrame([(1, 10, T0, 12.5), (1, 10, T0, 12.5), (1, 10, T1, -1.0)], BUILDING)
    assert values(clean_building_readings(raw)) == [(1, 10, T0, 12.5, "building_consumption")]


def test_building_keeps_lowest_and_requires_every_field(spark):
    raw = spark.createDataFrame(
        [(1, 10, T0, 9.0), (1, 10, T0, 7.0), (None, 10, T0, 1.0), (1, None, T0, 1.0), (1, 10, None, 1.0),
         (1, 10, T1, None), (2, 10, T0, 0.0)],
        BUILDING,
    )
    assert values(clean_building_readings(raw), "campus_id", "consumption") == [(1, 7.0), (2, 0.0)]


def test_building_accepts_text_columns(spark):
    raw = spark.createDataFrame(
        [("1", "10", "2024-01-01 00:00:00", "3.5")],
        "campus_id string, meter_id string, timestamp string, consumption string",
    )
    assert values(clean_building_readings(raw)) == [(1, 10, T0, 3.5, "building_consumption")]


def test_nmi_drops_unreadable_campus_and_missing_demand(spark):
    raw = spark.createDataFrame(
        [("1", 20, T0, 50.0, 200.0, 210.0), ("N/A", 20, T0, 50.0, 200.0, 210.0), ("1", 20, T1, 5.0, None, 1.0)],
        NMI,
    )
    assert values(clean_nmi_readings(raw)) == [(1, 20, T0, 50.0, 200.0, 210.0, "nmi_consumption")]


def test_nmi_tie_order(spark):
    raw = spark.createDataFrame(
        [("1", 20, T0, 50.0, 9.0, 1.0), ("1", 20, T0, 50.0, 8.0, 7.0), ("1", 20, T0, 50.0, 8.0, 6.0)], NMI
    )
    assert values(clean_nmi_readings(raw), "demand_kw", "demand_kva") == [(8.0, 6.0)]


def test_nmi_joins_campus_spellings_of_one_number(spark):
    raw = spark.createDataFrame([("1", 20, T0, 5.0, 1.0, 1.0), ("01", 20, T0, 4.0, 1.0, 1.0)], NMI)
    assert values(clean_nmi_readings(raw), "campus_id", "consumption") == [(1, 4.0)]


def test_nmi_reads_decimal_campus_text(spark):
    rows = [(text, i, T0, 5.0, 1.0, 1.0) for i, text in enumerate(("4.0", " 7 ", "2.6", "x", "", "9d"))]
    result = clean_nmi_readings(spark.createDataFrame(rows, NMI))
    assert values(result, "meter_id", "campus_id") == [(0, 4), (1, 7), (2, 3)]


def test_submeter_copies_and_missing_building(spark):
    row = (5, 30, 1, T0, 2.0, 1.0, 240.0, 3.0, 0.9)
    raw = spark.createDataFrame([row, row, (None, *row[1:])], SUBMETER)
    result = clean_submeter_readings(raw)
    assert result.columns == [
        "campus_id", "building_id", "meter_id", "reading_timestamp", "consumption", "current", "voltage",
        "power", "power_factor", "source_system",
    ]
    assert values(result) == [(1, 5, 30, T0, 2.0, 1.0, 240.0, 3.0, 0.9, "building_submeter_consumption")]


def test_submeter_tie_goes_to_lowest_power(spark):
    raw = spark.createDataFrame(
        [(5, 30, 1, T0, 2.0, 1.0, 240.0, 3.0, 0.9), (5, 30, 1, T0, 2.0, 9.0, 230.0, 2.0, 0.8)], SUBMETER
    )
    assert values(clean_submeter_readings(raw), "power", "current") == [(2.0, 9.0)]


def test_instants_take_the_clock_of_the_given_zone(spark):
    text = [(5, 30, 1, "2024-01-01T00:15:00+11:00", 2.0, 1.0, 240.0, 3.0, 0.9)]
    raw = spark.createDataFrame(text, SUBMETER.replace("timestamp timestamp_ntz", "timestamp string"))
    raw = raw.withColumn("timestamp", raw.timestamp.cast("timestamp_ltz"))
    moments = [values(clean_submeter_readings(raw, zone), "reading_timestamp") for zone in ("Australia/Melbourne", "UTC", None)]
    assert moments == [[(T1,)], [(at("2023-12-31 13:15"),)], [(at("2023-12-31 13:15"),)]]


def test_one_key_with_most_rows_collapses_before_the_shuffle(spark):
    hot = spark.range(20000).selectExpr(
        "1L AS campus_id", "10L AS meter_id", "timestamp_ntz'2024-01-01 00:00:00' AS timestamp",
        "cast(id + 3 AS double) AS consumption",
    )
    cleaned = clean_building_readings(hot)
    assert values(cleaned, "consumption", "reading_timestamp") == [(3.0, datetime(2024, 1, 1))]
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_empty_input(spark):
    assert values(clean_building_readings(spark.createDataFrame([], BUILDING))) == []
