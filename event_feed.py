"""Meter, weather and reference feeds projected from general event, supplier and region tables.

Event types play the meters: ``view`` and ``signup`` building meters, ``purchase`` grid connections,
``click`` submeters, ``error`` weather stations. Every event is used. The days of the one month of events
are dealt over three months and one month ten years before, so that there are months to compare, and
usage older than any factor that is no default. Loads are whole watt-hours, so sums do not depend on order.
Quarter-hour rounding makes repeated keys; small values make negative loads, every 97th event a missing
load, every 101st grid reading a campus id that is not a number, and some observations have no
air temperature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions import floor_time, floor_to_hour
from gridmill.names import BUILDING, NMI
from gridmill.sources.reference import FACTOR_COLUMNS, INTENSITY_COLUMNS

# Schemas of the test tables; giving them saves a look at the files before each query.
TABLE_SCHEMAS = {
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "pages": "page_id bigint, url string, html string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "region": "r_regionkey int, r_name string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def spread_months(events: DataFrame) -> DataFrame:
    """The events with their times moved by whole months."""
    event = F.col("event_id")
    months = F.when(event % 11 == 0, -114).when(event % 4 == 1, 1).when(event % 12 == 3, 2).otherwise(0).cast("int")
    return events.withColumn("ts", F.col("ts") + F.make_ym_interval(F.lit(0), months))


def _campus() -> Column:
    """Campus 2 has half of the users and more, so that its hours have readings to compare."""
    return F.when(F.col("user_id") % 2 == 0, 2).otherwise(1 + F.shiftright("user_id", 1) % 5)


def _meter() -> Column:
    """Meter 0 takes a third of all readings, the other meters share the rest."""
    return F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id") % 40)


def _load() -> Column:
    return F.when(F.col("event_id") % 97 != 0, F.round(F.col("value") * 100) - 100)


def _reading(events: DataFrame, kinds: list[str], *columns: Column) -> DataFrame:
    return events.where(F.col("event_type").isin(kinds)).select(
        *columns, floor_time("ts", "15 minutes").alias("timestamp"), _load().alias("consumption"),
        "event_id", "value",
    )


def building_feed(events: DataFrame) -> DataFrame:
    meter = _meter().alias("meter_id")
    return _reading(events, ["view", "signup"], _campus().alias("campus_id"), meter).drop("event_id", "value")


def nmi_feed(events: DataFrame) -> DataFrame:
    campus = F.when(F.col("event_id") % 101 == 0, "N/A").otherwise(_campus().cast("string"))
    return (
        _reading(events, ["purchase"], campus.alias("campus_id"), _meter().alias("meter_id"))
        .withColumns({"demand_kW": F.col("consumption") * 4, "demand_kVA": F.col("consumption") * 4.2})
        .drop("event_id", "value")
    )


def submeter_feed(events: DataFrame) -> DataFrame:
    return (
        _reading(
            events, ["click"], _campus().alias("campus_id"),
            (F.col("user_id") % 8).alias("building_id"), _meter().alias("id"),
        )
        .withColumns(
            {
                "current": F.col("value") / 240,
                "voltage": F.lit(240.0),
                "power": F.col("value"),
                "power_factor": F.lit(0.95),
            }
        )
        .drop("event_id", "value")
    )


def weather_feed(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    air = F.when(k % 13 != 0, (15 + k % 10).cast("double"))
    return events.where("event_type = 'error'").select(
        _campus().alias("campus_id"),
        F.col("ts").alias("timestamp"),
        air.alias("air_temperature"),
        (14 + k % 10).cast("double").alias("apparent_temperature"),
        k.cast("double").alias("relative_humidity"),
    )


def campus_meta_feed(region: DataFrame) -> DataFrame:
    """Campuses 0 to 4; campus 5 has readings but no metadata."""
    return region.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))


def factor_text_feed(supplier: DataFrame) -> DataFrame:
    """One emissions factor per supplier, as the text a CSV file would hold."""
    key = F.col("s_suppkey")
    values = {
        "factor_id": F.concat(F.lit("factor_"), key.cast("string")),
        "country": F.when(F.col("s_nationkey") < 20, "Australia").otherwise("New Zealand"),
        "region": F.concat(F.lit("region_"), F.col("s_nationkey").cast("string")),
        "source_system": F.when(key % 3 == 0, "*").when(key % 3 == 1, BUILDING).otherwise(NMI),
        "energy_type": F.when(key % 5 == 0, "gas").otherwise("electricity"),
        "factor_year": (2015 + key % 15).cast("string"),
        "emissions_factor_kg_co2e_per_kwh": F.concat(F.lit("0."), (20 + key % 60).cast("string")),
        "factor_source_name": F.col("s_name"),
        "factor_source_url": F.lit(""),
        # No wildcard factor is a default, so submeters have none in the oldest month.
        "is_default": F.when(key % 3 == 0, "no").otherwise(
            F.element_at(F.array(*map(F.lit, ("TRUE", "no", "Yes", "false", "1", "0", ""))), (key % 7 + 1).cast("int"))
        ),
        "notes": F.concat(F.lit("Factor of "), F.col("s_name")),
    }
    return supplier.select(*[values[name].alias(name) for name in FACTOR_COLUMNS])


def _intensity_text(hours: DataFrame, value: Column) -> DataFrame:
    """Intensity rows as text: starts without an offset, ends in local time with one."""
    local_end = F.timestamp_add("HOUR", F.lit(11), F.col("hour"))
    values = {
        "region_code": F.col("region_code"),
        "region_name": F.when(F.col("region_code") == "VIC1", "Victoria").otherwise("New South Wales"),
        "interval_start": F.col("hour").cast("string"),
        "interval_end": F.concat(local_end.cast("string"), F.lit("+10:00")),
        "emissions_intensity_kg_co2e_per_kwh": value,
        "source_name": F.concat(F.lit("Grid feed "), F.col("region_code")),
        "source_url": F.lit(""),
        "data_version": F.lit("1"),
        "notes": F.when(F.hour("hour") < 12, "Synthetic morning row").otherwise("Afternoon row"),
    }
    return hours.select(*[values[name].alias(name) for name in INTENSITY_COLUMNS])


def _station_hours(events: DataFrame) -> DataFrame:
    """Few stations lie in the first region, so many of its hours have no value."""
    return events.where("event_type = 'error'").select(
        F.when(F.col("user_id") % 20 == 0, "VIC1").otherwise("NSW1").alias("region_code"),
        floor_to_hour("ts").alias("hour"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def intensity_text_feed(events: DataFrame) -> DataFrame:
    """One valid row per region and observed hour."""
    by_hour = _station_hours(events).groupBy("region_code", "hour").agg(F.min("k").alias("k"))
    return _intensity_text(by_hour, F.concat(F.lit("0."), (10 + F.col("k") % 80).cast("string")))


def dirty_intensity_text_feed(events: DataFrame) -> DataFrame:
    """One row per observation: repeated hours, text that is no number, negative numbers."""
    k = F.col("k")
    value = F.when(k % 7 == 0, "n/a").when(k % 11 == 0, "-0.5").otherwise(F.concat(F.lit("0."), k.cast("string")))
    return _intensity_text(_station_hours(events), value)


def page_markdown(pages: DataFrame) -> DataFrame:
    """Web pages as markdown text: headings, paragraphs, no other tags."""
    text = F.col("html")
    for pattern, replacement in (
        (r"<h[1-6]>", "\n# "),
        (r"</h[1-6]>", "\n"),
        (r"<br>|</p>|</div>|</li>", "\n\n"),
        (r"<[^>]*>", ""),
    ):
        text = F.regexp_replace(text, pattern, replacement)
    return pages.select("page_id", text.alias("text"))


def event_setting_feed(lineitem: DataFrame) -> DataFrame:
    """Planned events, one per order line; some end before they start or have shares above one."""
    day = F.dayofyear("l_shipdate")
    return lineitem.select(
        "l_orderkey", "l_linenumber", (day % 20).alias("start_hour"),
        (day % 20 + F.col("l_linenumber") - 2).alias("end_hour"),
        F.when(F.col("l_quantity") > 3, F.col("l_discount")).otherwise(F.col("l_quantity")).alias("target_percent"),
        F.when(F.col("l_returnflag") == "R", -F.col("l_tax")).otherwise(F.col("l_tax")).alias("flexible_percent"),
        (F.col("l_partkey") % 5).alias("rebound_hours"),
    )
