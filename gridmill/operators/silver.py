"""Silver readings: filter, type and de-duplicate raw interval readings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from gridmill.functions import utc_from_instant
from gridmill.names import BUILDING, NMI, SUBMETER


def clean_readings(
    raw: DataFrame,
    columns: Mapping[str, Column],
    keys: Sequence[str],
    tie_order: Sequence[str],
    source_system: str,
) -> DataFrame:
    """Typed readings without missing or negative values, one row per key.

    ``columns`` maps each output name to its typed expression over ``raw``; all of them are
    required. Of several rows for a key the lowest in ``tie_order`` wins, which names every
    non-key column. Taking the minimum is an aggregate and not a ranking, so copies collapse on
    the map side: a key repeated in a third of all rows sends one row per input task.
    """
    typed = raw.select(*[expression.alias(name) for name, expression in columns.items()])
    valid = typed.where((F.col("consumption") >= 0) & _all_present(columns))
    if len(tie_order) == 1:
        lowest = valid.groupBy(*keys).agg(F.min(tie_order[0]).alias(tie_order[0]))
    else:
        lowest = (
            valid.groupBy(*keys)
            .agg(F.min(F.struct(*tie_order)).alias("reading"))
            .select(*keys, "reading.*")
        )
    return lowest.select(*columns, F.lit(source_system).alias("source_system"))


def _all_present(names) -> Column:
    present = F.lit(True)
    for name in names:
        present = present & F.col(name).isNotNull()
    return present


def _typed(types: Mapping[str, str], renamed: Mapping[str, str] | None = None) -> dict[str, Column]:
    renamed = renamed or {}
    return {name: F.col(renamed.get(name, name)).cast(kind) for name, kind in types.items()}


def _wall_clock(raw: DataFrame, time_zone: str | None) -> Column:
    """Reading time without a zone; instants take the clock of ``time_zone``, or of the session."""
    moment = F.col("timestamp")
    if time_zone and isinstance(raw.schema["timestamp"].dataType, TimestampType):
        return F.convert_timezone(F.lit("UTC"), F.lit(time_zone), utc_from_instant(moment))
    return moment.cast("timestamp_ntz")


def clean_building_readings(raw: DataFrame, time_zone: str | None = None) -> DataFrame:
    """Building meter readings, one per campus, meter and time."""
    columns = _typed(
        {"campus_id": "long", "meter_id": "long", "reading_timestamp": "timestamp_ntz", "consumption": "double"},
        {"reading_timestamp": "timestamp"},
    )
    columns["reading_timestamp"] = _wall_clock(raw, time_zone)
    keys = ["campus_id", "meter_id", "reading_timestamp"]
    return clean_readings(raw, columns, keys, ["consumption"], BUILDING)


def clean_nmi_readings(raw: DataFrame, time_zone: str | None = None) -> DataFrame:
    """Grid-connection readings; a campus id that is not a number drops the row."""
    columns = _typed(
        {
            "campus_id": "long",
            "meter_id": "long",
            "reading_timestamp": "timestamp_ntz",
            "consumption": "double",
            "demand_kw": "double",
            "demand_kva": "double",
        },
        {"reading_timestamp": "timestamp", "demand_kw": "demand_kW", "demand_kva": "demand_kVA"},
    )
    columns["reading_timestamp"] = _wall_clock(raw, time_zone)
    text = F.col("campus_id").cast("string")
    # "4.0" is campus 4 too; the decimal is only tried where the text is no whole number.
    from_decimal = F.round(text.try_cast("decimal(38,6)")).try_cast("long")
    columns["campus_id"] = F.coalesce(text.try_cast("long"), from_decimal)
    keys = ["campus_id", "meter_id", "reading_timestamp"]
    return clean_readings(raw, columns, keys, ["consumption", "demand_kw", "demand_kva"], NMI)


def clean_submeter_readings(raw: DataFrame, time_zone: str | None = None) -> DataFrame:
    """Submeter readings, one per campus, building, meter and time."""
    columns = _typed(
        {
            "campus_id": "long",
            "building_id": "long",
            "meter_id": "long",
            "reading_timestamp": "timestamp_ntz",
            "consumption": "double",
            "current": "double",
            "voltage": "double",
            "power": "double",
            "power_factor": "double",
        },
        {"meter_id": "id", "reading_timestamp": "timestamp"},
    )
    columns["reading_timestamp"] = _wall_clock(raw, time_zone)
    keys = ["campus_id", "building_id", "meter_id", "reading_timestamp"]
    # Consumption and power decide; the rest only makes the choice among equals repeatable.
    tie_order = ["consumption", "power", "current", "voltage", "power_factor"]
    return clean_readings(raw, columns, keys, tie_order, SUBMETER)
