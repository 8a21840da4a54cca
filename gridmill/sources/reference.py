"""Reference files: emissions factors and hourly grid carbon intensity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import count_where, utc_from_text
from gridmill.sources.layers import write_layer

# Columns a reference file must have.
FACTOR_COLUMNS = (
    "factor_id", "country", "region", "source_system", "energy_type", "factor_year",
    "emissions_factor_kg_co2e_per_kwh", "factor_source_name", "factor_source_url", "is_default", "notes",
)
INTENSITY_COLUMNS = (
    "region_code", "region_name", "interval_start", "interval_end",
    "emissions_intensity_kg_co2e_per_kwh", "source_name", "source_url", "data_version", "notes",
)
INTENSITY_SCHEMA = (
    "region_code string, region_name string, interval_start timestamp_ntz, interval_end timestamp_ntz, "
    "interval_start_hour timestamp_ntz, emissions_intensity_kg_co2e_per_kwh double, source_name string, "
    "source_url string, data_version string, is_synthetic boolean, notes string"
)


def _require_columns(df: DataFrame, required: Sequence[str], what: str) -> None:
    absent = [name for name in required if name not in df.columns]
    if absent:
        raise ValueError(f"{what}: no column {' or '.join(absent)}")


def _read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with every column as text and blanks as empty strings, never NULL; quotes may hold line breaks."""
    return spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=True).na.fill("")


def parse_emissions_factors(raw: DataFrame) -> DataFrame:
    """Typed factors from an all-text frame with the required columns."""
    _require_columns(raw, FACTOR_COLUMNS, "Factors")
    return raw.withColumns(
        {
            "factor_year": F.trim("factor_year").cast("int"),
            "emissions_factor_kg_co2e_per_kwh": F.trim("emissions_factor_kg_co2e_per_kwh").cast("double"),
            "is_default": F.lower(F.col("is_default").cast("string")).isin("true", "1", "yes"),
        }
    )


def load_emissions_factors(spark: SparkSession, path: str) -> DataFrame:
    """Read and check an emissions factor CSV file."""
    try:
        raw = _read_text_csv(spark, path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise
    _require_columns(raw, FACTOR_COLUMNS, "Factors")
    unreadable = raw.where(
        F.trim("factor_year").try_cast("int").isNull()
        | F.trim("emissions_factor_kg_co2e_per_kwh").try_cast("double").isNull()
    )
    if not unreadable.isEmpty():
        raise ValueError(f"Factors: a year or a factor in {path} is no number")
    return parse_emissions_factors(raw)


def parse_grid_intensity(raw: DataFrame) -> DataFrame:
    """Typed intensity rows from an all-text frame; unreadable values become NULL."""
    _require_columns(raw, INTENSITY_COLUMNS, "Intensities")
    number = F.trim("emissions_intensity_kg_co2e_per_kwh").try_cast("double")
    typed = raw.withColumns(
        {
            "interval_start": utc_from_text(F.col("interval_start")),
            "interval_end": utc_from_text(F.col("interval_end")),
            "emissions_intensity_kg_co2e_per_kwh": F.when(~F.isnan(number), number),
            "is_synthetic": F.lower("notes").contains("synthetic")
            | F.lower("source_name").contains("synthetic"),
        }
    )
    # A window start would drop rows whose start is NULL; they have to stay, to be reported.
    start = F.col("interval_start")
    into_hour = F.make_dt_interval(F.lit(0), F.lit(0), F.minute(start), F.extract(F.lit("SECOND"), start))
    columns = [field.split()[0] for field in INTENSITY_SCHEMA.split(", ")]
    return typed.withColumn("interval_start_hour", start - into_hour).select(*columns)


def grid_intensity_problems(intensity: DataFrame) -> DataFrame:
    """One row with the number of offences against each rule, from one pass and one shuffle."""
    value = F.col("emissions_intensity_kg_co2e_per_kwh")
    per_key = intensity.groupBy("region_code", "interval_start_hour").agg(
        F.count(F.lit(1)).alias("n"),
        count_where(F.col("interval_start").isNull()).alias("null_interval_start"),
        count_where(F.col("interval_end").isNull()).alias("null_interval_end"),
        count_where(value.isNull()).alias("null_intensity"),
        count_where(value < 0).alias("negative_intensity"),
    )
    counters = ("null_interval_start", "null_interval_end", "null_intensity", "negative_intensity")
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counters],
        count_where(F.col("n") > 1).alias("duplicate_region_hours"),
    )


def validate_grid_intensity(intensity: DataFrame) -> DataFrame:
    """Raise ``ValueError`` with the number of offences against every broken rule, else return the frame."""
    found = grid_intensity_problems(intensity).drop("row_count").first().asDict()
    broken = [f"{rule} {n}" for rule, n in found.items() if n]
    if broken:
        raise ValueError(f"Intensities: {', '.join(broken)}")
    return intensity


def load_grid_intensity(spark: SparkSession, path: str) -> DataFrame:
    """Read and check an hourly intensity CSV file; a missing file gives an empty typed frame."""
    try:
        raw = _read_text_csv(spark, path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], INTENSITY_SCHEMA)
        raise
    if raw.isEmpty():
        raise ValueError(f"Intensities: {path} has a header and no rows")
    return validate_grid_intensity(parse_grid_intensity(raw))


def register_reference(
    df: DataFrame, table: str, stamp: bool = False, root: str | None = None, layer: str = "reference"
) -> DataFrame:
    """Store a reference frame as a table of its layer, with the load time if asked."""
    if stamp:
        df = df.withColumn("ingested_at", F.current_timestamp())
    return write_layer(df, f"{layer}.{table}", root=root)
