"""Raw files: discovery, format dispatch and bronze ingestion."""

from __future__ import annotations

import re
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from posixpath import splitext

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridmill.sources.layers import stored_rows, write_layer

FORMATS = ("csv", "json", "jsonl", "parquet")
BAD_RECORD, BAD_FILE = "_bad_record", "_bad_file"
#: The database, next to that of a layer, whose tables list the records of the layer's tables that did not fit.
QUARANTINE = "{}_quarantine"

# The raw feeds the jobs read, by bronze table. Campus ids of grid connections stay text.
FEED_SCHEMAS = {
    "bronze_building_consumption": "campus_id bigint, meter_id bigint, timestamp timestamp_ntz, consumption double",
    "bronze_nmi_consumption": "campus_id string, meter_id bigint, timestamp timestamp_ntz, consumption double, "
    "demand_kW double, demand_kVA double",
    "bronze_building_submeter_consumption": "building_id bigint, id bigint, campus_id bigint, "
    "timestamp timestamp_ltz, consumption double, current double, voltage double, power double, "
    "power_factor double",
    "bronze_weather_data": "campus_id bigint, timestamp timestamp_ntz, apparent_temperature double, "
    "air_temperature double, dew_point_temperature double, relative_humidity double, wind_speed string, "
    "wind_direction string",
}
#: Parquet and JSON data sets found to have the columns of a schema: session, path, schema.
_FITTING: set[tuple[str, str, str]] = set()

# Fixed value: the table of campuses that the quality checks refer to.
BRONZE_METADATA = "bronze_campus_meta"


def discover_sources(spark: SparkSession, raw_dir: str) -> DataFrame:
    """Supported data sets under a folder: ``path`` and ``format``, sorted; empty if the folder is missing.

    A folder that itself carries a supported suffix (``readings.parquet/part-0...``) counts as one
    data set, so multi-part outputs of a cluster are one source and not thousands.
    """
    any_case = ",".join("".join(f"[{c}{c.upper()}]" for c in fmt) for fmt in FORMATS)
    try:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", f"*.{{{any_case}}}")
            .load(raw_dir)
            .select("path")
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, format string")
    data_set = rf"(?i)^(.*?\.({'|'.join(FORMATS)}))(/.*)?$"
    return (
        files.select(
            F.regexp_extract("path", data_set, 1).alias("path"),
            F.lower(F.regexp_extract("path", data_set, 2)).alias("format"),
        )
        .distinct()
        .orderBy("path")
    )


def read_raw(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    null_value: str = "N/A",
    multi_line: bool = False,
    keep_bad: bool = False,
) -> DataFrame:
    """Read one raw data set by its extension.

    A record that does not fit ``schema`` fails the job that reads it; with ``keep_bad`` its text is in the
    column ``BAD_RECORD`` instead, and what could not be read is NULL. ``multi_line`` is for CSV feeds whose quoted
    texts hold line breaks; such files are not split over tasks. Parquet and JSON data sets have to have
    the columns of the schema; they are looked at once a session, which costs JSON one more pass.

    Without ``schema`` a CSV or JSON file is read once more to infer its types; pass the schema of
    a known feed (``FEED_SCHEMAS``) to skip that pass on large inputs. A CSV header that does not
    name the columns of the schema in its order is an error.
    """
    suffix = splitext(path)[1].lower().lstrip(".")
    if suffix not in FORMATS:
        raise ValueError(f"{path}: no reader for {suffix or 'a name without suffix'}, only for {', '.join(FORMATS)}")
    options: dict = {}
    if suffix == "csv":
        options = {"header": True, "nullValue": null_value, "escape": '"', "multiLine": multi_line}
        options |= {"inferSchema": schema is None, "enforceSchema": False}
    elif suffix == "json":
        options = {"multiLine": True}
    reader = spark.read.options(**options)
    if schema is None:
        return reader.format("json" if suffix == "jsonl" else suffix).load(path)
    wanted = spark.createDataFrame([], schema).schema
    known = (spark.sparkContext.applicationId, path, wanted.json())
    if suffix != "csv" and known not in _FITTING:
        # A CSV file is held against the schema by its header; the others, once a session, by the columns they have.
        own = {f.name: f.dataType for f in reader.format("json" if suffix == "jsonl" else suffix).load(path).schema}
        absent = [f.name for f in wanted if f.name not in own]
        other = [f.name for f in wanted if suffix == "parquet" and own.get(f.name, f.dataType) != f.dataType]
        if absent or other:
            raise ValueError(f"{path}: without column {absent}, of another type {other}")
        _FITTING.add(known)
    if suffix == "parquet":
        return reader.schema(wanted).parquet(path)
    if keep_bad:
        wanted = StructType([*wanted.fields, StructField(BAD_RECORD, StringType())])
        reader = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_RECORD)
    else:
        reader = reader.options(mode="FAILFAST")
    return reader.schema(wanted).format("json" if suffix == "jsonl" else suffix).load(path)


def bronze_table_name(path: str) -> str:
    """``bronze_`` plus the file stem in lower case with other characters than letters and digits as ``_``."""
    file_name = path.rstrip("/").rpartition("/")[2]
    words = re.findall(r"[a-z0-9]+", file_name.rpartition(".")[0].lower())
    if not words:
        raise ValueError(f"{file_name!r} has no letter or digit to name a table by")
    return "_".join(["bronze", *words])


def data_sets(spark: SparkSession, raw_dir: str) -> dict[str, str]:
    """Bronze table name -> source path for every data set found."""
    found: dict[str, str] = {}
    # One short row per data set, not per part file.
    for row in discover_sources(spark, raw_dir).collect():
        name = bronze_table_name(row.path)
        if name in found:
            raise ValueError(f"{found[name]} and {row.path} would both become {name}")
        found[name] = row.path
    if not found:
        raise FileNotFoundError(f"{raw_dir} holds no file of a known format")
    return found


def bronze_frames(
    spark: SparkSession,
    raw_dir: str,
    schemas: Mapping[str, StructType | str] | None = None,
    multi_line: bool = False,
) -> dict[str, tuple[str, DataFrame]]:
    """Bronze table name -> (source path, frame) for every data set found."""
    return {
        name: (path, read_raw(spark, path, (schemas or {}).get(name), multi_line=multi_line))
        for name, path in data_sets(spark, raw_dir).items()
    }


class IngestError(ValueError):
    """Some data sets could not be loaded: ``failures`` tells why, by table; ``loaded`` is the summary of the others."""

    def __init__(self, failures: Mapping[str, Exception], loaded: DataFrame):
        super().__init__("; ".join(f"{name}: {error}" for name, error in failures.items()))
        self.failures, self.loaded = dict(failures), loaded


def ingest_bronze(
    spark: SparkSession,
    raw_dir: str,
    schemas: Mapping[str, StructType | str] | None = None,
    root: str | None = None,
    max_bad_records: int = 0,
    multi_line: bool = False,
    layer: str = "bronze",
    at_once: int = 4,
) -> DataFrame:
    """Rebuild one table per raw data set; returns the load summary with ``bad_record_count``.

    Each data set is read once. A record that does not fit the schema keeps what could be read as a row of the
    table; its text and file are listed by the table of the same name in the quarantine database of the layer.
    More than ``max_bad_records`` of them in one data set refuse it: the table stays as it was before.

    ``at_once`` data sets load at the same time. One that fails does not stop the others; ``IngestError`` is
    raised when all have ended.
    """

    def load(name: str, path: str) -> tuple[str, str, int, int, int]:
        frame = read_raw(spark, path, (schemas or {}).get(name), multi_line=multi_line, keep_bad=True)
        hidden, n_bad = [], 0
        if BAD_RECORD in frame.columns:
            hidden = [BAD_RECORD, BAD_FILE]
            file = F.when(F.col(BAD_RECORD).isNotNull(), F.col("_metadata.file_path"))
            frame = frame.select("*", file.alias(BAD_FILE))

        def allowed(stored: DataFrame) -> None:
            nonlocal n_bad
            # Row groups without a bad record are skipped by their statistics.
            n_bad = stored.where(F.col(BAD_RECORD).isNotNull()).count()
            if n_bad > max_bad_records:
                raise ValueError(f"{path}: {n_bad} records do not fit the schema, {max_bad_records} are allowed")

        table = f"{layer}.{name}"
        written = write_layer(frame, table, root=root, check=allowed if hidden else None, hidden=hidden)
        if hidden:
            _list_bad_records(spark, table)
        return path, table, stored_rows(spark, table), len(written.columns), n_bad

    found = data_sets(spark, raw_dir)
    results, failures = [], {}
    with ThreadPoolExecutor(at_once) as pool:
        running = {name: pool.submit(inheritable_thread_target(spark)(load), name, path) for name, path in found.items()}
        for name, job in running.items():
            try:
                results.append(job.result())
            except Exception as error:  # noqa: BLE001 - the other data sets go on; it is raised below
                failures[name] = error
    schema = "source_path string, table_name string, row_count bigint, column_count int, bad_record_count bigint"
    summary = spark.createDataFrame(results, schema)
    if failures:
        raise IngestError(failures, summary)
    return summary


def _list_bad_records(spark: SparkSession, table: str) -> None:
    """A view over the stored files of a bronze table: file and text of the records that did not fit."""
    layer, name = table.split(".")
    side = QUARANTINE.format(layer)
    place = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first().data_type
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {side}")
    spark.sql(
        f"CREATE OR REPLACE VIEW {side}.{name} AS SELECT {BAD_FILE} AS source_file, {BAD_RECORD} AS record "
        f"FROM parquet.`{place}` WHERE {BAD_RECORD} IS NOT NULL"
    )


def bad_records(spark: SparkSession, layer: str = "bronze") -> DataFrame:
    """table_name, source_file and record of every record in the quarantine of a layer."""
    side = QUARANTINE.format(layer)
    names = [t.name for t in spark.catalog.listTables(side) if not t.isTemporary] if spark.catalog.databaseExists(side) else []
    found = spark.createDataFrame([], "table_name string, source_file string, record string")
    for name in sorted(names):
        found = found.unionByName(spark.table(f"{side}.{name}").select(F.lit(name).alias("table_name"), "source_file", "record"))
    return found
