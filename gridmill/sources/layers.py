"""Layer tables: staged full-refresh writes and catalog questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from datetime import UTC, datetime
from functools import reduce
from threading import Lock
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.names import LAYERS

#: Table property: rows, files and bytes of a version; set before the table is moved to it.
FACTS = "gridmill.facts."
TRACKS_PARTITIONS = "spark.sql.hive.manageFilesourcePartitions"


def write_layer(
    df: DataFrame,
    table: str,
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    root: str | None = None,
    check: Callable[[DataFrame], None] | None = None,
    hidden: Sequence[str] = (),
    rebalance: bool = True,
) -> DataFrame:
    """Rebuild ``layer.table`` from a frame and return the stored table.

    The rows go to a new version folder of the table, in the warehouse of the session or under ``root`` where
    the catalog does not outlive the session. They are read back (their number from the file footers, and by
    ``check``, which raises to refuse them); only then does one catalog call move the table to the new version.
    A job that fails or is killed before leaves the table as it was. The version before stays for its readers
    until the next write; older ones, and what failed writes left, are deleted. If columns or partitions are
    other ones than before, the table is dropped and created instead of moved. One table has one writer at a time.

    Reading the stored table back ends the lineage of a job, so a lost executor costs one layer
    at most. ``partition_by`` rebalances first (unless the caller has dealt the rows already and says so): AQE
    then merges small output partitions and splits a partition value that holds far more rows than the others. ``sort_by`` orders rows inside each
    file so that row-group statistics let time-range filters skip data. Columns named in ``hidden`` are in the
    files and are no columns of the table. A table of that name that lies anywhere else is not replaced: that
    is an error.
    """
    spark = df.sparkSession
    layer, name = table.split(".")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer}")
    base = f"{root.rstrip('/')}/{layer}/{name}" if root else f"{_database_folder(spark, layer)}/{name}"
    before = _location(spark, table)
    if before and not _inside(before, base):
        raise ValueError(f"{table} lies at {before}; drop it or write it there")
    columns = df.columns
    if partition_by and rebalance:
        df = df.hint("rebalance", *partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    version = f"version={datetime.now(UTC):%Y%m%d%H%M%S%f}-{uuid4().hex[:8]}"
    place = f"{base}/{version}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        writer.parquet(place)
        stored = spark.read.schema(df.schema).parquet(place)
        rows = stored.count()
        if check:
            check(stored)
        shown = [f for f in df.schema.fields if f.name not in hidden]
        _move(spark, table, place, shown, partition_by, f"{rows} {' '.join(map(str, _size(spark, place)))}", before)
    except BaseException:
        if not _same(_location(spark, table) or "", place):
            _delete(spark, place)
        raise
    for child in _children(spark, base):
        if not any(_inside(keep, child) for keep in (place, before) if keep):
            _delete(spark, child)
    return spark.table(table).select(*[c for c in columns if c not in hidden])


def _move(spark: SparkSession, table: str, place: str, fields, partition_by: Sequence[str], facts: str, before: str | None) -> None:
    """Let the table lie at ``place``: by moving it if its columns are the same, else by creating it."""
    property_name = f"{FACTS}{place.rpartition('/')[2]}"
    parts = [f for f in fields if f.name in partition_by]
    listed = [f for f in fields if f.name not in partition_by] + [f for name in partition_by for f in parts if f.name == name]
    wanted = [(f.name, f.dataType.simpleString()) for f in listed]
    if before:
        own = spark.catalog.listColumns(table)
        have = [(c.name, c.dataType) for c in own]
        if have == wanted and [c.name for c in own if c.isPartition] == list(partition_by) and not _tracked(spark, table):
            spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{property_name}' = '{facts}')")
            spark.sql(f"ALTER TABLE {table} SET LOCATION '{place}'")
            stale = [k for k in _properties(spark, table) if k.startswith(FACTS) and k != property_name]
            if stale:
                names = ", ".join(f"'{k}'" for k in stale)
                spark.sql(f"ALTER TABLE {table} UNSET TBLPROPERTIES IF EXISTS ({names})")
            return
        if not before.rpartition("/")[2].startswith("version="):
            raise ValueError(f"{table} lies at {before} without versions and has other columns or listed partitions; drop it")
    columns = ", ".join(f"`{name}` {kind}" for name, kind in wanted)
    by = f"PARTITIONED BY ({', '.join(f'`{name}`' for name in partition_by)})" if partition_by else ""
    # Partitions are found in the folder: a list of them in the catalog could not be moved in one call.
    with _setting(spark, TRACKS_PARTITIONS, "false"):
        if before:
            spark.sql(f"DROP TABLE {table}")
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet {by} LOCATION '{place}' TBLPROPERTIES ('{property_name}' = '{facts}')"
        )


#: Tables that are written at the same time share the settings of the session.
_ONE_AT_A_TIME = Lock()


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    with _ONE_AT_A_TIME:
        old = spark.conf.get(key)
        spark.conf.set(key, value)
        try:
            yield
        finally:
            spark.conf.set(key, old)


def _plain(path: str) -> str:
    return "/" + path.removeprefix("file:").strip("/") if path.startswith(("file:", "/")) else path.rstrip("/")


def _same(one: str, other: str) -> bool:
    return _plain(one) == _plain(other)


def _inside(path: str, folder: str) -> bool:
    return _same(path, folder) or _plain(path).startswith(_plain(folder) + "/")


def _database_folder(spark: SparkSession, layer: str) -> str:
    return spark.catalog.getDatabase(layer).locationUri.rstrip("/")


def _location(spark: SparkSession, table: str) -> str | None:
    """Where a table lies; None if there is none."""
    if not spark.catalog.tableExists(table):
        return None
    facts = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    return facts.get("Location", "nowhere").rstrip("/")


def _tracked(spark: SparkSession, table: str) -> bool:
    """Whether the catalog lists the partitions of a table."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Partition Provider'")
    return any(r.data_type == "Catalog" for r in rows.collect())


def _properties(spark: SparkSession, table: str) -> dict[str, str]:
    return {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _delete(spark: SparkSession, path: str) -> None:
    files, place = _files(spark, path)
    files.delete(place, True)


def _children(spark: SparkSession, path: str) -> list[str]:
    files, place = _files(spark, path)
    return [s.getPath().toString() for s in files.listStatus(place)] if files.exists(place) else []


def _size(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number of files and bytes under a folder."""
    files, place = _files(spark, path)
    summary = files.getContentSummary(place)
    return summary.getFileCount(), summary.getLength()


def stored_rows(spark: SparkSession, table: str) -> int | None:
    """The number of rows that ``write_layer`` recorded, or None where it can't be trusted.

    It is for the files as they were: files added or taken away since, or a table written by other means,
    leave it unknown. No file is opened.
    """
    place = _location(spark, table)
    if not place or not spark.catalog.tableExists(table):
        return None
    facts = _properties(spark, table).get(f"{FACTS}{place.rpartition('/')[2]}")
    if not facts:
        return None
    rows, *size = map(int, facts.split())
    return rows if tuple(size) == _size(spark, place) else None


def store(df: DataFrame, path: str) -> DataFrame:
    """Write a frame as parquet under a shared path and return the stored copy.

    For a result that several parts of one job read: it is computed once, its lineage ends, and its
    size is known to the join planner.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_counts(frames: Mapping[tuple[str, str], DataFrame]) -> DataFrame:
    """One row per named frame: schema_name, table_name, row_count."""
    parts = [
        frame.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(schema).alias("schema_name"), F.lit(name).alias("table_name"), "row_count"
        )
        for (schema, name), frame in sorted(frames.items(), key=lambda item: item[0])
    ]
    return reduce(DataFrame.unionByName, parts)


def table_inventory(spark: SparkSession, layers: Sequence[str] = LAYERS) -> DataFrame:
    """Row count of every table stored in the layer databases, as recorded when it was written.

    Only tables whose count is not known are scanned.
    """
    tables = [
        (layer, table.name)
        for layer in layers
        if spark.catalog.databaseExists(layer)
        for table in spark.catalog.listTables(layer)
        if not table.isTemporary
    ]
    schema = "schema_name string, table_name string, row_count bigint"
    known = {key: stored_rows(spark, ".".join(key)) for key in tables}
    counted = spark.createDataFrame([(*key, n) for key, n in known.items() if n is not None], schema)
    others = {key: spark.table(".".join(key)) for key, n in known.items() if n is None}
    found = counted.unionByName(row_counts(others)) if others else counted
    return found.orderBy("schema_name", "table_name")


def layer_row_funnel(inventory: DataFrame) -> DataFrame:
    """Rows per layer."""
    return inventory.groupBy("schema_name").agg(F.sum("row_count").alias("row_count")).orderBy("schema_name")


def describe_frame(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """One row per column: table, position, name, type, nullable, plus the row count, counted if not given."""
    facts = F.array(
        *[
            F.struct(
                F.lit(position).alias("column_position"),
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                F.lit(field.nullable).alias("nullable"),
            )
            for position, field in enumerate(df.schema.fields, start=1)
        ]
    )
    if rows is None:
        counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    else:
        counted = df.sparkSession.createDataFrame([(rows,)], "row_count bigint")
    return counted.select(F.lit(name).alias("table_name"), "row_count", F.inline(facts))


def describe_table(spark: SparkSession, table: str, layers: Sequence[str] = LAYERS) -> DataFrame:
    """Columns and row count of one stored layer table; other names are refused."""
    layer = table.split(".")[0]
    stored = spark.catalog.listTables(layer) if layer in layers and spark.catalog.databaseExists(layer) else []
    known = sorted(f"{layer}.{t.name}" for t in stored if not t.isTemporary)
    if table not in known:
        raise ValueError(f"No layer table {table!r}; {layer} has: {', '.join(known) or 'none'}")
    return describe_frame(spark.table(table), table, stored_rows(spark, table))
