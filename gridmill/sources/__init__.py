"""Readers and writers: raw files, layer tables and reference files."""

from gridmill.sources.layers import (
    describe_table,
    layer_row_funnel,
    row_counts,
    stored_rows,
    table_inventory,
    write_layer,
)
from gridmill.sources.raw import (
    IngestError,
    bad_records,
    bronze_frames,
    bronze_table_name,
    discover_sources,
    ingest_bronze,
    read_raw,
)
from gridmill.sources.reference import (
    grid_intensity_problems,
    load_emissions_factors,
    load_grid_intensity,
    parse_emissions_factors,
    parse_grid_intensity,
    register_reference,
    validate_grid_intensity,
)

__all__ = [
    "IngestError",
    "bad_records",
    "bronze_frames",
    "bronze_table_name",
    "describe_table",
    "discover_sources",
    "grid_intensity_problems",
    "ingest_bronze",
    "layer_row_funnel",
    "load_emissions_factors",
    "load_grid_intensity",
    "parse_emissions_factors",
    "parse_grid_intensity",
    "read_raw",
    "register_reference",
    "row_counts",
    "stored_rows",
    "table_inventory",
    "validate_grid_intensity",
    "write_layer",
]
