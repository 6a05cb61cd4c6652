"""Readers: raw tab-separated records, stage tables, the geographic grid."""

from gridpulse.sources.grid import grid_from_features, parse_grid, read_grid, require_grid
from gridpulse.sources.raw import finish_ingest, ingest, ingest_losses, parse_fields, parse_lines, read_raw, require_rows
from gridpulse.sources.tables import as_timestamp, read_anomalies, read_table, unwrap_key

__all__ = [
    "as_timestamp", "finish_ingest", "grid_from_features", "ingest", "ingest_losses", "parse_fields", "parse_grid", "parse_lines",
    "read_anomalies", "read_grid", "read_raw", "read_table", "require_grid", "require_rows", "unwrap_key",
]
