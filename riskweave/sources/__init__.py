"""Sources and sinks: table scans, CSV/parquet round trips, fixture views."""

from .tables import (read_table, read_csv, write_csv, save_table, snapshot,
                     select_by_pattern, shape, preview, use_database)

__all__ = ["read_table", "read_csv", "write_csv", "save_table", "snapshot",
           "select_by_pattern", "shape", "preview", "use_database"]
