"""Where records come from and where pair tables go."""

from nearpair.sources.records import (
    read_csv_records,
    records_from_columns,
    shared_folder,
    with_row_ids,
    write_pairs,
)

__all__ = [
    "read_csv_records",
    "records_from_columns",
    "shared_folder",
    "with_row_ids",
    "write_pairs",
]
