from tillroll.sources.readers import file_batches, jdbc_options, load_table, read_csv, read_export, read_jdbc, table
from tillroll.sources.sinks import append_rows, write_csv, write_marts, write_table

__all__ = [
    "append_rows",
    "file_batches",
    "jdbc_options",
    "load_table",
    "read_csv",
    "read_export",
    "read_jdbc",
    "table",
    "write_csv",
    "write_marts",
    "write_table",
]
