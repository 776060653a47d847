from .tables import read_table, nan_to_null, load_tables, TABLES
from .catalog import file_catalog, pending_items, job_status_files, materialise, write_segments

__all__ = ["read_table", "nan_to_null", "load_tables", "TABLES", "file_catalog",
           "pending_items", "job_status_files", "materialise", "write_segments"]
