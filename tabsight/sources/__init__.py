from .scan import dataset_info, preview, read_csv, read_table, read_parquet
from .sinks import load_model, save_model, write_json_documents, write_table

__all__ = [
    "dataset_info", "preview", "read_csv", "read_table", "read_parquet",
    "load_model", "save_model", "write_json_documents", "write_table",
]
