"""Reading tables in and writing results out."""

from framewitness.sources.stages import StageStore, stage_table, write_stage
from framewitness.sources.tables import (
    Table,
    read_csv,
    read_parquet,
    read_table,
    type_inference,
    typed,
)

__all__ = [
    "StageStore",
    "Table",
    "read_csv",
    "read_parquet",
    "read_table",
    "stage_table",
    "type_inference",
    "typed",
    "write_stage",
]
