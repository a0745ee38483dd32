"""framewitness: aggregate-only evidence about suspected problems in tables."""

from framewitness.plans.investigate import Investigation, investigate
from framewitness.sources.tables import Table, read_csv, read_parquet, read_table

__all__ = [
    "Investigation",
    "Table",
    "investigate",
    "read_csv",
    "read_parquet",
    "read_table",
]
