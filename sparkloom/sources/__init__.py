"""Where tables come from and go to."""

from .custom import read_custom
from .memory import from_rows
from .readers import read_csv, read_parquet
from .tables import TABLES, table
from .writers import collect, show, write_csv, write_parquet

__all__ = ["TABLES", "collect", "from_rows", "read_csv", "read_custom", "read_parquet", "show", "table", "write_csv", "write_parquet"]
