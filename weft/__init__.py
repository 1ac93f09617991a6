"""weft: a tabular analytics engine expressed on Spark DataFrames."""

from weft.naming import TableError
from weft.specs import Append, Dedup, GroupBy, Melt, Merge, Pivot, Sort, Window, WindowFrame
from weft.table import Table

__all__ = ["Append", "Dedup", "GroupBy", "Melt", "Merge", "Pivot", "Sort", "Table", "TableError", "Window", "WindowFrame"]
