"""How barcode strings are read, for problems 3 and 4."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def read_barcode(entry: Column) -> Column:
    """The run of at least eight letters A, C, G, T, N with which the entry begins after white space, in upper case; else null."""
    return F.upper(F.nullif(F.regexp_extract(entry, r"(?U)^\s*([ACGTNacgtn]{8,})", 1), F.lit("")))


#: the same in DuckDB; {0} is the entry
READ_SQL = r"upper(nullif(regexp_extract({0}, '^\s*([ACGTNacgtn]{{8,}})', 1), ''))"
