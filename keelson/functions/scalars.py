"""Small functions of cells: server ids, error classes, names in SQL, numbers for people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error numbers of the MySQL protocol. A single row breaks a constraint; two writes conflict; the schema is wrong.
CONSTRAINT = (1022, 1048, 1052, 1062, 1169, 1216, 1217, 1292, 1451, 1452, 1557, 1586, 1761, 1762, 1859)
CONFLICT = (9007,)
SCHEMA = (1054, 1146)

# Offset basis and prime of the 32-bit FNV-1 hash.
_BASIS, _PRIME = 2166136261, 16777619


def server_id(task: Column) -> Column:
    """The 32-bit FNV-1 hash of a task's name: its replication server id."""
    digits = F.hex(F.encode(task, "UTF-8"))
    octets = F.transform(F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))
    step = lambda h, x: (h * _PRIME % (1 << 32)).bitwiseXOR(x)
    return F.when(F.length(digits) > 0, F.aggregate(octets, F.lit(_BASIS).cast("long"), step)).when(task.isNotNull(), F.lit(_BASIS).cast("long"))


def error_class(number: Column) -> Column:
    """constraint (the batch is halved), conflict (tried again), schema (permanent) or other."""
    return F.when(number.isin(*CONSTRAINT), "constraint").when(number.isin(*CONFLICT), "conflict").when(number.isin(*SCHEMA), "schema").otherwise("other")


def quoted(names: Sequence[str]) -> str:
    """A list of column names for SQL."""
    return ", ".join("`" + n.replace("`", "``") + "`" for n in names)


def humanised(number: Column) -> Column:
    """Numbers below ten with one place, others without any."""
    return F.when(number < 10, F.format_string("%.1f", number)).otherwise(F.format_string("%.0f", number))


def estimate(data_length: Column, row_length: Column) -> Column:
    """About how many rows a table has, by its statistics; 0 where there are none."""
    return F.coalesce(F.round(data_length / F.nullif(row_length, F.lit(0))).cast("long"), F.lit(0).cast("long"))
