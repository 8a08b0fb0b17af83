"""Schema and size of a table, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def describe_schema(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, row count, and the longest array for array columns.

    Everything comes from one pass over the table.
    """
    fields = df.schema.fields
    widths = [
        (F.max(F.size(f.name)) if isinstance(f.dataType, T.ArrayType) else F.lit(None)).cast("int") for f in fields
    ]
    sizes = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*widths).alias("widths"))
    names = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"))
            for i, f in enumerate(fields)
        ]
    )
    item = sizes.select("rows", "widths", F.explode(names).alias("c"))
    return item.select("c.position", "c.column", "c.type", "rows", F.get("widths", F.col("c.position")).alias("width"))
