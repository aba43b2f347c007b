"""Reading texts once: what costs much for each text is done for distinct ones, in parts of few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.session import dealt

ROWS = 2000  # distinct texts of a task


def each_once(rows: DataFrame, on: list[str], name: str, of: Column) -> DataFrame:
    """rows with the column name = of, an expression of the columns on, which is evaluated once for equal values of these.

    Rows meet its values by a digest of the columns, so long texts are shuffled once for each distinct one. Copies cost no reading, and a task reads ROWS
    values however large the table is.
    """
    digest = F.unhex(F.sha2(F.to_json(F.struct(*on), {"ignoreNullFields": "false"}), 256)).alias("_digest")
    read = dealt(rows.select(*on).distinct(), rows=ROWS).select(digest, of.alias(name))
    return rows.withColumn("_digest", digest).join(read, "_digest", "left").drop("_digest")
