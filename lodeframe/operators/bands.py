"""Figures that passages carry, as an equi-join: a stated figure meets only the candidates of its own cell of mantissas.

A figure is carried if a candidate, at some scale step, rounds to it. All steps are powers of ten, so the logarithms of both, taken modulo one decade,
lie within the band of the rounding. Cells cut the decade at several widths; a figure takes the finest whose cells are as wide as its band, which
lies in one or two of them then. Candidates have a row for each width. What meets is tested by the exact rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions import figures

CELLS = [2, 20, 200, 2_000, 20_000, 200_000]  # cells of a decade at each width; a band is at most 0.48 decades wide, as it is narrower than 0.5 to 1.5
SLACK = 1e-9  # of logarithms


def _cell(log: Column, cells: Column) -> Column:
    """The number of the cell that holds a logarithm, modulo a decade."""
    return F.pmod(F.floor(log * cells), cells).cast("int")


def carried(claims: DataFrame, pool: DataFrame, on: list[str], value: str = "value", places: str = "places", candidate: str = "candidate") -> DataFrame:
    """claims with carried: whether the pool of the same keys has a candidate that states the value, written with so many decimals, at some scale step.

    Equal figures and equal candidates of a key count once, so a key of very many claims is as large as the different figures they state.
    A figure whose band reaches 0 is carried by the least candidate if by any. Null figures are carried by none; null, negative and non-finite candidates carry nothing.
    """
    figure, decimals, c = F.col(value).cast("double"), F.col(places).cast("int"), F.col(candidate).cast("double")
    half = F.pow(F.lit(10.0), -decimals) / 2
    stated = claims.select(*on, value, places).distinct().withColumns({"_low": F.greatest(figure - half, F.lit(0.0)), "_high": figure + half}).filter(figure >= 0)
    held = pool.filter((c >= 0) & (c < float("inf"))).select(*on, c.alias("_c")).distinct()

    reach = F.log10(F.col("_high")) - F.log10(F.col("_low")) + 4 * SLACK
    finest = F.coalesce(*[F.when(reach <= 1.0 / n, F.lit(n)) for n in reversed(CELLS)], F.lit(CELLS[0]))
    sides = F.array_distinct(F.array(_cell(F.log10(F.col("_low")) - SLACK, F.col("_cells")), _cell(F.log10(F.col("_high")) + SLACK, F.col("_cells"))))
    asked = stated.filter("_low > 0").withColumn("_cells", finest).withColumn("_cell", F.explode(sides))
    every = held.filter("_c > 0").withColumn("_cells", F.explode(F.array(*map(F.lit, CELLS)))).withColumn("_cell", _cell(F.log10(F.col("_c")), F.col("_cells")))
    met = asked.join(every, [*on, "_cells", "_cell"]).filter(figures.same(figure, decimals, F.col("_c"))).select(*on, value, places)

    least = held.groupBy(*on).agg(F.min("_c").alias("_c"))
    small = stated.filter("_low = 0").join(least, on).filter(figures.same(figure, decimals, F.col("_c"))).select(*on, value, places)
    hits = met.union(small).distinct().withColumn("carried", F.lit(True))
    return claims.join(hits, [*on, value, places], "left").withColumn("carried", F.coalesce("carried", F.lit(False)))
