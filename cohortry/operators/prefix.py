"""Running sums and row numbers over ordered data without a one-task window.

A plain ``Window.orderBy`` sends every row of a key to one task. Here the order is
cut into cells first. Sums per cell are a small table (at most ``cells`` rows per
key); a window over it gives what lies before each cell, and the rows of a cell are
ordered among themselves only.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.operators.skew import join_on

CELL = "_cell"
MAX_CELLS = 10_000
CELL_ROWS = 50_000


def default_cells(df: DataFrame) -> int:
    """Four cells for each shuffle partition, within limits that keep cell tables small."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(64, min(MAX_CELLS, 4 * partitions))


def score_splits(df: DataFrame, column: str, cells: int | None = None) -> list[float]:
    """Borders that cut ``column`` into cells of about equal row count.

    One aggregate over one column; at most ``cells - 1`` numbers reach the driver. Unless
    ``cells`` is given, small tables get fewer, with about CELL_ROWS rows each. The
    borders only balance the work: results are exact for any borders.
    """
    most = cells or default_cells(df)
    steps = [i / most for i in range(1, most)]
    found = df.agg(
        F.count(column).alias("n"), F.percentile_approx(F.col(column).cast("double"), steps, 10 * most).alias("q")
    ).first()
    wanted = most if cells else min(most, -(-found["n"] // CELL_ROWS))
    picked = [found["q"][round(i * most / wanted) - 1] for i in range(1, wanted)] if found["q"] else []
    borders = sorted(float(q) + 0.0 for q in picked if q is not None and math.isfinite(q))
    # a border found twice is a value with a cell's worth of rows: it gets a cell to itself
    heavy = {low for low, high in zip(borders, borders[1:]) if low == high}
    return sorted({*borders, *(math.nextafter(v, math.inf) for v in heavy)})


def single_value_cells(splits: list[float]) -> list[int]:
    """Cells that hold exactly one value, as ``score_splits`` makes for heavy values."""
    return [i + 1 for i, (low, high) in enumerate(zip(splits, splits[1:])) if math.nextafter(low, math.inf) == high]


def with_score_cells(df: DataFrame, column: str, splits: list[float], cell: str = CELL) -> DataFrame:
    """Add the cell of a numeric column; equal values share a cell, and NaN gets its own."""
    if not splits:
        return df.withColumn(cell, F.lit(0).cast("int"))
    borders = [-math.inf, *splits, math.inf]
    bucketed = Bucketizer(
        splits=borders, inputCol="_cell_input", outputCol="_cell_output", handleInvalid="keep"
    ).transform(df.withColumn("_cell_input", F.col(column).cast("double") + F.lit(0.0)))
    return bucketed.withColumn(cell, F.col("_cell_output").cast("int")).drop("_cell_input", "_cell_output")


def cell_offsets(
    df: DataFrame, keys: list[str], measures: dict[str, Column], cell: str = CELL, descending: bool = False
) -> DataFrame:
    """Per cell: sums of all earlier cells (``<name>_before``) and of all cells (``<name>_total``)."""
    totals = df.groupBy(*keys, cell).agg(*[F.sum(m).alias(f"_s_{n}") for n, m in measures.items()])
    everything = Window.partitionBy(*(keys or [F.lit(0)]))
    order = F.col(cell).desc() if descending else F.col(cell).asc()
    earlier = everything.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys,
        cell,
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"{n}_before") for n in measures],
        *[F.sum(f"_s_{n}").over(everything).alias(f"{n}_total") for n in measures],
    )


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    measures: dict[str, Column],
    cell: str = CELL,
    descending: bool = False,
    totals: bool = False,
) -> DataFrame:
    """Add, for each measure, its inclusive running sum over ``cell`` and then ``order``.

    ``cell`` must not decrease (not increase when ``descending``) along ``order``.
    With ``totals`` the sum over the whole key stays as ``<name>_total``.
    """
    offsets = cell_offsets(df, keys, measures, cell, descending)
    joined = join_on(df, offsets, [*keys, cell])
    local = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    result = joined.withColumns(
        {n: F.col(f"{n}_before") + F.sum(m).over(local) for n, m in measures.items()}
    )
    drop = [f"{n}_before" for n in measures] + ([] if totals else [f"{n}_total" for n in measures])
    return result.drop(*drop)


def numbered(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    cell: str = CELL,
    name: str = "row_no",
    totals: bool = False,
) -> DataFrame:
    """Row number from 1 within keys. ``order`` must decide every tie."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("bigint")}, cell, totals=totals)
