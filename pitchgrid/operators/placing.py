"""Places of rows within their groups, whatever the groups' sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchgrid.sources.shared import checkpointed

#: Up to so many rows in the largest group, a window sorts each group in one task; beyond that rows are dealt by ranges.
WINDOW_ROWS = 1_000_000


def largest_group(rows: DataFrame, by: list[str]) -> int:
    """Rows of the largest group; counts combine in the map tasks."""
    return rows.groupBy(*by).agg(F.count("*").alias("__n")).agg(F.max("__n")).first()[0] or 0


def placed(rows: DataFrame, by: list[str], order: list, window_rows: int | None = None) -> DataFrame:
    """rows with __place, from 0 on in order within their group, and __of, the group's rows.

    Small groups are sorted by a window. Otherwise rows are dealt by ranges of (group, order), so a group that holds most
    rows is sorted by many tasks; the table is written with each row's range and its place there, since ranges are sampled
    anew each time that they are drawn. Counts by group and range, as many as groups and ranges, give the rest.
    """
    if largest_group(rows, by) <= (WINDOW_ROWS if window_rows is None else window_rows):
        w = W.partitionBy(*by)
        return rows.withColumns({"__place": F.row_number().over(w.orderBy(*order)) - 1, "__of": F.count("*").over(w)})
    tied = checkpointed(rows.withColumn("__tie", F.monotonically_increasing_id()))  # equal rows can go to several ranges
    keys = [*by, *order, "__tie"]
    in_range = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # what is left of the range's own bits
    ranged = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    ranged = checkpointed(ranged.withColumns({"__range": F.spark_partition_id(), "__at": in_range}))
    sizes = ranged.groupBy(*by, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__k"))
    before = F.coalesce(F.sum("__k").over(W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    names = {c: f"__{i}" for i, c in enumerate([*by, "__range"])}
    sizes = sizes.withColumns({"__before": before - F.col("__first"), "__of": F.sum("__k").over(W.partitionBy(*by))}).drop("__first", "__k").withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return ranged.join(sizes, same).select(*rows.columns, (F.col("__at") + F.col("__before")).alias("__place"), "__of")
