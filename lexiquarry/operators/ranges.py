"""Global prefix sums and ranks without a window over one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_RANGE, MAX_RANGES = 500_000, 4096


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are <= key, by a coarse and a fine pass; nulls go to range 0."""
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    if len(bounds) <= 16:
        found = F.size(F.filter(arr(bounds), lambda b: b <= key))
    else:
        coarse = F.size(F.filter(arr(bounds[step::step]), lambda b: b <= key))
        blocks = F.array(*[arr(bounds[i : i + step]) for i in range(0, len(bounds), step)])
        found = coarse * step + F.size(F.filter(F.element_at(blocks, coarse + 1), lambda b: b <= key))
    return F.when(key.isNull(), 0).otherwise(found)


def split_points(df: DataFrame, key: str, rows: int | None = None) -> list[int]:
    """Bounds of ranges of about ROWS_PER_RANGE rows, by quantiles of the key."""
    n = df.count() if rows is None else rows
    parts = min(MAX_RANGES, -(-n // ROWS_PER_RANGE))
    if parts < 2:
        return []
    got = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0]
    return sorted(set(got or []))


def with_prefix_sums(df: DataFrame, key: str, values: dict[str, str], ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds, for each (name, column) of values, the sum of the column over all rows before, in order
    of key (long) and ties. Only the ranges' sums pass through the driver, MAX_RANGES rows at most."""
    bounds = split_points(df, key)
    ranged = df.withColumn("_range", range_of(F.col(key), bounds))
    base = {v: [F.lit(0)] for v in values}
    if bounds:
        sums = {r["_range"]: r for r in ranged.groupBy("_range").agg(*[F.sum(c).alias(v) for v, c in values.items()]).collect()}
        for v in values:
            acc = 0
            base[v] = []
            for i in range(len(bounds) + 1):
                base[v].append(F.lit(acc).cast("long"))
                acc += int(sums[i][v] or 0) if i in sums else 0
    order = W.partitionBy("_range").orderBy(key, *ties).rowsBetween(W.unboundedPreceding, -1)
    for v, c in values.items():
        ranged = ranged.withColumn(v, (F.element_at(F.array(*base[v]), F.col("_range") + 1) + F.coalesce(F.sum(c).over(order), F.lit(0))).cast("long"))
    return ranged.drop("_range")
