"""Ordered computations that hold up when one key owns much of the data.

Ranks, running sums, percentiles and p-adjustment all need rows in order
within a key. A plain window puts a whole key into one task, which is the
fast plan while keys are of moderate size and the wrong one when a key
holds a third of the table. Every function here first measures the largest
group (reading the key columns only). Up to ``GROUP_LIMIT`` rows it uses the
plain window; above it, the ordered column is cut into value buckets at
approximate quantiles of the *whole* table, so any (key, bucket) group has at
most about 1/buckets of all rows, each bucket is scanned on its own, and the
bucket totals (a handful of rows per key) are carried forward. Both plans
return the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP_LIMIT = 1_000_000
_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


_KEPT: list[DataFrame] = []


def reuse(df: DataFrame) -> DataFrame:
    """Keep a table that the operator reads several times (memory first, then executor disk).

    A lost executor only costs a recompute of its blocks. `release` drops them all.
    """
    if df.storageLevel.useMemory or df.storageLevel.useDisk:
        return df
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _KEPT.append(df)
    return df


def release() -> None:
    """Unpersist everything operators have kept so far."""
    while _KEPT:
        _KEPT.pop().unpersist()


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the biggest group of `keys` (all rows when there are none)."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def fits(df: DataFrame, keys: Sequence[str], small: bool | None = None) -> bool:
    """True when every group may be handled by one task; `small` passes on a known answer."""
    return largest_group(df, keys) <= GROUP_LIMIT if small is None else small


def value_buckets(df: DataFrame, col: str, out: str = "_b", n: int | None = None) -> DataFrame:
    """Add a bucket number that grows with `col`; equal values share a bucket.

    The cut points are collected once (n numbers) and become constants of the
    plan, so every later use of the bucket column agrees even when a lost
    executor forces a recompute.
    """
    n = n or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probs = [i / n for i in range(1, n)]
    cuts = df.approxQuantile(col, probs, 1.0 / (4 * n))
    inner = sorted({c for c in cuts if c is not None and math.isfinite(c)})
    if not inner:
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(
        splits=[-math.inf, *inner, math.inf], inputCol=col, outputCol=out, handleInvalid="keep"
    ).transform(df)


def _in_order(col: str, direction: str) -> Column:
    return F.col(col).asc() if direction == "asc" else F.col(col).desc()


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    specs: dict[str, tuple[str, str, str]],
    small: bool | None = None,
) -> DataFrame:
    """Add running aggregates over each key in the order of a numeric column.

    `specs` maps the new column to (sum | min | max, column, asc | desc); the
    frame runs from the first row in that direction to the current one. The
    caller collapses ties first: one row per (keys, order).
    """
    keys = list(keys)
    if fits(df, keys, small):
        for out, (fn, col, direction) in specs.items():
            w = Window.partitionBy(*keys).orderBy(_in_order(order, direction))
            w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            df = df.withColumn(out, _AGG[fn](col).over(w))
        return df
    return _bucketed_scan(df, keys, order, specs)


def _bucketed_scan(df, keys, order, specs):
    cols = df.columns
    part = value_buckets(df, order)
    totals = part.groupBy(*keys, "_b").agg(
        *[_AGG[fn](col).alias(f"_t_{out}") for out, (fn, col, _) in specs.items()]
    )
    for out, (fn, _, direction) in specs.items():
        before = (
            Window.partitionBy(*keys)
            .orderBy(_in_order("_b", direction))
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        totals = totals.withColumn(f"_o_{out}", _AGG[fn](f"_t_{out}").over(before))
    carried = totals.select(*keys, "_b", *[f"_o_{o}" for o in specs])
    for out, (fn, col, direction) in specs.items():
        w = (
            Window.partitionBy(*keys, "_b")
            .orderBy(_in_order(order, direction))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        part = part.withColumn(f"_i_{out}", _AGG[fn](col).over(w))
    joined = part.join(carried, [*keys, "_b"])
    merged = []
    for out, (fn, _, _) in specs.items():
        inside, carry = F.col(f"_i_{out}"), F.col(f"_o_{out}")
        if fn == "sum":
            value = F.coalesce(inside + carry, inside, carry)
        else:
            value = (F.least if fn == "min" else F.greatest)(inside, carry)
        merged.append(value.alias(out))
    return joined.select(*cols, *merged)


def value_counts(
    df: DataFrame, keys: Sequence[str], value: str, small: bool | None = None
) -> DataFrame:
    """One row per (keys, value): `c` rows there, `cum` rows up to there, `dense` rank."""
    counts = (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    ).withColumn("_one", F.lit(1).cast("long"))
    return ordered_scan(
        counts, keys, value, {"cum": ("sum", "c", "asc"), "dense": ("sum", "_one", "asc")}, small
    ).drop("_one")


def ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str = "rank",
    method: str = "average",
    tie: str | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Rank of `value` within each key: average, min, max, dense or first (ties by `tie`)."""
    keys = list(keys)
    present = df.filter(F.col(value).isNotNull())
    if method == "first":
        if tie is None:
            raise ValueError("method 'first' needs a tie column")
        return ordinal_ranks(present, keys, value, tie, out, small=small)
    if fits(present, keys, small):
        w = Window.partitionBy(*keys).orderBy(value)
        if method == "dense":
            return present.withColumn(out, F.dense_rank().over(w).cast("double"))
        low = F.rank().over(w)
        same = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
        picks = {"average": low + (same - 1) / 2.0, "min": low, "max": low + same - 1}
        return present.withColumn(out, picks[method].cast("double"))
    table = value_counts(present, keys, value, small)
    picks = {
        "average": F.col("cum") - (F.col("c") - 1) / 2.0,
        "min": F.col("cum") - F.col("c") + 1,
        "max": F.col("cum"),
        "dense": F.col("dense"),
    }
    table = table.select(*keys, value, picks[method].cast("double").alias(out))
    return present.join(table, [*keys, value]).select(*present.columns, out)


def ordinal_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tie: str,
    out: str = "rank",
    descending: bool = False,
    small: bool | None = None,
) -> DataFrame:
    """Row number by (value, tie) within each key; `tie` is unique within a key."""
    keys = list(keys)
    cols = df.columns
    if fits(df, keys, small):
        w = Window.partitionBy(*keys).orderBy(
            F.col(value).desc() if descending else F.col(value).asc(), F.col(tie).asc()
        )
        return df.withColumn(out, F.row_number().over(w))
    signed = df.withColumn("_v", F.when(F.lit(descending), -F.col(value)).otherwise(F.col(value)))
    below = value_counts(signed, keys, "_v", small).select(
        *keys, "_v", (F.col("cum") - F.col("c")).alias("_below")
    )
    # long runs of one value are cut again, by ranges of the tie column
    sample = [r[0] for r in signed.select(tie).distinct().sample(0.2, seed=7).limit(4096).collect()]
    edges = sorted(sample)[:: max(1, len(sample) // 64)]
    # plain comparisons: a lambda over an array would not be recognised as the grouping expression in every plan
    slot = F.lit(0)
    for edge in edges:
        slot = slot + (F.lit(edge) <= F.col(tie)).cast("int")
    slotted = signed.withColumn("_s", slot)
    run = Window.partitionBy(*keys, "_v").orderBy("_s")
    slots = (
        slotted.groupBy(*keys, "_v", "_s")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_in_run",
            F.coalesce(
                F.sum("_n").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_v", "_s").orderBy(tie))
    return (
        slotted.withColumn("_r", inside)
        .join(slots, [*keys, "_v", "_s"])
        .join(below, [*keys, "_v"])
        .select(*cols, (F.col("_r") + F.col("_in_run") + F.col("_below")).cast("int").alias(out))
    )


GROUP_LIMIT_PUSHDOWN = 1000


def top_per_key(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tie: str,
    n: int,
    out: str = "rank",
    descending: bool = True,
) -> DataFrame:
    """First n rows of each key with their rank.

    For small n Spark pushes the limit below the shuffle (a window group limit),
    so each task sends at most n rows per key and a hot key does no harm.
    """
    if n <= GROUP_LIMIT_PUSHDOWN:
        ranked = ordinal_ranks(df, keys, value, tie, out, descending, small=True)
    else:
        ranked = ordinal_ranks(df, keys, value, tie, out, descending)
    return ranked.filter(F.col(out) <= n)


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    small: bool | None = None,
) -> DataFrame:
    """Exact percentiles with linear interpolation, one column per entry of `probs`."""
    keys = list(keys)
    present = df.filter(F.col(value).isNotNull())
    if fits(present, keys, small):
        aggs = [F.percentile(value, F.lit(p)).alias(name) for name, p in probs.items()]
        return present.groupBy(*keys).agg(*aggs) if keys else present.agg(*aggs)
    table = value_counts(present, keys, value, small)
    sizes = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        table = table.join(sizes, keys)
    else:
        table = table.withColumn("_n", present.agg(F.count(F.lit(1)).alias("n")).scalar())
    aggs, finals = [], []
    for i, (name, p) in enumerate(probs.items()):
        pos = F.lit(p) * (F.col("_n") - 1)
        for side, at in (("l", F.floor(pos)), ("h", F.ceil(pos))):
            hit = (F.col("cum") > at) & (F.col("cum") - F.col("c") <= at)
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}{i}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_f{i}"))
        low, high = F.col(f"_l{i}"), F.col(f"_h{i}")
        finals.append((low + F.col(f"_f{i}") * (high - low)).alias(name))
    grouped = table.groupBy(*keys).agg(*aggs) if keys else table.agg(*aggs)
    return grouped.select(*keys, *finals)


def median_by(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    return percentiles(df, keys, value, {out: 0.5})


def scalar_of(df: DataFrame, agg: Column) -> Column:
    """A one-value aggregate as a scalar subquery: no join, nothing collected."""
    return df.agg(agg.alias("v")).scalar()
