"""Correction of p-values for many tests.

All methods work on the table of distinct p-values with their counts, so
tied p-values (and genes with p = 1) never blow up one task, and the ordered
passes run through `ordered_scan`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genemill.operators.distributed import fits, ordered_scan, reuse, value_counts

# Accepted spellings of each method.
ALIASES = {
    "bh": "fdr_bh",
    "benjamini_hochberg": "fdr_bh",
    "benjamini-hochberg": "fdr_bh",
    "by": "fdr_by",
    "benjamini_yekutieli": "fdr_by",
    "benjamini-yekutieli": "fdr_by",
    "holm_sidak": "holm-sidak",
    "hochberg": "simes-hochberg",
}
METHODS = (
    "none",
    "bonferroni",
    "sidak",
    "holm",
    "holm-sidak",
    "simes-hochberg",
    "hommel",
    "fdr_bh",
    "fdr_by",
    "fdr_tsbh",
    "fdr_tsbky",
    "fdr_gbs",
)
HULL_LIMIT = 1_000_000


def canonical_method(name: str) -> str:
    key = (name or "").strip().lower()
    key = ALIASES.get(key, key)
    return key if key in METHODS else "fdr_bh"


def _lower_hull(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower convex chain of points sorted by x."""
    keep: list[int] = []
    for i in range(len(x)):
        while len(keep) > 1:
            o, m = keep[-2], keep[-1]
            if (y[m] - y[o]) * (x[i] - x[o]) >= (y[i] - y[o]) * (x[m] - x[o]):
                keep.pop()
            else:
                break
        keep.append(i)
    return x[keep], y[keep]


def _hommel_values(p: np.ndarray, n: int, hx: np.ndarray, hy: np.ndarray) -> np.ndarray:
    """Adjusted values: the largest over m of min(m p, a(m)).

    a(m) is the Simes p-value of the m largest p-values, that is m times the smallest
    slope from (n - m, 0) to a later point (rank, p); that point lies on the lower hull
    of all points. a falls and m p grows with m, so the best m is next to the crossing.
    """
    rise = np.diff(hy)
    with np.errstate(divide="ignore", invalid="ignore"):
        cut = np.where(rise > 0, hx[:-1] - hy[:-1] * np.diff(hx) / rise, -np.inf)
    cut = np.append(np.maximum.accumulate(cut) if len(cut) else cut, np.inf)

    def simes(m):
        s = n - m
        j = np.maximum(np.searchsorted(cut, s, side="left"), np.searchsorted(hx, s, side="right"))
        j = np.minimum(j, len(hx) - 1)
        return m * hy[j] / (hx[j] - s)

    low, high = np.ones(len(p)), np.full(len(p), float(n))
    while np.any(high - low > 1):
        mid = np.floor((low + high) / 2)
        above = mid * p >= simes(mid)
        high, low = np.where(above, mid, high), np.where(above, low, mid)
    best = np.maximum(np.minimum(low * p, simes(low)), np.minimum(high * p, simes(high)))
    return np.maximum(best, p)


def adjust_p(
    df: DataFrame,
    p: str = "p_value",
    method: str = "fdr_bh",
    out: str = "p_adj",
    keys: Sequence[str] = (),
    alpha: float = 0.05,
    small: bool | None = None,
) -> DataFrame:
    """Add the adjusted p-value; rows without a p-value keep a null."""
    method = canonical_method(method)
    keys = list(keys)
    if method == "none":
        return df.withColumn(out, F.col(p))
    df = reuse(df)
    valid = df.filter(F.col(p).isNotNull() & ~F.isnan(p))
    small = fits(valid, keys, small)
    if method == "hommel":
        return _join_back(df, _hommel_table(valid, keys, p, out, small), keys, p, out)
    table = value_counts(valid, keys, p, small)
    if keys:
        table = table.join(table.groupBy(*keys).agg(F.max("cum").alias("m")), keys)
    else:
        table = table.withColumn("m", table.agg(F.max("cum").alias("m")).scalar())
    pv, m = F.col(p), F.col("m").cast("double")
    last = F.col("cum").cast("double")
    left = m - last + F.col("c")  # tests still open at the first of a tie run
    if method == "bonferroni":
        table = table.withColumn("_raw", pv * m)
    elif method == "sidak":
        table = table.withColumn("_raw", -F.expm1(m * F.log1p(-pv)))
    elif method in ("holm", "holm-sidak", "fdr_gbs"):
        step = {
            "holm": left * pv,
            "holm-sidak": -F.expm1(left * F.log1p(-pv)),
            "fdr_gbs": left / (m - left + 1) * pv / (1.0 - pv),
        }[method]
        step = F.when(pv >= 1.0, F.lit(1.0)).otherwise(step)
        table = table.withColumn("_step", step)
        table = ordered_scan(table, keys, p, {"_raw": ("max", "_step", "asc")}, small)
    else:
        step = pv * m / last
        if method == "simes-hochberg":
            step = (m - last + 1) * pv
        table = table.withColumn("_step", step)
        table = ordered_scan(table, keys, p, {"_raw": ("min", "_step", "desc")}, small)
        if method == "fdr_by":
            table = table.withColumn("_raw", F.col("_raw") * _harmonic(m))
        if method in ("fdr_tsbh", "fdr_tsbky"):
            table = _second_stage(table, keys, method, alpha)
    table = table.select(*keys, p, F.least(F.lit(1.0), F.col("_raw")).alias(out))
    return _join_back(df, table, keys, p, out)


def _harmonic(m):
    """Sum of 1/i for i up to m: exact below 1000, asymptotic series above."""
    exact = F.aggregate(
        F.sequence(F.lit(1), F.least(m, F.lit(1000.0)).cast("int")),
        F.lit(0.0),
        lambda acc, i: acc + 1.0 / i,
    )
    series = F.log(m) + F.lit(0.5772156649015329) + 1 / (2 * m) - 1 / (12 * m * m)
    return F.when(m <= 1000, exact).otherwise(series)


def _second_stage(table, keys, method, alpha):
    factor = 1.0 + alpha if method == "fdr_tsbky" else 1.0
    hits = F.sum(F.when(F.col("_raw") <= alpha / factor, F.col("c")).otherwise(0))
    if keys:
        table = table.join(table.groupBy(*keys).agg(hits.alias("_r1")), keys)
    else:
        table = table.withColumn("_r1", table.agg(hits.alias("r")).scalar())
    share = F.when(
        (F.col("_r1") == 0) | (F.col("_r1") == F.col("m")), F.lit(1.0)
    ).otherwise((F.col("m") - F.col("_r1")) / F.col("m"))
    return table.withColumn("_raw", F.col("_raw") * share * factor)


def _hommel_table(valid, keys, p, out, small):
    """Hommel's values from the lower hull of the points (rank, p).

    Tasks reduce their points to hulls; the hull of those (size-checked) goes to every
    task, which then handles its distinct p-values on its own.
    """
    table = reuse(value_counts(valid, keys, p, small).select(*keys, p, "cum"))
    fields = {f.name: f.dataType.simpleString() for f in table.schema}
    key_ddl = "".join(f"`{k}` {fields[k]}, " for k in keys)

    def hulls(pdf: pd.DataFrame):
        groups = pdf.groupby(keys, sort=False) if keys else [((), pdf)]
        for key, g in groups:
            g = g.sort_values("cum")
            hx, hy = _lower_hull(g["cum"].to_numpy(float), g[p].to_numpy(float))
            yield key if isinstance(key, tuple) else (key,), hx, hy

    def local(batches):
        for pdf in batches:
            for key, hx, hy in hulls(pdf):
                part = pd.DataFrame({"x": hx, "y": hy})
                for name, value in zip(keys, key):
                    part[name] = value
                yield part[[*keys, "x", "y"]]

    points = table.mapInPandas(local, f"{key_ddl}x double, y double").limit(HULL_LIMIT + 1).collect()
    if len(points) > HULL_LIMIT:
        raise ValueError(f"hommel: hull of more than {HULL_LIMIT} points; use holm or fdr_bh")
    frame = pd.DataFrame([tuple(r) for r in points], columns=[*keys, "cum", p])
    hull = {key: (hx, hy) for key, hx, hy in hulls(frame)}

    def values(batches):
        for pdf in batches:
            groups = pdf.groupby(keys, sort=False) if keys else [((), pdf)]
            for key, g in groups:
                hx, hy = hull[key if isinstance(key, tuple) else (key,)]
                g = g[[*keys, p]].copy()
                # the last point of a group is its largest p, at rank n
                g[out] = np.minimum(1.0, _hommel_values(g[p].to_numpy(float), int(hx[-1]), hx, hy))
                yield g

    return table.mapInPandas(values, f"{key_ddl}`{p}` double, `{out}` double")


def _join_back(df, table, keys, p, out):
    return df.join(table, [*keys, p], "left").select(*df.columns, F.col(out))


def simple_fdr(df: DataFrame, p: str, tie: str, out: str = "fdr") -> DataFrame:
    """p * m / rank clipped to 1 and not made monotone (ranks by p, then `tie`)."""
    from genemill.operators.distributed import ordinal_ranks

    df = reuse(df)
    ranked = ordinal_ranks(df.filter(F.col(p).isNotNull()), [], p, tie, "_rank")
    total = ranked.agg(F.count(F.lit(1)).cast("double").alias("m")).scalar()
    return ranked.withColumn(out, F.least(F.lit(1.0), F.col(p) * total / F.col("_rank"))).drop("_rank")
