"""Matrix normalisation on long tables (gene_id, sample_id, value).

Statistics of a gene or sample are aggregated first and joined back, never
computed in a window over the whole gene or sample: the aggregate combines
map-side and the join can be split when one key is very large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genemill.operators.distributed import fits, median_by, ordinal_ranks, percentiles, reuse

MATRIX = ("gene_id", "sample_id", "value")


def with_stats(df: DataFrame, keys: Sequence[str], *aggs) -> DataFrame:
    """Join grouped aggregates back on their keys."""
    return df.join(df.groupBy(*keys).agg(*aggs), list(keys))


def _replace_value(df: DataFrame, value, cols=None) -> DataFrame:
    keep = [c for c in (cols or df.columns) if c != "value"]
    return df.select(*keep, value.alias("value"))


def log_cpm(expr: DataFrame, prior: float = 1.0, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """log2 of counts per million of the sample's library plus a prior."""
    scaled = with_stats(expr, keys, F.sum("value").alias("_lib"))
    cpm = F.when(F.col("_lib") != 0, F.col("value") * 1e6 / F.col("_lib"))
    return _replace_value(scaled, F.log2(cpm + prior), expr.columns)


def log_tpm(expr: DataFrame, prior: float = 1.0) -> DataFrame:
    return _replace_value(expr, F.log2(F.col("value") + prior))


def quantile_normalize(expr: DataFrame, by: str = "sample_id", small: bool | None = None) -> DataFrame:
    """Give every sample the same distribution: the mean, over samples, at each ordinal rank."""
    present = reuse(expr.filter(F.col("value").isNotNull()))
    ranked = ordinal_ranks(present, [by], "value", "gene_id", "_rank", small=small)
    target = ranked.groupBy("_rank").agg(F.avg("value").alias("_q"))
    joined = ranked.drop("value").join(target, "_rank")
    return joined.select(*[c if c != "value" else F.col("_q").alias("value") for c in expr.columns])


def z_score(expr: DataFrame, keys: Sequence[str] = ("gene_id",), ddof: int = 0) -> DataFrame:
    """Centre and scale by population (ddof 0) or sample (ddof 1) deviation.

    A zero deviation counts as 1 with ddof 0; with ddof 1 the result is null.
    """
    std = F.stddev_pop("value") if ddof == 0 else F.stddev_samp("value")
    s = with_stats(expr, keys, F.avg("value").alias("_m"), std.alias("_s"))
    gap = F.col("value") - F.col("_m")
    zero = gap if ddof == 0 else F.lit(None).cast("double")
    z = F.when(F.col("_s") > 0, gap / F.col("_s")).otherwise(zero)
    return _replace_value(s, z, expr.columns)


def z_score_by_sample(expr: DataFrame, ddof: int = 1) -> DataFrame:
    return z_score(expr, ("sample_id",), ddof)


def robust_z_iqr(expr: DataFrame, keys: Sequence[str] = ("gene_id",)) -> DataFrame:
    """(x - median) / IQR; a zero IQR counts as 1."""
    expr = reuse(expr)
    q = percentiles(expr, keys, "value", {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    iqr = F.col("_q3") - F.col("_q1")
    gap = F.col("value") - F.col("_q2")
    joined = expr.join(q, list(keys))
    return _replace_value(joined, F.when(iqr > 0, gap / iqr).otherwise(gap), expr.columns)


def robust_z_mad(expr: DataFrame, keys: Sequence[str] = ("gene_id",), kind: str = "median") -> DataFrame:
    """(x - median) / MAD, with the median (default) or mean absolute deviation; null at zero."""
    expr = reuse(expr)
    small = fits(expr, keys)
    half = {"_med": 0.5}
    med = expr.join(percentiles(expr, keys, "value", half, small), list(keys))
    if kind == "mean":
        mad = expr.join(expr.groupBy(*keys).agg(F.avg("value").alias("_avg")), list(keys))
        mad = mad.groupBy(*keys).agg(F.avg(F.abs(F.col("value") - F.col("_avg"))).alias("_mad"))
    else:
        dev = med.withColumn("_dev", F.abs(F.col("value") - F.col("_med")))
        mad = percentiles(dev, keys, "_dev", {"_mad": 0.5}, small)
    joined = med.join(mad, list(keys))
    z = F.when(F.col("_mad") > 0, (F.col("value") - F.col("_med")) / F.col("_mad"))
    return _replace_value(joined, z, expr.columns)


def min_max(expr: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Global minimum and maximum mapped to [low, high]."""
    bounds = expr.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    scaled = F.when(hi > lo, (F.col("value") - lo) / (hi - lo)).otherwise(F.lit(0.0))
    return _replace_value(expr, scaled * (high - low) + low)


def size_factors(expr: DataFrame, pseudo: float = 1.0) -> DataFrame:
    """Median over genes of value / geometric mean, per sample."""
    expr = reuse(expr)
    geo = expr.groupBy("gene_id").agg(F.exp(F.avg(F.log(F.col("value") + pseudo))).alias("_geo"))
    ratio = expr.join(geo, "gene_id").select(
        "sample_id", (F.col("value") / F.col("_geo")).alias("ratio")
    )
    return median_by(ratio, ["sample_id"], "ratio", "size_factor")


def median_ratio(expr: DataFrame, pseudo: float = 1.0) -> DataFrame:
    expr = reuse(expr)
    joined = expr.join(size_factors(expr, pseudo), "sample_id")
    factor = F.col("size_factor")
    return _replace_value(joined, F.when(factor != 0, F.col("value") / factor), expr.columns)


def reference_sample(expr: DataFrame) -> DataFrame:
    """The sample whose library is nearest to the median library (one row: ref)."""
    libs = reuse(expr.groupBy("sample_id").agg(F.sum("value").alias("lib")))
    med = median_by(libs, [], "lib", "m").scalar()
    return libs.orderBy(F.abs(F.col("lib") - med), "sample_id").limit(1).select(
        F.col("sample_id").alias("ref")
    )


def tmm_factors(
    expr: DataFrame, ref_sample: str | None = None, trim: float = 0.3, base: str = "e"
) -> DataFrame:
    """Trimmed mean of M-values against the reference sample."""
    expr = reuse(expr)
    # one row, needed in several places: a constant of the plan
    ref = F.lit(ref_sample or reference_sample(expr).first()[0])
    refs = expr.filter(F.col("sample_id") == ref).select("gene_id", F.col("value").alias("_ref"))
    x, r = F.col("value") + 1, F.col("_ref") + 1
    # the mean of the logarithms by the product: genes of equal product are equal, and both lie on a cut or neither
    ma = expr.join(refs, "gene_id").select(
        "sample_id", (F.log2(x) - F.log2(r)).alias("m"), (0.5 * F.log2(x * r)).alias("a")
    )
    cuts = percentiles(ma, ["sample_id"], "a", {"_lo": trim, "_hi": 1 - trim})
    kept = ma.join(cuts, "sample_id").filter(F.col("a").between(F.col("_lo"), F.col("_hi")))
    w = 1 / (1 + F.col("a"))
    mean_m = F.sum(w * F.col("m")) / F.sum(w)
    factor = F.exp(mean_m) if base == "e" else F.pow(F.lit(2.0), mean_m)
    found = kept.groupBy("sample_id").agg(factor.alias("size_factor"))
    return found.withColumn(
        "size_factor", F.when(F.col("sample_id") == ref, F.lit(1.0)).otherwise(F.col("size_factor"))
    )


def tmm(expr: DataFrame, ref_sample: str | None = None, base: str = "e") -> DataFrame:
    expr = reuse(expr)
    joined = expr.join(tmm_factors(expr, ref_sample, base=base), "sample_id")
    return _replace_value(joined, F.col("value") / F.col("size_factor"), expr.columns)


METHODS = {
    "log_cpm": log_cpm,
    "log_tpm": log_tpm,
    "quantile": quantile_normalize,
    "z_score": z_score,
    "robust_z_score": robust_z_iqr,
    "min_max": min_max,
    "median_ratio": median_ratio,
    "tmm": tmm,
}


def normalize(expr: DataFrame, method: str = "log_cpm", **options) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown normalization {method}; use one of {sorted(METHODS)}")
    if expr.isEmpty():
        raise ValueError("expression table is empty")
    return METHODS[method](expr, **options)


FINAL = {
    "zscore": z_score,
    "robust_zscore": robust_z_iqr,
    "quantile": quantile_normalize,
    "median_ratio": lambda e: median_ratio(e, 1e-10),
}


def final_normalization(expr: DataFrame, method: str = "none") -> DataFrame:
    """Last stage of the staged pipeline; an unknown name leaves the data as they are."""
    return FINAL[method](expr) if method in FINAL else expr


def staged_normalize(
    expr: DataFrame,
    samples: DataFrame | None = None,
    transform: str = "log2",
    batch_method: str | None = None,
    final: str = "none",
) -> DataFrame:
    """Transform, then batch correction, then final normalisation, in one lazy plan."""
    from genemill.operators import batch, transform as tf

    out = tf.transform(expr, transform) if transform and transform != "none" else expr
    if batch_method and samples is not None:
        out = batch.correct(out, samples, batch_method)
    return final_normalization(out, final)


def bias_corrected_skew(col: str):
    """Sample skewness as pandas gives it, from Spark's population skewness."""
    n = F.count(col).cast("double")
    return F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(col))


def bias_corrected_kurtosis(col: str):
    n = F.count(col).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col) + 6))


def value_stats(expr: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """mean, std, min, max, skewness and kurtosis of the values, whole or per key."""
    aggs = [
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        bias_corrected_skew("value").alias("skewness"),
        bias_corrected_kurtosis("value").alias("kurtosis"),
    ]
    expr = reuse(expr)
    if fits(expr, keys):
        aggs.append(F.percentile("value", F.lit(0.5)).alias("median"))
        return expr.groupBy(*keys).agg(*aggs) if keys else expr.agg(*aggs)
    out = expr.groupBy(*keys).agg(*aggs) if keys else expr.agg(*aggs)
    med = percentiles(expr, keys, "value", {"median": 0.5}, False)
    return out.join(med, list(keys)) if keys else out.withColumn("median", med.scalar())


def tagged(frames: dict[str, DataFrame], tag: str = "method") -> DataFrame:
    """Stack frames of one shape with the name of each in a column."""
    out = None
    for name, df in frames.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def normalization_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    return value_stats(tagged({"before": before, "after": after}, "stage"), ["stage"])


def compare_methods(expr: DataFrame, methods: Sequence[str]) -> DataFrame:
    return value_stats(tagged({m: normalize(expr, m) for m in methods}), ["method"])


def detect_scale(expr: DataFrame) -> DataFrame:
    """One row: what kind of values the table seems to hold."""
    v = F.col("value")
    skew = expr.groupBy("gene_id").agg(bias_corrected_skew("value").alias("sk"))
    share = skew.agg(F.avg(F.when(F.col("sk") > 0, 1.0).otherwise(0.0)).alias("s")).scalar()
    base = expr.agg(
        F.coalesce(F.bool_or(v < 0), F.lit(False)).alias("has_negative"),
        F.coalesce(F.bool_or(v % 1 != 0), F.lit(False)).alias("has_decimals"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    ).withColumn("positive_skew_share", share)
    kind = (
        F.when(F.col("has_negative"), "z_score")
        .when(~F.col("has_decimals") & (F.col("max") < 100), "raw_counts")
        .when(F.col("positive_skew_share") > 0.7, "log_transformed")
        .when(F.col("has_decimals"), "tpm_fpkm")
        .otherwise("unknown")
    )
    return base.withColumn("detected", kind)
