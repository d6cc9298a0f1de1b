"""Distribution transforms on long tables, and how normal their results look."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genemill.functions.special import norm_ppf, norm_sf2
from genemill.operators.distributed import ordinal_ranks, ranks, reuse
from genemill.operators.normalize import (
    bias_corrected_kurtosis,
    bias_corrected_skew,
    robust_z_mad,
    tagged,
    value_stats,
    z_score,
)
from genemill.session import ensure_checkpoint_dir


def _on_value(expr: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    return expr.withColumn("value", fn(F.col("value")))


def log2(expr, prior: float = 1.0):
    return _on_value(expr, lambda v: F.log2(v + prior))


def log10(expr, prior: float = 1.0):
    return _on_value(expr, lambda v: F.log10(v + prior))


def sqrt(expr):
    return _on_value(expr, F.sqrt)


def custom(expr: DataFrame, func: Callable[[Column], Column]) -> DataFrame:
    """Any Column -> Column function (a built-in expression or an Arrow pandas_udf)."""
    return _on_value(expr, func)


# Both power families share one form: with L = log of the (shifted) size of x, sign s and
# exponent m, the value is s * (exp(m L) - 1) / m, and s * L where m is 0.


def _power_terms(kind: str) -> tuple[Column, Column]:
    """(L, s) of a value."""
    x = F.col("value")
    if kind == "yeo-johnson":
        return F.log1p(F.abs(x)), F.when(x >= 0, 1.0).otherwise(-1.0)
    if kind == "box-cox":
        return F.log(x), F.lit(1.0)
    raise ValueError(f"unknown power transform {kind}")


def _power_value(lam: Column, kind: str) -> Column:
    """The transform of a row that carries its L and s."""
    size, sign = F.col("_L"), F.col("_s")
    m = F.when(sign > 0, lam).otherwise(2 - lam) if kind == "yeo-johnson" else lam
    return sign * F.when(F.abs(m) < 1e-12, size).otherwise(F.expm1(m * size) / m)


def _power_slopes(lam: Column, kind: str) -> tuple[Column, Column]:
    """First and second derivative by lambda of the transform of a row with `_L`, `_s` and its value `_p`."""
    size, sign = F.col("_L"), F.col("_s")
    m = F.when(sign > 0, lam).otherwise(2 - lam) if kind == "yeo-johnson" else lam
    t = m * size
    near = F.abs(t) < 1e-2  # the closed forms lose digits there: Taylor terms instead
    sq, up = size * size, F.exp(t)
    one = F.when(near, sq * _poly((1 / 2, 1 / 3, 1 / 8, 1 / 30, 1 / 144), t)).otherwise((size * up - sign * F.col("_p")) / m)
    two = F.when(near, sq * size * _poly((1 / 3, 1 / 4, 1 / 10, 1 / 36, 1 / 168), t)).otherwise((sq * up - 2 * one) / m)
    return one, sign * two


def power_lambdas(expr: DataFrame, kind: str = "yeo-johnson", key: str = "gene_id") -> DataFrame:
    """Maximum-likelihood lambda per gene, to 1/4096 (1 where all values are equal).

    The log-likelihood is concave in lambda, so its derivative has one zero. Each pass is one aggregation of variances
    and covariances of the transform and its two derivatives, from which every gene takes a Newton step inside the
    bracket known so far; it ends when no gene moves by more than 1/8192. A last pass compares the four multiples of
    1/4096 around the zero (ties: the smallest). A likelihood that rises up to `MAX_LAMBDA` has no maximum and gives
    a value there.
    """
    ensure_checkpoint_dir(expr.sparkSession)
    size, sign = _power_terms(kind)
    rows = expr.filter(F.col("value").isNotNull())
    data = reuse(rows.select(key, size.alias("_L"), sign.alias("_s")))
    state = data.groupBy(key).agg(F.count("_L").alias("_n"), F.sum(F.col("_s") * F.col("_L")).alias("_j")).withColumns(
        {"lambda": F.lit(1.0), "_lo": F.lit(-MAX_LAMBDA), "_hi": F.lit(MAX_LAMBDA), "_good": F.lit(1.0), "_move": F.lit(1.0)}
    )
    closed = []
    while True:
        state = _newton_step(data, state, kind, key).checkpoint()
        closed.append(state.filter(F.abs("_move") <= 1 / 8192))
        state = state.filter(F.abs("_move") > 1 / 8192)
        if state.isEmpty():
            break
    zero = reduce(DataFrame.unionByName, closed)
    return _best_multiple(data, zero, kind, key)


MAX_LAMBDA = 512.0  # the power of a double is out of range before this; a likelihood that still rises has no maximum
_STRIDE = 8.0  # a longer Newton step is cut to this


def _newton_step(data: DataFrame, state: DataFrame, kind: str, key: str) -> DataFrame:
    """The next lambda and bracket of every gene of `state`.

    `_good` is the last lambda with a finite positive variance. Where the variance leaves that range, the place is an end
    of the bracket and the next lambda lies halfway to `_good`.
    """
    moved = data.join(state, key).withColumn("_p", _power_value(F.col("lambda"), kind))
    one, two = _power_slopes(F.col("lambda"), kind)
    moved = moved.withColumn("_d", one).withColumn("_dd", two)
    kept = [F.any_value(c).alias(c) for c in ("_n", "_j", "lambda", "_lo", "_hi", "_good")]
    g = moved.groupBy(key).agg(
        F.var_pop("_p").alias("_v"), F.covar_pop("_p", "_d").alias("_c"),
        F.var_pop("_d").alias("_w"), F.covar_pop("_p", "_dd").alias("_e"), *kept,
    )
    lam, v, c = F.col("lambda"), F.col("_v"), F.col("_c")
    big = float("inf")
    ok = (v > 0) & (v < big) & ~F.isnan("_c") & (F.abs("_c") < big)
    slope = F.col("_j") / F.col("_n") - c / v
    bend = -(F.col("_w") + F.col("_e")) / v + 2 * (c / v) * (c / v)
    g = g.withColumns({"_ok": ok, "_g": F.when(ok, slope), "_b": F.when(ok, bend)})
    rising, falling = F.col("_g") > 0, F.col("_g") < 0
    past = ~F.col("_ok") & (lam > F.col("_good"))
    short = ~F.col("_ok") & (lam < F.col("_good"))
    g = g.withColumns({
        "_lo": F.when(rising | short, F.greatest("_lo", "lambda")).otherwise(F.col("_lo")),
        "_hi": F.when(falling | past, F.least("_hi", "lambda")).otherwise(F.col("_hi")),
        "_good": F.when(F.col("_ok"), lam).otherwise(F.col("_good")),
    })
    newton = F.when((F.col("_b") < 0) & (F.col("_b") > -big), -F.col("_g") / F.col("_b")).otherwise(F.signum("_g") * _STRIDE)
    newton = lam + F.greatest(F.lit(-_STRIDE), F.least(F.lit(_STRIDE), newton))
    inside = (newton > F.col("_lo")) & (newton < F.col("_hi"))
    halves = (F.greatest(F.col("_lo"), lam - _STRIDE) + F.least(F.col("_hi"), lam + _STRIDE)) / 2
    to = (
        F.when(~F.col("_ok"), (lam + F.col("_good")) / 2)  # stays where it is when no lambda was good
        .when(F.col("_g") == 0, lam)
        .when(inside, newton)
        .otherwise(halves)
    )
    return g.withColumn("_to", to).select(
        key, "_n", "_j", F.col("_to").alias("lambda"), "_lo", "_hi", "_good", (F.col("_to") - lam).alias("_move")
    )


def _best_multiple(data: DataFrame, zero: DataFrame, kind: str, key: str) -> DataFrame:
    """The most likely of the four multiples of 1/4096 around each gene's `lambda`; 1 where none has a variance."""
    base = zero.select(key, "_n", "_j", (F.floor(F.col("lambda") * 4096) / 4096).alias("_base"))
    offsets = [i / 4096 for i in range(-1, 3)]
    spread = [F.var_pop(_power_value(F.col("_base") + o, kind)).alias(f"_v{i}") for i, o in enumerate(offsets)]
    g = data.join(base, key).groupBy(key).agg(F.any_value("_n").alias("_n"), F.any_value("_j").alias("_j"), F.any_value("_base").alias("_base"), *spread)
    tried = []
    for i, o in enumerate(offsets):
        v, lam = F.col(f"_v{i}"), F.col("_base") + o
        ll = F.when((v > 0) & (v < float("inf")), -F.col("_n") / 2 * F.log(v) + (lam - 1) * F.col("_j"))
        tried.append(F.struct(ll.alias("ll"), (-lam).alias("f")))
    top = F.array_max(F.filter(F.array(*tried), lambda x: x["ll"].isNotNull()))
    return g.withColumn("_top", top).select(key, F.coalesce(-F.col("_top.f"), F.lit(1.0)).alias("lambda"))


def power_transform(expr: DataFrame, kind: str = "yeo-johnson", standardize: bool = True) -> DataFrame:
    """Yeo-Johnson, or Box-Cox for positive values, then zero mean and unit variance per gene."""
    expr = reuse(expr)
    if kind == "box-cox" and not expr.filter(F.col("value") <= 0).isEmpty():
        raise ValueError("box-cox needs positive values")
    size, sign = _power_terms(kind)
    moved = expr.join(power_lambdas(expr, kind), "gene_id").withColumns({"_L": size, "_s": sign})
    out = moved.withColumn("value", _power_value(F.col("lambda"), kind)).select(*expr.columns)
    return z_score(reuse(out), ("gene_id",), 0) if standardize else out


def rank_transform(expr: DataFrame, method: str = "average") -> DataFrame:
    """Rank of each sample within its gene."""
    out = ranks(expr, ["gene_id"], "value", "_r", method, tie="sample_id")
    return out.withColumn("value", F.col("_r").cast("double")).drop("_r")


def quantile_transform(expr: DataFrame, output: str = "uniform") -> DataFrame:
    """Per gene (average rank - 1) / (n - 1), or its normal quantile."""
    expr = reuse(expr)
    r = ranks(expr, ["gene_id"], "value", "_r", "average")
    n = expr.groupBy("gene_id").agg(F.count("value").alias("_n"))
    u = F.when(F.col("_n") > 1, (F.col("_r") - 1) / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    out = r.join(n, "gene_id").withColumn("value", u).drop("_r", "_n")
    if output == "normal":
        clipped = F.least(F.greatest(F.col("value"), F.lit(1e-7)), F.lit(1 - 1e-7))
        out = out.withColumn("value", norm_ppf(clipped))
    return out


METHODS = {
    "log2": log2,
    "log10": log10,
    "sqrt": sqrt,
    "box_cox": lambda e, **o: power_transform(e, o.get("kind", "yeo-johnson")),
    "yeo_johnson": lambda e: power_transform(e, "yeo-johnson"),
    "quantile": quantile_transform,
    "rank": rank_transform,
    "z_score": lambda e: z_score(e, ("gene_id",), 1),
    "robust_z_score": robust_z_mad,
    "custom": custom,
}


def transform(expr: DataFrame, method: str = "log2", **options) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown transform {method}; use one of {sorted(METHODS)}")
    return METHODS[method](expr, **options)


# Polynomial coefficients of Royston's 1995 approximation to Shapiro-Wilk.
_C1 = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_C3 = (0.544, -0.39978, 0.025054, -6.714e-4)
_C4 = (1.3822, -0.77857, 0.062767, -0.0020322)
_C5 = (-1.5861, -0.31082, -0.083751, 0.0038915)
_C6 = (-0.4803, -0.082676, 0.0030302)


def _poly(coefs: Sequence[float], x: Column) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefs):
        out = out * x + c
    return out


def shapiro_wilk(expr: DataFrame, key: str = "gene_id", unit: str = "sample_id") -> DataFrame:
    """W and p per gene: one ranking and one aggregation; the weights depend on (rank, n) only."""
    data = reuse(expr.filter(F.col("value").isNotNull()))
    size = data.groupBy(key).agg(
        F.count("value").cast("double").alias("n"),
        (F.var_pop("value") * F.count("value")).alias("_ss"),
        F.avg("value").alias("_mean"),
    ).filter((F.col("n") >= 4) & (F.col("_ss") > 0))
    ranked = ordinal_ranks(data, [key], "value", unit, "_r").join(size, key)
    ranked = ranked.withColumn("m", norm_ppf((F.col("_r") - 0.375) / (F.col("n") + 0.25)))
    r, n, wide = F.col("_r"), F.col("n"), F.col("n") > 5
    off = F.col("value") - F.col("_mean")
    at = lambda place, x: F.max(F.when(r == place, x))
    ends = (r == 1) | (r == n) | (wide & ((r == 2) | (r == n - 1)))
    g = ranked.groupBy(key, "n", "_ss").agg(
        F.sum(F.col("m") * F.col("m")).alias("_ssm"),
        F.sum(F.when(~ends, F.col("m") * off).otherwise(0.0)).alias("_mid"),
        at(n, F.col("m")).alias("_mn"),
        at(n - 1, F.col("m")).alias("_mp"),
        (at(n, off) - at(F.lit(1), off)).alias("_outer"),
        (at(n - 1, off) - at(F.lit(2), off)).alias("_inner"),
    )
    u = 1 / F.sqrt("n")
    root = F.sqrt("_ssm")
    g = g.withColumn("_an", F.col("_mn") / root + _poly(_C1, u))
    g = g.withColumn("_ap", F.col("_mp") / root + _poly(_C2, u))
    phi = F.when(
        wide,
        (F.col("_ssm") - 2 * F.pow("_mn", F.lit(2)) - 2 * F.pow("_mp", F.lit(2)))
        / (1 - 2 * F.pow("_an", F.lit(2)) - 2 * F.pow("_ap", F.lit(2))),
    ).otherwise(
        (F.col("_ssm") - 2 * F.pow("_mn", F.lit(2))) / (1 - 2 * F.pow("_an", F.lit(2)))
    )
    total = F.col("_an") * F.col("_outer") + F.col("_mid") / F.sqrt(phi)
    g = g.withColumn("_t", total + F.when(wide, F.col("_ap") * F.col("_inner")).otherwise(0.0))
    w = F.least(F.lit(1 - 1e-15), F.col("_t") * F.col("_t") / F.col("_ss"))
    g = g.withColumn("w", w)
    ln = F.log("n")
    small_y = -F.log(0.459 * n - 2.273 - F.log(1 - F.col("w")))
    z = F.when(
        n <= 11, (small_y - _poly(_C3, n)) / F.exp(_poly(_C4, n))
    ).otherwise((F.log(1 - F.col("w")) - _poly(_C5, ln)) / F.exp(_poly(_C6, ln)))
    g = g.withColumn("_z", z)
    half = norm_sf2(F.abs("_z")) / 2
    g = g.withColumn("_h", half)
    return g.select(
        key,
        F.col("n").cast("long").alias("n"),
        "w",
        F.when(F.col("_z") >= 0, F.col("_h")).otherwise(1 - F.col("_h")).alias("p_value"),
    )


def normality_scores(expr: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of a skewness score, a kurtosis score and the mean Shapiro p over all genes."""
    keys = list(keys)
    unit = F.concat_ws("\u0001", *keys, "gene_id") if keys else F.col("gene_id")
    data = expr.withColumn("_unit", unit)
    shape = data.groupBy("_unit", *keys).agg(
        bias_corrected_skew("value").alias("sk"), bias_corrected_kurtosis("value").alias("ku")
    )
    sw = shapiro_wilk(data, "_unit").select("_unit", "p_value")
    joined = shape.join(sw, "_unit", "left")
    aggs = [
        F.abs(F.avg(F.nanvl("sk", F.lit(None)))).alias("mean_skewness"),
        F.abs(F.avg(F.nanvl("ku", F.lit(None)))).alias("mean_kurtosis"),
        F.avg(F.coalesce("p_value", F.lit(0.0))).alias("mean_shapiro_p"),
    ]
    out = joined.groupBy(*keys).agg(*aggs) if keys else joined.agg(*aggs)
    out = out.withColumn(
        "skewness_score", F.greatest(F.lit(0.0), 1 - F.col("mean_skewness") / 2)
    ).withColumn("kurtosis_score", F.greatest(F.lit(0.0), 1 - F.col("mean_kurtosis") / 10))
    total = F.col("skewness_score") + F.col("kurtosis_score") + F.col("mean_shapiro_p")
    return out.withColumn("overall_score", total / 3)


def best_transformation(expr: DataFrame, methods: Sequence[str] = ("log2", "log10", "sqrt")) -> DataFrame:
    """Scores per method, the best one flagged."""
    expr = reuse(expr)
    scores = normality_scores(tagged({m: transform(expr, m) for m in methods}), ["method"])
    # a row for each method: a window over them all, so that the scores are worked out once
    best = F.max_by("method", F.struct("overall_score", "method")).over(Window.partitionBy())
    return scores.withColumn("is_best", F.col("method") == best)


def transformation_stats(expr: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Whole-table values plus the mean and deviation of per-gene skewness and kurtosis."""
    keys = list(keys)
    v = F.col("value")
    shape = expr.groupBy(*keys, "gene_id").agg(
        bias_corrected_skew("value").alias("sk"), bias_corrected_kurtosis("value").alias("ku")
    )
    two = [
        F.avg(F.nanvl("sk", F.lit(None))).alias("skewness_mean"),
        F.stddev_samp(F.nanvl("sk", F.lit(None))).alias("skewness_std"),
        F.avg(F.nanvl("ku", F.lit(None))).alias("kurtosis_mean"),
        F.stddev_samp(F.nanvl("ku", F.lit(None))).alias("kurtosis_std"),
    ]
    one = [
        F.count_if(v.isNull()).alias("missing"),
        F.count_if(F.abs(v) == float("inf")).alias("infinite"),
        F.count_if(v < 0).alias("negative"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    ]
    if keys:
        return expr.groupBy(*keys).agg(*one).join(shape.groupBy(*keys).agg(*two), keys)
    base, moments = expr.agg(*one), shape.agg(*two)
    for name in ("skewness_mean", "skewness_std", "kurtosis_mean", "kurtosis_std"):
        base = base.withColumn(name, moments.select(name).scalar())
    return base


def compare_transformations(expr: DataFrame, methods: Sequence[str]) -> DataFrame:
    return value_stats(tagged({m: transform(expr, m) for m in methods}), ["method"])
