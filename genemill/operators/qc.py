"""Quality metrics, outliers, filters and the rules that turn them into advice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genemill.operators.distributed import fits, median_by, percentiles, reuse



def data_summary(expr: DataFrame) -> DataFrame:
    """One row of counts and ranges; averages over samples as in a matrix summary."""
    per = expr.groupBy("sample_id").agg(
        F.avg("value").alias("m"), F.stddev_samp("value").alias("s")
    )
    med = median_by(expr, ["sample_id"], "value", "med")
    base = expr.agg(
        F.count_distinct("gene_id").alias("n_genes"),
        F.count_distinct("sample_id").alias("n_samples"),
        F.count(F.lit(1)).alias("total_values"),
        F.count_if(F.col("value").isNull()).alias("missing_values"),
        F.count_if(F.col("value") == 0).alias("zero_values"),
        F.count_if(F.abs(F.col("value")) == float("inf")).alias("infinite_values"),
        F.count_if(F.col("value") < 0).alias("negative_values"),
        F.min(F.col("value")).alias("min"),
        F.max(F.col("value")).alias("max"),
    )
    for name in ("missing", "zero", "negative"):
        base = base.withColumn(f"{name}_ratio", F.col(f"{name}_values") / F.col("total_values"))
    return (
        base.withColumn("mean", per.agg(F.avg("m")).scalar())
        .withColumn("std", per.agg(F.avg("s")).scalar())
        .withColumn("median", median_by(med, [], "med", "x").scalar())
    )


def _metrics(expr: DataFrame, key: str, total: str, with_median: bool = False) -> DataFrame:
    """All metrics of a key in one pass; the median joins the same pass while groups are small."""
    extra, late = [], None
    if with_median and fits(expr, [key]):
        extra = [F.percentile("value", F.lit(0.5)).alias("median_expression")]
    elif with_median:
        late = percentiles(expr, [key], "value", {"median_expression": 0.5}, False)
    out = expr.groupBy(key).agg(
        *extra,
        F.count(F.lit(1)).alias(total),
        F.sum("value").alias("library_size"),
        F.count_if(F.col("value") > 0).alias("detected"),
        F.avg("value").alias("mean_expression"),
        F.stddev_samp("value").alias("std_expression"),
        F.var_samp("value").alias("variance"),
        F.count_if(F.col("value").isNull()).alias("missing_values"),
        F.count_if(F.col("value") == 0).alias("zero_values"),
    )
    if late is not None:
        out = out.join(late, key, "left")
    return (
        out.withColumn("detection_rate", F.col("detected") / F.col(total))
        .withColumn(
            "cv_expression",
            F.when(F.col("mean_expression") != 0, F.col("std_expression") / F.col("mean_expression")),
        )
        .withColumn("missing_pct", F.col("missing_values") / F.col(total) * 100)
        .withColumn("zero_pct", F.col("zero_values") / F.col(total) * 100)
    )


def sample_metrics(expr: DataFrame, with_median: bool = True) -> DataFrame:
    out = _metrics(expr, "sample_id", "total_genes", with_median).drop("variance")
    return out.withColumn("log_library_size", F.log2(F.col("library_size") + 1))


def gene_metrics(expr: DataFrame, with_median: bool = True) -> DataFrame:
    return _metrics(expr, "gene_id", "total_samples", with_median).drop("library_size")


def _long_metrics(samples: DataFrame, genes: DataFrame, s_cols, g_cols) -> DataFrame:
    s = samples.unpivot(["sample_id"], list(s_cols), "metric", "value").select(
        F.lit("sample").alias("level"), F.col("sample_id").alias("id"), "metric", "value"
    )
    g = genes.unpivot(["gene_id"], list(g_cols), "metric", "value").select(
        F.lit("gene").alias("level"), F.col("gene_id").alias("id"), "metric", "value"
    )
    return s.unionByName(g)


def distributions(expr: DataFrame) -> DataFrame:
    """Mean, deviation, quartiles and range of each sample and gene metric."""
    long = reuse(
        _long_metrics(
            sample_metrics(expr, False),
            gene_metrics(expr, False),
            ("library_size", "detection_rate"),
            ("mean_expression", "variance", "detection_rate"),
        )
    )
    keys = ["level", "metric"]
    q = percentiles(long, keys, "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return (
        long.groupBy(*keys)
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
        .join(q, keys)
    )


def outliers(expr: DataFrame, factor: float = 1.5) -> DataFrame:
    """Samples and genes outside the quartiles by more than `factor` IQR, per metric."""
    long = reuse(
        _long_metrics(
            sample_metrics(expr, False),
            gene_metrics(expr, False),
            ("library_size", "detection_rate", "mean_expression"),
            ("mean_expression", "variance", "detection_rate"),
        )
    )
    keys = ["level", "metric"]
    q = percentiles(long, keys, "value", {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    bounds = q.select(
        *keys, (F.col("q1") - factor * iqr).alias("lower"), (F.col("q3") + factor * iqr).alias("upper")
    )
    return long.join(bounds, keys).filter((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))


def _issues(df: DataFrame, level: str, key, rules: dict) -> DataFrame:
    """One row per broken rule: level, id, rule, measured value."""
    found = F.array_compact(
        F.array(
            *[
                F.when(cond, F.struct(F.lit(name).alias("issue"), val.cast("double").alias("measured")))
                for name, (cond, val) in rules.items()
            ]
        )
    )
    return df.select(F.lit(level).alias("level"), key.alias("id"), F.explode(found).alias("e")).select(
        "level", "id", "e.issue", "e.measured"
    )


def quality_flags(expr: DataFrame) -> DataFrame:
    """Samples, genes and whole-data properties beyond the fixed limits."""
    miss, zero = F.col("missing_pct"), F.col("zero_pct")
    lib, var = F.col("library_size"), F.col("variance")
    s = _issues(
        sample_metrics(expr, False),
        "sample",
        F.col("sample_id"),
        {
            "high_missing": (miss > 50, miss),
            "high_zero": (zero > 90, zero),
            "low_library": (lib < 1000, lib),
        },
    )
    g = _issues(
        gene_metrics(expr, False),
        "gene",
        F.col("gene_id"),
        {
            "high_missing": (miss > 50, miss),
            "high_zero": (zero > 90, zero),
            "zero_variance": (var == 0, var),
        },
    )
    whole = expr.agg(
        (F.count_if(F.col("value").isNull()) / F.count(F.lit(1)) * 100).alias("m"),
        (F.count_if(F.col("value") == 0) / F.count(F.lit(1)) * 100).alias("z"),
        (F.count_if(F.col("value") < 0) / F.count(F.lit(1)) * 100).alias("n"),
    )
    d = _issues(
        whole,
        "data",
        F.lit("all"),
        {
            "high_missing": (F.col("m") > 20, F.col("m")),
            "high_zero": (F.col("z") > 80, F.col("z")),
            "negative_values": (F.col("n") > 5, F.col("n")),
        },
    )
    return s.unionByName(g).unionByName(d)


def filtering_recommendations(expr: DataFrame) -> DataFrame:
    """One row of suggested limits, from percentiles of the metric tables."""
    s = percentiles(
        reuse(sample_metrics(expr, False).unpivot(["sample_id"], ["missing_pct", "zero_pct", "library_size"], "metric", "v")),
        ["metric"], "v", {"p05": 0.05, "p95": 0.95},
    )
    g = percentiles(
        reuse(gene_metrics(expr, False).unpivot(["gene_id"], ["missing_pct", "zero_pct", "variance"], "metric", "v")),
        ["metric"], "v", {"p10": 0.10, "p95": 0.95},
    )
    one = lambda df, m, col: df.filter(F.col("metric") == m).select(col).scalar()
    counts = expr.agg(
        F.count_distinct("gene_id").alias("n_genes"), F.count_distinct("sample_id").alias("n_samples")
    )
    return counts.select(
        F.least(F.lit(50.0), one(s, "missing_pct", "p95")).alias("sample_max_missing"),
        F.least(F.lit(90.0), one(s, "zero_pct", "p95")).alias("sample_max_zero"),
        F.greatest(F.lit(1000.0), one(s, "library_size", "p05")).alias("sample_min_library"),
        F.least(F.lit(50.0), one(g, "missing_pct", "p95")).alias("gene_max_missing"),
        F.least(F.lit(90.0), one(g, "zero_pct", "p95")).alias("gene_max_zero"),
        one(g, "variance", "p10").alias("gene_min_variance"),
        F.greatest(F.lit(1000.0), F.col("n_genes") * 0.1).alias("min_genes_per_sample"),
        F.greatest(F.lit(5.0), F.col("n_samples") * 0.1).alias("min_samples_per_gene"),
        F.least(F.lit(10000.0), F.col("n_genes") * 0.8).alias("min_variance_genes"),
    )


def filter_qc(
    expr: DataFrame,
    max_missing: float = 50,
    max_zero: float = 90,
    min_library: float = 1000,
    gene_max_missing: float = 50,
    gene_max_zero: float = 90,
    gene_min_variance: float = 0,
) -> DataFrame:
    """Keep good samples and good genes, both judged on the unfiltered matrix."""
    s = sample_metrics(expr, False).filter(
        (F.col("missing_pct") <= max_missing)
        & (F.col("zero_pct") <= max_zero)
        & (F.col("library_size") >= min_library)
    )
    g = gene_metrics(expr, False).filter(
        (F.col("missing_pct") <= gene_max_missing)
        & (F.col("zero_pct") <= gene_max_zero)
        & (F.col("variance") >= gene_min_variance)
    )
    return expr.join(s, "sample_id", "left_semi").join(g, "gene_id", "left_semi")


def filter_low_quality_samples(expr, min_library: float = 1000, min_detected: int = 100) -> DataFrame:
    good = sample_metrics(expr, False).filter(
        (F.col("library_size") >= min_library) & (F.col("detected") >= min_detected)
    )
    return expr.join(good, "sample_id", "left_semi")


def filter_low_quality_genes(expr, min_variance: float = 0.1, min_detection: float = 0.1) -> DataFrame:
    good = gene_metrics(expr, False).filter(
        (F.col("variance") >= min_variance) & (F.col("detection_rate") >= min_detection)
    )
    return expr.join(good, "gene_id", "left_semi")


def filter_sequential(
    expr, min_detection: float = 0.1, min_variance: float = 0.0, max_missing: float = 0.5
) -> DataFrame:
    """Detection, then variance (skipped at 0), then missing share, per gene."""
    keep = F.lit(True)
    if min_detection > 0:
        keep = keep & (F.col("detection_rate") >= min_detection)
    if min_variance > 0:
        keep = keep & (F.col("variance") >= min_variance)
    if max_missing < 1:
        keep = keep & (F.col("missing_values") / F.col("total_samples") <= max_missing)
    return expr.join(gene_metrics(expr, False).filter(keep), "gene_id", "left_semi")


def shape_change(before: DataFrame, after: DataFrame) -> DataFrame:
    shape = lambda d: d.agg(
        F.count_distinct("gene_id").alias("genes"), F.count_distinct("sample_id").alias("samples")
    )
    b, a = shape(before), shape(after)
    out = b.select(F.col("genes").alias("genes_before"), F.col("samples").alias("samples_before"))
    out = out.withColumn("genes_after", a.select("genes").scalar()).withColumn(
        "samples_after", a.select("samples").scalar()
    )
    return out.withColumn("genes_removed", F.col("genes_before") - F.col("genes_after")).withColumn(
        "samples_removed", F.col("samples_before") - F.col("samples_after")
    )


def qc_summary(expr: DataFrame) -> DataFrame:
    """Warnings with advice, one row each, and nothing when the data are clean."""
    sm, gm = reuse(sample_metrics(expr, False)), reuse(gene_metrics(expr, False))
    v = expr.agg(
        (F.count_if(F.col("value").isNull()) / F.count(F.lit(1))).alias("missing"),
        (F.count_if(F.col("value") == 0) / F.count(F.lit(1))).alias("zero"),
        F.count_if(F.col("value") < 0).cast("double").alias("negative"),
    )
    cv = lambda c: F.stddev_samp(c) / (F.avg(c) + 1e-12)
    v = (
        v.withColumn("lib_cv", sm.agg(cv("library_size")).scalar())
        .withColumn("det_cv", sm.agg(cv("detection_rate")).scalar())
        .withColumn("flat", gm.agg(F.count_if(F.col("variance") == 0).cast("double")).scalar())
        .withColumn("rare", gm.agg(F.count_if(F.col("detection_rate") < 0.1).cast("double")).scalar())
        .withColumn(
            "out",
            outliers(expr).filter("level = 'sample'").agg(F.count(F.lit(1)).cast("double")).scalar(),
        )
    )
    c = F.col
    rules = {
        "missing_ratio": (c("missing") > 0.1, c("missing"), "impute or remove samples and genes with many missing values"),
        "zero_ratio": (c("zero") > 0.8, c("zero"), "filter low-expressed genes or model the zeros"),
        "negative_values": (c("negative") > 0, c("negative"), "check preprocessing; consider a log transform"),
        "library_size_cv": (c("lib_cv") > 0.5, c("lib_cv"), "normalise for library size"),
        "detection_rate_cv": (c("det_cv") > 0.3, c("det_cv"), "look for technical artefacts or batches"),
        "zero_variance_genes": (c("flat") > 0, c("flat"), "remove genes without variance"),
        "low_detection_genes": (c("rare") > 0, c("rare"), "filter genes seen in few samples"),
        "sample_outliers": (c("out") > 0, c("out"), "review the outlying samples"),
    }
    items = F.array_compact(
        F.array(
            *[
                F.when(
                    cond,
                    F.struct(F.lit(n).alias("warning"), val.alias("measured"), F.lit(a).alias("advice")),
                )
                for n, (cond, val, a) in rules.items()
            ]
        )
    )
    return v.select(F.explode(items).alias("w")).select("w.warning", "w.measured", "w.advice")
