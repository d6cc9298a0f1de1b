"""Per-gene tests on a long table (gene_id, sample_id, value) and a sample table.

Moments come from one `groupBy(gene)` with partial aggregation, so a gene with
very many samples is combined map-side. Nulls are dropped per gene and the
number of values used is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genemill.functions.special import chi2_sf, f_sf, mwu_exact, norm_sf2, t_sf2
from genemill.operators.distributed import (
    fits,
    median_by,
    ordered_scan,
    percentiles,
    ordinal_ranks,
    ranks,
    reuse,
    value_counts,
)
from genemill.operators.padjust import adjust_p, simple_fdr


def labelled(expr: DataFrame, samples: DataFrame, label: str) -> DataFrame:
    """Inner alignment of values with one sample column, without null cells."""
    side = samples.filter(F.col(label).isNotNull()).select("sample_id", F.col(label).alias("grp"))
    return expr.filter(F.col("value").isNotNull()).join(side, "sample_id").select(
        "gene_id", "sample_id", "value", "grp"
    )


def two_levels(samples: DataFrame, label: str) -> tuple:
    """The two sorted group names; anything but two groups is an error."""
    rows = samples.filter(F.col(label).isNotNull()).select(label).distinct().orderBy(label).limit(3)
    levels = [r[0] for r in rows.collect()]
    if len(levels) != 2:
        raise ValueError(f"column {label} must hold exactly two groups")
    return levels[0], levels[1]


def two_group_moments(data: DataFrame, levels: tuple) -> DataFrame:
    aggs = []
    for i, level in enumerate(levels, start=1):
        v = F.when(F.col("grp") == F.lit(level), F.col("value"))
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.avg(v).alias(f"mean{i}"),
            F.var_samp(v).alias(f"var{i}"),
        ]
    return data.groupBy("gene_id").agg(*aggs)


def t_test(expr: DataFrame, samples: DataFrame, label: str = "label", levels=None) -> DataFrame:
    """Equal-variance t-test with Cohen's d."""
    levels = levels or two_levels(samples, label)
    m = two_group_moments(labelled(expr, samples, label), levels)
    pooled = ((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) / (
        F.col("n1") + F.col("n2") - 2
    )
    m = m.withColumn("_sp", pooled).withColumn("df", (F.col("n1") + F.col("n2") - 2).cast("double"))
    diff = F.col("mean1") - F.col("mean2")
    t = diff / F.sqrt(F.col("_sp") * (1 / F.col("n1") + 1 / F.col("n2")))
    return (
        m.withColumn("statistic", F.when(F.col("_sp") > 0, t))
        .withColumn("p_value", t_sf2("statistic", "df"))
        .withColumn("effect_size", F.when(F.col("_sp") > 0, diff / F.sqrt("_sp")))
        .withColumn("std1", F.sqrt("var1"))
        .withColumn("std2", F.sqrt("var2"))
        .drop("_sp", "var1", "var2")
    )


def welch_test(
    expr: DataFrame, samples: DataFrame, label: str = "label", simple: bool = False, levels=None
) -> DataFrame:
    """Unequal-variance t-test, log2 ratio of means, FDR (monotone BH unless `simple`)."""
    levels = levels or two_levels(samples, label)
    m = two_group_moments(labelled(expr, samples, label), levels)
    a, b = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    m = m.withColumn("_a", a).withColumn("_b", b)
    s = F.col("_a") + F.col("_b")
    dof = s * s / (F.pow("_a", 2) / (F.col("n1") - 1) + F.pow("_b", 2) / (F.col("n2") - 1))
    m = (
        m.withColumn(
            "statistic", F.when(s > 0, (F.col("mean1") - F.col("mean2")) / F.sqrt(s))
        )
        .withColumn("df", F.when(s > 0, dof))
        .withColumn("p_value", t_sf2("statistic", "df"))
        .withColumn("log2fc", F.log2(F.col("mean2") + 1e-9) - F.log2(F.col("mean1") + 1e-9))
        .drop("_a", "_b")
    )
    if simple:
        return simple_fdr(m, "p_value", "gene_id", "fdr")
    return adjust_p(m, "p_value", "fdr_bh", "fdr")


def paired_t_test(pairs: DataFrame, first: str = "value1", second: str = "value2") -> DataFrame:
    """t on the differences of already paired columns, one result per gene."""
    d = F.col(first) - F.col(second)
    m = pairs.filter(d.isNotNull()).groupBy("gene_id").agg(
        F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("std_diff")
    )
    t = F.col("mean_diff") / (F.col("std_diff") / F.sqrt("n"))
    return (
        m.withColumn("statistic", F.when(F.col("std_diff") > 0, t))
        .withColumn("df", (F.col("n") - 1).cast("double"))
        .withColumn("p_value", t_sf2("statistic", "df"))
    )


def _distinct_values(data: DataFrame, counted: dict[str, Column]) -> tuple[DataFrame, bool]:
    """A row for each distinct value of a gene: rows there that meet each condition, all rows `c`, the average rank; and
    whether the values of any gene fit a task. Rows are added up inside tasks, before they are shuffled.
    """
    aggs = [F.count_if(cond).alias(name) for name, cond in counted.items()]
    table = reuse(data.groupBy("gene_id", "value").agg(F.count(F.lit(1)).alias("c"), *aggs))
    small = fits(table, ["gene_id"])
    table = ordered_scan(table, ["gene_id"], "value", {"_cum": ("sum", "c", "asc")}, small)
    return table.withColumn("rank", F.col("_cum") - (F.col("c") - 1) / 2.0).drop("_cum"), small


def _tie_terms(counts: DataFrame) -> DataFrame:
    c = F.col("c").cast("double")
    return counts.groupBy("gene_id").agg(
        F.sum(c * c * c - c).alias("tie"), F.max("c").alias("largest_tie")
    )


def mann_whitney(expr: DataFrame, samples: DataFrame, label: str = "label", levels=None) -> DataFrame:
    """U test: exact p for a group of at most 8 without ties, else normal with corrections."""
    levels = levels or two_levels(samples, label)
    data = labelled(expr, samples, label)
    one, two = (F.col("grp") == F.lit(v) for v in levels)
    table, small = _distinct_values(data, {"c1": one, "c2": two})
    n1_, n2_, c = F.sum("c1"), F.sum("c2"), F.col("c").cast("double")
    aggs = [
        n1_.alias("n1"), n2_.alias("n2"),
        F.sum(F.when(F.col("c1") > 0, F.col("c1") * F.col("rank"))).alias("_r1"),
        (F.sum(F.when(F.col("c1") > 0, F.col("c1") * F.col("value"))) / F.nullif(n1_, F.lit(0))).alias("mean1"),
        (F.sum(F.when(F.col("c2") > 0, F.col("c2") * F.col("value"))) / F.nullif(n2_, F.lit(0))).alias("mean2"),
        F.sum(c * c * c - c).alias("tie"), F.max("c").alias("largest_tie"),
    ]
    if small:
        aggs += [F.percentile("value", F.lit(0.5), F.col(f"c{i}")).alias(f"median{i}") for i in (1, 2)]
    t = table.groupBy("gene_id").agg(*aggs)
    if not small:
        for i, v in enumerate(levels, start=1):
            med = percentiles(data.filter(F.col("grp") == F.lit(v)), ["gene_id"], "value", {f"median{i}": 0.5})
            t = t.join(med, "gene_id", "left")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    t = t.withColumn("statistic", F.col("_r1") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("tie") / (n * (n - 1))))
    # continuity-corrected distance from the mean, on the larger of the two U
    gap = F.greatest(F.col("statistic"), n1 * n2 - F.col("statistic")) - n1 * n2 / 2 - 0.5
    exact = (F.least("n1", "n2") <= 8) & (F.col("largest_tie") == 1)
    valid = (F.col("n1") > 0) & (F.col("n2") > 0)
    t = t.withColumn("_z", F.when(sd > 0, gap / sd))
    t = t.withColumn("_u", F.when(exact & valid, F.col("statistic")))
    approx = F.when(F.col("_z") > 0, norm_sf2("_z")).otherwise(
        F.when(F.col("_z").isNotNull(), F.lit(1.0))
    )
    return (
        t.withColumn("_pn", approx)
        .withColumn("_pe", mwu_exact("_u", "n1", "n2"))
        .withColumn("p_value", F.when(exact & valid, F.col("_pe")).otherwise(F.col("_pn")))
        .withColumn("effect_size", 2 * F.col("statistic") / (n1 * n2) - 1)
        .drop("_r1", "_z", "_u", "_pn", "_pe", "tie", "largest_tie")
    )


def group_moments(data: DataFrame, keys=("gene_id",)) -> DataFrame:
    return data.groupBy(*keys, "grp").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var")
    )


def anova(
    expr: DataFrame, samples: DataFrame, label: str = "label", min_group: int = 1
) -> DataFrame:
    """One-way ANOVA with eta squared; `group_moments` holds the statistics of each group."""
    gm = group_moments(labelled(expr, samples, label)).filter(F.col("n") >= min_group)
    return anova_from_moments(gm)


def anova_from_moments(gm: DataFrame, keys=("gene_id",)) -> DataFrame:
    n = F.col("n").cast("double")
    # squared distance of group means from the gene's grand mean, on the small table of moments
    grand = gm.groupBy(*keys).agg((F.sum(n * F.col("mean")) / F.sum("n")).alias("_m"))
    g = gm.join(grand, list(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n_total"),
        F.sum(F.coalesce((n - 1) * F.col("var"), F.lit(0.0))).alias("ss_within"),
        F.sum(n * F.pow(F.col("mean") - F.col("_m"), 2)).alias("ss_between"),
    )
    d1 = (F.col("k") - 1).cast("double")
    d2 = (F.col("n_total") - F.col("k")).cast("double")
    f = (F.col("ss_between") / d1) / (F.col("ss_within") / d2)
    ok = (F.col("k") > 1) & (F.col("n_total") > F.col("k")) & (F.col("ss_within") > 0)
    total = F.col("ss_between") + F.col("ss_within")
    return (
        g.withColumn("statistic", F.when(ok, f))
        .withColumn("_d1", d1)
        .withColumn("_d2", d2)
        .withColumn("p_value", f_sf("statistic", "_d1", "_d2"))
        .withColumn("effect_size", F.when(total > 0, F.col("ss_between") / total))
        .drop("_d1", "_d2")
    )


def kruskal(expr: DataFrame, samples: DataFrame, label: str = "label") -> DataFrame:
    """Kruskal-Wallis H with tie correction and epsilon squared."""
    data = reuse(labelled(expr, samples, label))
    small = fits(data, ["gene_id"])
    ranked = ranks(data, ["gene_id"], "value", "rank", small=small)
    per = ranked.groupBy("gene_id", "grp").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("rank").alias("r")
    )
    g = per.groupBy("gene_id").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n_total"),
        F.sum(F.col("r") * F.col("r") / F.col("n")).alias("_q"),
    )
    g = g.join(_tie_terms(value_counts(data, ["gene_id"], "value", small)), "gene_id")
    n = F.col("n_total")
    h = (12 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)) / (1 - F.col("tie") / (n * n * n - n))
    usable = (F.col("k") > 1) & (F.col("tie") < n * n * n - n)
    return (
        g.withColumn("statistic", F.when(usable, h))
        .withColumn("_df", (F.col("k") - 1).cast("double"))
        .withColumn("p_value", chi2_sf("statistic", "_df"))
        .withColumn(
            "effect_size",
            F.greatest(F.lit(0.0), (F.col("statistic") - F.col("k") + 1) / (n - F.col("k"))),
        )
        .withColumn("n_total", n.cast("long"))
        .drop("_q", "_df", "tie", "largest_tie")
    )


def _p_from_r(df: DataFrame) -> DataFrame:
    dof = (F.col("n") - 2).cast("double")
    r = F.col("statistic")
    t = r * F.sqrt(dof / (1 - r * r))
    df = df.withColumn("_df", dof).withColumn("_t", F.when((F.col("n") > 2) & (F.abs(r) < 1), t))
    perfect = (F.col("n") > 2) & (F.abs(r) >= 1)
    return df.withColumn(
        "p_value", F.when(perfect, F.lit(0.0)).otherwise(t_sf2("_t", "_df"))
    ).drop("_df", "_t")


def correlation(
    expr: DataFrame, samples: DataFrame, label: str, method: str = "pearson"
) -> DataFrame:
    """Pearson or Spearman correlation of each gene with a numeric sample column."""
    data = labelled(expr, samples, label).withColumn("y", F.col("grp").cast("double"))
    base = data.groupBy("gene_id").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.corr("value", "y").alias("statistic"),
    )
    if method == "spearman":
        data = reuse(data)
        small = fits(data, ["gene_id"])
        r = ranks(data, ["gene_id"], "value", "_rx", small=small)
        r = ranks(r, ["gene_id"], "y", "_ry", small=small)
        rho = r.groupBy("gene_id").agg(F.corr("_rx", "_ry").alias("statistic"))
        base = base.drop("statistic").join(rho, "gene_id")
    elif method != "pearson":
        raise ValueError(f"unknown correlation method {method}")
    return _p_from_r(base.withColumn("statistic", F.nanvl("statistic", F.lit(None).cast("double"))))


def regression(expr: DataFrame, samples: DataFrame, label: str) -> DataFrame:
    """Simple regression of a numeric sample column on each gene."""
    data = labelled(expr, samples, label).withColumn("y", F.col("grp").cast("double"))
    g = data.groupBy("gene_id").agg(
        F.count("value").alias("n"),
        F.regr_slope("y", "value").alias("slope"),
        F.regr_intercept("y", "value").alias("intercept"),
        F.regr_r2("y", "value").alias("r_squared"),
    )
    d2 = (F.col("n") - 2).cast("double")
    f = F.col("r_squared") / (1 - F.col("r_squared")) * d2
    return (
        g.withColumn("statistic", F.when((F.col("n") > 2) & (F.col("r_squared") < 1), f))
        .withColumn("_d2", d2)
        .withColumn("p_value", f_sf("statistic", F.lit(1.0), "_d2"))
        .drop("_d2")
    )


TESTS = {
    "t_test": t_test,
    "wilcoxon": mann_whitney,
    "anova": anova,
    "kruskal": kruskal,
    "correlation": correlation,
    "regression": regression,
}


def differential_expression(
    expr: DataFrame,
    samples: DataFrame,
    label: str = "label",
    method: str = "t_test",
    alpha: float = 0.05,
    correction: str = "fdr_bh",
    **options,
) -> DataFrame:
    """Run one named test and add adjusted p and significance flags."""
    if method not in TESTS:
        raise ValueError(f"unknown method {method}; use one of {sorted(TESTS)}")
    expr = reuse(expr)  # read by the check and by the test
    if expr.join(samples, "sample_id", "left_semi").isEmpty():
        raise ValueError("no sample in common between expression and labels")
    res = adjust_p(TESTS[method](expr, samples, label, **options), "p_value", correction, "p_adj")
    return (
        res.withColumn("method", F.lit(method))
        .withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))
        .withColumn("significant_adj", F.coalesce(F.col("p_adj") < alpha, F.lit(False)))
    )


def choose_methods(n_classes: int) -> list[str]:
    """Tests that suit the number of classes in the label column."""
    if n_classes == 2:
        return ["t_test", "wilcoxon"]
    return ["anova", "kruskal"] if n_classes > 2 else ["correlation"]


def volcano_rows(
    results: DataFrame, kind: str, fc_threshold: float = 1.5, p_threshold: float = 0.05
) -> DataFrame:
    """Points of a volcano plot: x by kind of test, -log10 p, and the significance rule."""
    p = F.col("p_adj")
    if kind in ("t_test", "wilcoxon"):
        c1, c2 = ("mean1", "mean2") if kind == "t_test" else ("median1", "median2")
        diff = F.col(c1) - F.col(c2)
        x = F.signum(diff) * F.log2(F.abs(diff) + 1)
        hit = F.abs(x) >= F.log2(F.lit(fc_threshold))
    elif kind in ("anova", "kruskal"):
        x = F.col("effect_size")
        hit = x >= 0.1
    elif kind == "correlation":
        x = F.col("statistic")
        hit = F.abs(x) >= 0.3
    else:
        x = F.coalesce(F.col("slope"), F.lit(0.0))
        hit = F.lit(True)
    return results.select(
        "gene_id",
        x.alias("x"),
        (-F.log10(p + 1e-10)).alias("neg_log10_p"),
        F.coalesce((p < p_threshold) & hit, F.lit(False)).alias("significant"),
    )


def rank_features(
    results: DataFrame, by: str = "combined", top: int = 50, p: str = "p_adj"
) -> DataFrame:
    """Score by significance, effect or their product, then the best `top` genes with a rank."""
    significance = -F.log10(F.col(p) + 1e-10)
    effect = F.abs(F.coalesce(F.col("effect_size"), F.lit(0.0)))
    score = {"p_value": significance, "effect_size": effect, "combined": significance * effect}[by]
    scored = results.withColumn("score", score).filter(F.col("score").isNotNull())
    best = scored.orderBy(F.col("score").desc(), "gene_id").limit(top)
    return ordinal_ranks(best, [], "score", "gene_id", "rank", descending=True, small=True)


def analysis_summary(results: DataFrame) -> DataFrame:
    """Per method: genes tested, significant before and after correction, best p."""
    return results.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_genes"),
        F.count_if("significant").alias("n_significant"),
        F.count_if("significant_adj").alias("n_significant_adj"),
        F.min("p_value").alias("min_p"),
    )


def de_filter_summary(results: DataFrame, p_max: float = 0.05, fc_min: float = 1.0) -> DataFrame:
    """Counts up and down, mean log2 change and median p of the rows that pass both limits."""
    kept = results.filter((F.col("p_value") <= p_max) & (F.abs("log2fc") >= fc_min))
    med = median_by(kept, [], "p_value", "median_p").select("median_p")
    return kept.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("log2fc") > 0).alias("n_up"),
        F.count_if(F.col("log2fc") < 0).alias("n_down"),
        F.avg("log2fc").alias("mean_log2fc"),
    ).withColumn("median_p", med.scalar())
