"""Input checks as tables: one row per check or issue, never an exception midway.

`raise_on_errors` turns an issues table into a stop, with one small action.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def drop_all_null(expr: DataFrame) -> DataFrame:
    """Drop genes and samples that hold no value at all."""
    full = expr.filter(F.col("value").isNotNull())
    return expr.join(full.select("gene_id").distinct(), "gene_id", "left_semi").join(
        full.select("sample_id").distinct(), "sample_id", "left_semi"
    )


def drop_empty_genes(expr: DataFrame) -> DataFrame:
    """Drop genes whose values are all zero or null."""
    alive = expr.groupBy("gene_id").agg(F.max(F.abs(F.col("value"))).alias("top")).filter(F.col("top") > 0)
    return expr.join(alive, "gene_id", "left_semi")


def align(expr: DataFrame, samples: DataFrame) -> DataFrame:
    """Inner alignment; an empty result is an error."""
    out = expr.join(samples, "sample_id")
    if expr.join(samples, "sample_id", "left_semi").isEmpty():
        raise ValueError("no sample in common between expression and labels")
    return out


def sample_overlap(expr: DataFrame, samples: DataFrame) -> DataFrame:
    """common / expression-only / label-only sample counts and the common share."""
    e = expr.select("sample_id").distinct().withColumn("in_e", F.lit(1))
    s = samples.select("sample_id").distinct().withColumn("in_s", F.lit(1))
    j = e.join(s, "sample_id", "full")
    both = F.col("in_e").isNotNull() & F.col("in_s").isNotNull()
    return j.agg(
        F.count_if(both).alias("common"),
        F.count_if(F.col("in_s").isNull()).alias("expression_only"),
        F.count_if(F.col("in_e").isNull()).alias("label_only"),
        (F.count_if(both) / F.count("in_e")).alias("overlap_ratio"),
    )


def class_distribution(samples: DataFrame, label: str = "label") -> DataFrame:
    """Class sizes; `class_balance` gives the ratio."""
    return samples.filter(F.col(label).isNotNull()).groupBy(
        F.col(label).cast("string").alias("class")
    ).agg(F.count(F.lit(1)).alias("n"))


def class_balance(samples: DataFrame, label: str = "label") -> DataFrame:
    return class_distribution(samples, label).agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.min("n").alias("min_class"),
        F.max("n").alias("max_class"),
        (F.max("n") / F.min("n")).alias("imbalance_ratio"),
        (F.min("n") / F.max("n")).alias("balance_ratio"),
    )


def duplicates(expr: DataFrame, samples: DataFrame) -> DataFrame:
    """Repeated (gene, sample) cells and repeated sample ids in the label table."""
    cells = expr.groupBy("gene_id", "sample_id").agg(F.count(F.lit(1)).alias("c"))
    out = cells.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_cells"))
    dup = samples.agg((F.count(F.lit(1)) - F.count_distinct("sample_id")).alias("d")).scalar()
    return out.withColumn("duplicate_samples", dup)


def _checks(row: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """(check, severity, condition, measured) rules over a one-row table; broken ones become rows."""
    items = F.array_compact(
        F.array(
            *[
                F.when(
                    cond,
                    F.struct(
                        F.lit(name).alias("check"),
                        F.lit(sev).alias("severity"),
                        val.cast("double").alias("measured"),
                    ),
                )
                for name, sev, cond, val in rules
            ]
        )
    )
    return row.select(F.explode(items).alias("x")).select("x.check", "x.severity", "x.measured")


def _facts(expr: DataFrame, samples: DataFrame, label: str, batch: str | None) -> DataFrame:
    ov = sample_overlap(expr, samples)
    bal = class_balance(samples, label)
    dup = duplicates(expr, samples)
    row = expr.agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(F.col("value").isNull()) / F.count(F.lit(1)) * 100).alias("missing_pct"),
        (F.count_if(F.col("value") == 0) / F.count(F.lit(1)) * 100).alias("zero_pct"),
        F.count_if(F.abs(F.col("value")) == float("inf")).alias("infinite"),
        F.count_if(F.col("value") < 0).alias("negative"),
    )
    flat = expr.groupBy("gene_id").agg(F.var_samp("value").alias("v")).agg(
        F.count_if(F.col("v") == 0).alias("f")
    )
    for df, names in (
        (ov, ("common", "expression_only", "label_only", "overlap_ratio")),
        (bal, ("imbalance_ratio", "balance_ratio", "min_class")),
        (dup, ("duplicate_cells", "duplicate_samples")),
    ):
        for name in names:
            row = row.withColumn(name, df.select(name).scalar())
    row = row.withColumn("flat_genes", flat.scalar())
    labels = samples.agg(F.count_if(F.col(label).isNull()).alias("x"))
    row = row.withColumn("missing_labels", labels.scalar())
    n_batches = samples.agg(F.count_distinct(batch)).scalar() if batch else F.lit(1)
    return row.withColumn("n_batches", n_batches)


def integrity_issues(
    expr: DataFrame, samples: DataFrame, label: str = "label", batch: str | None = None
) -> DataFrame:
    """Loader checks: overlap, missing, zeros, class balance, batches."""
    c = F.col
    return _checks(
        _facts(expr, samples, label, batch),
        [
            ("no_common_samples", "error", c("common") == 0, c("common")),
            ("few_common_samples", "error", (c("common") > 0) & (c("common") < 5), c("common")),
            ("expression_only_samples", "warning", c("expression_only") > 0, c("expression_only")),
            ("label_only_samples", "warning", c("label_only") > 0, c("label_only")),
            ("missing_values", "error", c("missing_pct") > 50, c("missing_pct")),
            (
                "high_missing_values",
                "warning",
                (c("missing_pct") > 20) & (c("missing_pct") <= 50),
                c("missing_pct"),
            ),
            ("zero_inflation", "warning", c("zero_pct") > 80, c("zero_pct")),
            ("severe_class_imbalance", "warning", c("balance_ratio") < 0.1, c("balance_ratio")),
            (
                "class_imbalance",
                "warning",
                (c("balance_ratio") >= 0.1) & (c("balance_ratio") < 0.3),
                c("balance_ratio"),
            ),
            ("several_batches", "warning", c("n_batches") > 1, c("n_batches")),
        ],
    )


def six_checks(expr: DataFrame, samples: DataFrame, label: str = "label") -> DataFrame:
    """Pipeline checks, one row each: check, status (passed | warning | failed), measured."""
    f = _facts(expr, samples, label, None)
    c = F.col

    def row(name, failed, warned, measured):
        status = F.when(failed, "failed").when(warned, "warning").otherwise("passed")
        return F.struct(
            F.lit(name).alias("check"), status.alias("status"), measured.cast("double").alias("measured")
        )

    no = F.lit(False)
    rows = F.array(
        row("data_types", c("n") == 0, no, c("n")),
        row(
            "sample_intersection",
            c("common") == 0,
            (c("overlap_ratio") < 0.9) | (c("expression_only") > 0) | (c("label_only") > 0),
            c("overlap_ratio"),
        ),
        row(
            "duplicates",
            c("duplicate_samples") > 0,
            c("duplicate_cells") > 0,
            c("duplicate_samples") + c("duplicate_cells"),
        ),
        row(
            "missing_values", no, (c("missing_pct") > 10) | (c("missing_labels") > 0), c("missing_pct")
        ),
        row(
            "data_quality",
            no,
            (c("infinite") > 0) | (c("negative") > 0) | (c("flat_genes") > 0),
            c("infinite") + c("negative") + c("flat_genes"),
        ),
        row(
            "label_distribution",
            no,
            (c("imbalance_ratio") > 3) | (c("min_class") < 5),
            c("imbalance_ratio"),
        ),
    )
    return f.select(F.explode(rows).alias("x")).select("x.check", "x.status", "x.measured")


def overall_status(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.when(F.bool_or(F.col("status") == "failed"), "failed")
        .when(F.bool_or(F.col("status") == "warning"), "warning")
        .otherwise("passed")
        .alias("status"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.count_if(F.col("status") == "warning").alias("n_warning"),
    )


def raise_on_errors(issues: DataFrame, column: str = "severity", bad: str = "error") -> None:
    rows = issues.filter(F.col(column) == bad).select("check").distinct().collect()  # names of checks: few
    if rows:
        raise ValueError("checks failed: " + ", ".join(sorted(r[0] for r in rows)))


def expression_upload_check(wide: DataFrame, gene_col: str) -> DataFrame:
    """Facts about an uploaded wide table: gene column, missing share, duplicates, range."""
    has_gene = gene_col in wide.columns
    numeric = [f.name for f in wide.schema if f.dataType.simpleString() in ("double", "float", "int", "bigint")]
    total = lambda fn: sum((fn(F.col(f"`{c}`")) for c in numeric), F.lit(0))
    cells = F.count(F.lit(1)) * max(1, len(numeric))
    out = wide.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (total(lambda c: F.count_if(c.isNull())) / cells * 100).alias("missing_pct"),
        total(lambda c: F.count_if(c < 0)).alias("negatives"),
        total(lambda c: F.count_if(c == 0)).alias("zeros"),
        F.least(*[F.min(f"`{c}`") for c in numeric], F.lit(None)).alias("min") if numeric else F.lit(None).alias("min"),
        F.greatest(*[F.max(f"`{c}`") for c in numeric], F.lit(None)).alias("max") if numeric else F.lit(None).alias("max"),
    )
    rows = wide.distinct().agg(F.count(F.lit(1)).alias("d")).scalar()
    return (
        out.withColumn("has_gene_column", F.lit(has_gene))
        .withColumn("duplicate_rows", F.col("n_rows") - rows)
        .withColumn("duplicate_columns", F.lit(len(wide.columns) - len(set(wide.columns))))
        .withColumn("missing_warning", F.col("missing_pct") > 20)
    )


def clinical_upload_check(clinical: DataFrame, sample_col: str = "sample_id") -> DataFrame:
    types = [f.dataType.simpleString() for f in clinical.schema]
    numeric = sum(t in ("double", "float", "int", "bigint") for t in types)
    cells = F.count(F.lit(1)) * len(clinical.columns)
    nulls = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in clinical.columns), F.lit(0))
    has = sample_col in clinical.columns
    dup = F.count(F.lit(1)) - F.count_distinct(sample_col) if has else F.lit(None).cast("long")
    return clinical.agg(
        F.count(F.lit(1)).alias("n_rows"),
        dup.alias("duplicate_samples"),
        (nulls / cells * 100).alias("missing_pct"),
    ).select(
        "*",
        F.lit(has).alias("has_sample_id"),
        F.lit(numeric).alias("numeric_columns"),
        F.lit(types.count("string")).alias("text_columns"),
        (F.col("missing_pct") > 30).alias("missing_warning"),
    )


def raw_count_issues(counts: DataFrame, samples: DataFrame, group: str) -> DataFrame:
    """At least 4 aligned samples, no negative or non-numeric value, two groups of two or more."""
    joined = counts.join(samples.select("sample_id", F.col(group).alias("g")), "sample_id")
    per = joined.select("sample_id", "g").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    groups = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_samples"),
        F.count_if(F.col("n") >= 2).alias("n_replicated"),
        F.count(F.lit(1)).alias("n_groups"),
    )
    row = counts.agg(F.count_if(F.col("value") < 0).alias("negative"), F.count_if(F.col("value").isNull()).alias("not_numeric"))
    for name in ("n_samples", "n_replicated", "n_groups"):
        row = row.withColumn(name, groups.select(name).scalar())
    c = F.col
    return _checks(
        row,
        [
            ("few_samples", "error", c("n_samples") < 4, c("n_samples")),
            ("negative_counts", "error", c("negative") > 0, c("negative")),
            ("not_numeric", "error", c("not_numeric") > 0, c("not_numeric")),
            ("few_groups", "error", c("n_groups") < 2, c("n_groups")),
            (
                "no_replicates",
                "error",
                (c("n_groups") >= 2) & (c("n_replicated") < c("n_groups")),
                c("n_replicated"),
            ),
        ],
    )


def count_matrix(expr: DataFrame, min_total: int = 0) -> DataFrame:
    """Round to whole counts, drop genes without any count (and below a total)."""
    c = expr.select("gene_id", "sample_id", F.rint("value").cast("long").alias("count"))
    keep = c.groupBy("gene_id").agg(F.sum("count").alias("t"), F.max("count").alias("m"))
    keep = keep.filter((F.col("m") > 0) & (F.col("t") >= min_total))
    return c.join(keep, "gene_id", "left_semi")


LABEL_NAMES = ("group", "class_label", "label", "condition", "class")
SAMPLE_NAMES = ("sample_id", "sample", "sampleid", "id")


def discover_columns(table: DataFrame) -> tuple[str | None, str | None]:
    """The sample id and label columns by their usual names."""
    low = {c.lower(): c for c in table.columns}
    pick = lambda names: next((low[n] for n in names if n in low), None)
    return pick(SAMPLE_NAMES), pick(LABEL_NAMES)


def table_summary(table: DataFrame, key: str) -> DataFrame:
    """Rows, columns, missing cells, duplicate rows, and whether the table is usable."""
    nulls = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in table.columns), F.lit(0))
    distinct = table.distinct().agg(F.count(F.lit(1)).alias("d")).scalar()
    out = table.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(table.columns)).alias("n_columns"),
        nulls.cast("long").alias("missing_cells"),
    )
    return (
        out.withColumn("duplicate_rows", F.col("n_rows") - distinct)
        .withColumn("valid", F.col("n_rows") > 0)
        .withColumn("many_missing", F.col("missing_cells") > 0.5 * F.col("n_rows"))
    )
