"""Gene annotation: joins with annotation tables, flags, evidence unions, text mentions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def map_gene_ids(expr: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace ids by their target where there is one; colliding rows are averaged.

    Rows are dealt out by what they are averaged by, so that no task holds its part of `expr` and of the averages at once.
    """
    m = mapping.select(F.col("from_id").alias("gene_id"), "to_id")
    out = expr.join(m, "gene_id", "left").withColumn("gene_id", F.coalesce("to_id", "gene_id"))
    return out.repartition("gene_id", "sample_id").groupBy("gene_id", "sample_id").agg(F.avg("value").alias("value"))


def annotate_genes(genes: DataFrame, annotations: DataFrame, databases: Sequence[str]) -> DataFrame:
    """One row per gene and asked database: number of records, best level, and a status.

    `annotations` is one long table (database, gene, significance, level, tier).
    """
    asked = genes.select("gene").distinct().withColumn(
        "database", F.explode(F.array(*[F.lit(d) for d in databases]))
    )
    per = annotations.groupBy("database", "gene").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.min("level").alias("best_level"),
        F.bool_or(F.col("significance").contains("Pathogenic")).alias("has_pathogenic"),
    )
    known = annotations.select("database").distinct().withColumn("_known", F.lit(True))
    out = asked.join(per, ["database", "gene"], "left").join(known, "database", "left")
    status = (
        F.when(F.col("n_records") > 0, "found")
        .when(F.col("_known"), "no_records")
        .otherwise("database_not_available")
    )
    return out.select(
        "gene", "database", F.coalesce("n_records", F.lit(0)).alias("n_records"), "best_level",
        F.coalesce("has_pathogenic", F.lit(False)).alias("has_pathogenic"), status.alias("status"),
    )


def annotation_flags(genes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Flags per gene from all its records of all databases."""
    flags = annotations.join(genes.select("gene").distinct(), "gene", "left_semi").groupBy("gene").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.bool_or(F.col("database") == "cancer").alias("is_cancer_gene"),
        F.bool_or(F.col("significance").contains("Pathogenic")).alias("has_pathogenic"),
        F.bool_or(F.col("database") == "drug").alias("has_therapeutic"),
        F.min("level").alias("level"),
    )
    no = F.lit(False)
    return genes.select("gene").distinct().join(flags, "gene", "left").select(
        "gene", F.coalesce("n_records", F.lit(0)).alias("n_records"),
        *[F.coalesce(c, no).alias(c) for c in ("is_cancer_gene", "has_pathogenic", "has_therapeutic")],
        "level",
    )


def annotate_run(results: DataFrame, annotations: DataFrame, run_id: str, top: int = 20) -> DataFrame:
    best = results.filter(F.col("run_id") == run_id).orderBy("p_value", "gene").limit(top)
    return best.select("gene", "p_value").join(annotation_flags(best, annotations), "gene", "left")


def genes_with_flag(flags: DataFrame, flag: str) -> DataFrame:
    return flags.filter(F.col(flag)).select("gene")


def annotation_summary(flags: DataFrame) -> DataFrame:
    return flags.agg(
        F.count(F.lit(1)).alias("n_genes"),
        F.count_if("is_cancer_gene").alias("with_cancer_hit"),
        F.count_if(F.col("has_pathogenic") | F.col("has_therapeutic")).alias("with_clinical_hit"),
    )


def filter_annotations(
    annotations: DataFrame,
    gene: str | None = None,
    text: str | None = None,
    level: str | None = None,
    significance: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Filters of the variant, cancer-gene and drug tables."""
    out = annotations
    if gene is not None:
        out = out.filter(F.upper("gene") == gene.upper())
    if text is not None:
        out = out.filter(F.contains(F.lower("condition"), F.lit(text.lower())))
    if level is not None:
        out = out.filter(F.col("level") == level)
    if significance is not None:
        out = out.filter(F.contains(F.lower("significance"), F.lit(significance.lower())))
    return out if limit is None else out.orderBy("record_id").limit(limit)


def evidence_union(lists: DataFrame) -> DataFrame:
    """Distinct therapies, number of publications, mean significance and its level per biomarker."""
    from genemill.functions.columns import lookup

    value = lookup("significance", {"high": 3.0, "moderate": 2.0, "low": 1.0}, 0.0)
    g = lists.groupBy("biomarker").agg(
        F.concat_ws(",", F.array_sort(F.collect_set("therapy"))).alias("therapies"),
        F.count("publication").alias("n_publications"),
        F.avg(value).alias("mean_significance"),
    )
    level = F.when(F.col("mean_significance") >= 2.5, "high").when(F.col("mean_significance") >= 1.5, "moderate")
    return g.withColumn("level", level.otherwise("low")).withColumn(
        "confidence", F.col("mean_significance") / 3
    )


def source_union(local: DataFrame, literature: DataFrame) -> DataFrame:
    a = local.select("id", "title", F.lit("local").alias("source_type"))
    return a.unionByName(literature.select("id", "title", F.lit("literature").alias("source_type")))


def distinct_literature(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per publication id; with a limit the first few in id order."""
    first = rows.groupBy("pmid").agg(F.min_by("title", "rank").alias("title"))
    return first if limit is None else first.orderBy("pmid").limit(limit)


def evidence_card(flags: DataFrame) -> DataFrame:
    """One nested record per gene."""
    return flags.select(
        "gene",
        F.struct("is_cancer_gene", "n_records").alias("cancer"),
        F.struct("has_pathogenic", "has_therapeutic", "level").alias("clinical"),
    )


# ---- text ------------------------------------------------------------------------------------


def retrieve_snippets(snippets: DataFrame, genes: Sequence[str], limit: int = 5) -> DataFrame:
    """Snippets that name asked genes: 10 per shared gene plus 1 per gene in the title."""
    asked = sorted({g.strip().upper() for g in genes if g and g.strip()})
    wanted = F.array(*[F.lit(g) for g in asked])
    own = F.transform("genes", lambda g: F.upper(g))
    shared = F.array_sort(F.array_intersect(wanted, own))
    titled = F.filter(wanted, lambda g: (F.length(g) > 2) & F.contains(F.upper("title"), g))
    scored = snippets.select(
        "id", "title", shared.alias("_m"), (F.size(shared) * 10 + F.size(titled)).alias("match_score")
    ).filter(F.size("_m") > 0)
    return scored.orderBy(F.col("match_score").desc(), "id").limit(limit).select(
        "id", "match_score", F.concat_ws(",", "_m").alias("matched")
    )


def mention_check(cases: DataFrame, text: str = "text", genes: str = "genes") -> DataFrame:
    """Share of cases whose text names every required gene."""
    from genemill.functions.columns import mentions_all

    ok = mentions_all(F.col(text), F.col(genes))
    return cases.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(ok).alias("passed"),
        F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("pass_rate"),
    )


def co_mentions(documents: DataFrame, genes: Sequence[str], text: str = "text", top: int | None = None) -> DataFrame:
    """Pairs of asked genes named in the same document, with the number of documents.

    Documents are matched in the JVM; each task multiplies its own 0/1 matrix and
    sends one row per pair, so no document emits its pairs and nothing depends on
    how many genes one document names.
    """
    asked = sorted({g.strip().upper() for g in genes if g and g.strip()})
    up = F.upper(F.col(text))
    present = documents.select(F.array(*[F.contains(up, F.lit(g)) for g in asked]).alias("g"))
    k = len(asked)

    def multiply(batches):
        total = np.zeros((k, k), dtype=np.int64)
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf["g"].to_numpy()).astype(np.float64)
                total += (m.T @ m).astype(np.int64)
        a, b = np.nonzero(np.triu(total, 1))
        yield pd.DataFrame({"a": a, "b": b, "n": total[a, b]})

    pairs = present.mapInPandas(multiply, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("weight"))
    names = F.array(*[F.lit(g) for g in asked])
    out = pairs.select(
        F.element_at(names, F.col("a").cast("int") + 1).alias("source"),
        F.element_at(names, F.col("b").cast("int") + 1).alias("target"),
        "weight",
    )
    return out if top is None else out.orderBy(F.col("weight").desc(), "source", "target").limit(top)


def column_correlations(wide: DataFrame, columns: Sequence[str], minimum: float = 0.0) -> DataFrame:
    """|r| of every pair of numeric columns, in one aggregation over the table."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = wide.agg(
        F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("p")
    )
    out = row.select(F.explode("p").alias("p")).select(
        F.col("p.a").alias("variable_1"), F.col("p.b").alias("variable_2"), F.col("p.r").alias("correlation")
    )
    return out.filter(F.abs("correlation") >= minimum)
