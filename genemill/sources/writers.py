"""Sinks: tables, matrices and run artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """csv, tsv, parquet or json; nested columns of csv and tsv are written as JSON text."""
    w = df
    if fmt in ("csv", "tsv"):
        for f in df.schema:
            if f.dataType.typeName() in ("array", "map", "struct"):
                w = w.withColumn(f.name, F.to_json(f.name))
        w.write.mode(mode).csv(path, sep="\t" if fmt == "tsv" else ",", header=True)
    elif fmt == "parquet":
        w.write.mode(mode).parquet(path)
    elif fmt == "json":
        w.write.mode(mode).json(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def to_matrix(expr: DataFrame, max_samples: int = 20_000) -> DataFrame:
    """Wide gene-by-sample table for export; the number of columns is checked."""
    names = [r[0] for r in expr.select("sample_id").distinct().orderBy("sample_id").limit(max_samples + 1).collect()]
    if len(names) > max_samples:
        raise ValueError(f"more than {max_samples} samples: export the long table instead")
    return expr.groupBy("gene_id").pivot("sample_id", names).agg(F.first("value"))


# Separators of the text formats of a matrix.
SEPARATORS = {"tsv": "\t", "csv": ","}
BROADCAST_SAMPLES = 100_000


def _quoted(text, sep: str):
    """A cell as the CSV reader takes it: quoted if it holds the separator, a quote or a line break."""
    odd = f"[{sep}\"\\\\\r\n]"
    inner = F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"')
    return F.when(F.regexp_like(text, F.lit(odd)), F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(text)


def matrix_lines(expr: DataFrame, sep: str = "\t") -> DataFrame:
    """One text line per gene, in a column named by the header line; any number of samples.

    Cells are placed by the number of their sample, so that absent and null cells take no space before the
    line is joined. Of several values at one place the smallest is written; cells without a sample are left
    out; a gene with nulls only keeps its line. The names of the samples go through the driver, since they
    are one line of the file.
    """
    spark = expr.sparkSession
    named = expr.filter(F.col("sample_id").isNotNull()).select("sample_id").distinct()
    names = sorted(r[0] for r in named.collect())
    places = spark.createDataFrame(list(enumerate(names, 1)), "_p int, sample_id string")
    if len(names) <= BROADCAST_SAMPLES:
        places = F.broadcast(places)
    text = F.when(F.col("value").isNotNull(), F.struct("_p", "value", F.col("value").cast("string").alias("t")))
    line = expr.join(places, "sample_id").groupBy("gene_id").agg(F.sort_array(F.collect_list(text)).alias("a"))
    a = F.col("a")
    once = F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["_p"] != x["_p"]))
    line = line.withColumn("a", once)
    gap = lambda x, i: F.repeat(F.lit(sep), x["_p"] - F.when(i == 0, 0).otherwise(F.get(a, i - 1)["_p"]))
    body = F.array_join(F.transform(a, lambda x, i: F.concat(gap(x, i), x["t"])), "")
    last = F.when(F.size(a) > 0, F.element_at(a, -1)["_p"]).otherwise(0)
    rest = F.repeat(F.lit(sep), F.lit(len(names)) - last)
    gene = F.coalesce(_quoted(F.col("gene_id").cast("string"), sep), F.lit(""))
    quoted = ['"' + n.replace("\\", "\\\\").replace('"', '\\"') + '"' if any(c in n for c in sep + '"\\\r\n') else n for n in names]
    return line.select(F.concat(gene, body, rest).alias(sep.join(["gene_id", *quoted])))


def write_matrix(expr: DataFrame, path: str, fmt: str = "tsv") -> None:
    """Text formats as lines, each file with the header; the others as a wide table."""
    if fmt not in SEPARATORS:
        return write_table(to_matrix(expr), path, fmt)
    # one text column: nothing in it is to be quoted or trimmed again
    matrix_lines(expr, SEPARATORS[fmt]).write.mode("overwrite").csv(
        path, header=True, sep="\u0001", quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_run(tables: dict[str, DataFrame], folder: str, run_id: str, fmt: str = "parquet") -> None:
    """One table per artefact below its name, in the partition of the run."""
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}/run_id={run_id}", fmt)


# ---- sinks of the analyses ---------------------------------------------------------------------------


def _write_analysis(tables: dict[str, DataFrame], short: DataFrame | None, path: str, fmt: str) -> None:
    """json: every table of the analysis below its name; csv: the short table, where the analysis has one."""
    if fmt == "json":
        for name, df in tables.items():
            write_table(df, f"{path}/{name}", "json")
    elif fmt == "csv" and short is not None:
        write_table(short, path, "csv")
    else:
        raise ValueError(f"unsupported format {fmt}")


def write_statistics(tests: DataFrame, path: str, fmt: str = "json") -> None:
    """Rows of `stats.differential_expression`, of one method or several; csv: method and gene that hold after
    the correction."""
    short = tests.filter("significant_adj").select("method", F.col("gene_id").alias("gene"))
    _write_analysis({"tests": tests}, short, path, fmt)


def write_selection(selections: DataFrame, consensus: DataFrame, path: str, fmt: str = "json") -> None:
    """Chosen features of each method and the rows of `selection.consensus`; csv: the consensus."""
    short = consensus.select("feature", "consensus_score", "selection_count", "methods")
    _write_analysis({"selections": selections, "consensus": consensus}, short, path, fmt)


def write_pathways(ora: DataFrame, gsea: DataFrame | None, path: str, fmt: str = "json", p_max: float = 0.05) -> None:
    """Rows of both analyses (`gsea` may be left out); csv: the significant ones with their method."""
    rows = {"ora": ora} | ({"gsea": gsea} if gsea is not None else {})
    short = ora.select("gene_set", F.lit("ora").alias("method"), F.col("p_adj").alias("q"))
    if gsea is not None:
        short = short.unionByName(gsea.select("gene_set", F.lit("gsea").alias("method"), F.col("fdr").alias("q")))
    _write_analysis(rows, short.filter(F.col("q") < p_max), path, fmt)


def write_annotation(flags: DataFrame, databases: list[str], path: str, fmt: str = "json") -> None:
    """Flags of the genes; csv: one row of counts with the databases asked."""
    short = flags.agg(
        F.count(F.lit(1)).alias("n_genes"),
        F.count_if("is_cancer_gene").alias("cancer_genes_count"),
        F.count_if(F.col("has_pathogenic") | F.col("has_therapeutic")).alias("clinical_genes_count"),
    ).withColumn("databases", F.lit(",".join(databases)))
    _write_analysis({"flags": flags}, short, path, fmt)


def write_evaluation(metrics: DataFrame, path: str, fmt: str = "json", **more: DataFrame) -> None:
    """Metrics of the models, and any further tables (curves, folds, tests) by name; json only."""
    _write_analysis({"metrics": metrics, **more}, None, path, fmt)


def write_attribution(attribution: DataFrame, path: str, fmt: str = "json") -> None:
    """Importance of features by model; json only."""
    _write_analysis({"attribution": attribution}, None, path, fmt)
