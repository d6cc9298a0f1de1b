"""Scans of matrix, label, sample, series and registry files into long DataFrames."""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genemill.operators import survival, validate
from genemill.operators.distributed import reuse


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The most frequent of tab, comma and semicolon in the first line."""
    first = spark.read.text(path).first()
    line = first[0] if first else ""
    return max("\t,;", key=line.count)


def separator_by_suffix(path: str) -> str:
    return "," if path.lower().rstrip("/").endswith(".csv") else "\t"


def _split(line: str, sep: str) -> list[str]:
    return next(csv.reader([line], delimiter=sep, escapechar="\\", doublequote=False))


def _wide_lines(spark: SparkSession, path: str, sep: str):
    """Names of the value columns, the lines below the header, and their cells as long rows.

    The file is read line by line, so that no plan is as wide as the file; a task holds the cells of one line. Cells that are empty, absent or no
    number are null rows; cells beyond the header are dropped.
    """
    text = spark.read.text(path)
    first = text.first()
    if first is None:
        raise ValueError(f"{path} is empty")
    head = _split(first[0], sep)
    seen = Counter(head)
    # as the CSV reader does: an unnamed column is numbered, the number of the column tells repeated names apart
    names = [f"_c{i}" if not n else f"{n}{i}" if seen[n] > 1 else n for i, n in enumerate(head)][1:]
    lines = text.filter((F.trim("value") != "") & (F.col("value") != first[0]))
    n, columns = len(names), pa.array(names, pa.string())

    def cells(batches):
        for batch in batches:
            for line in batch.column(0):
                gene, *row = _split(line.as_py(), sep)
                row = pa.array((row + [None] * n)[:n], pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(gene or None, pa.string()), n), columns, row], ["g", "s", "t"])

    at = lines.mapInArrow(cells, "g string, s string, t string")
    long = at.select(F.col("g").alias("gene_id"), F.col("s").alias("sample_id"), F.expr("try_cast(t AS double)").alias("value"))
    return names, lines, long


def _numeric_samples(long: DataFrame) -> DataFrame:
    """Samples with at least one numeric cell (text columns turn into nulls and go)."""
    ok = long.groupBy("sample_id").agg(F.count("value").alias("c")).filter(F.col("c") > 0)
    return long.join(ok, "sample_id", "left_semi")


def expression_matrix(
    spark: SparkSession, path: str, sep: str | None = None, min_genes: int = 10, min_samples: int = 5
) -> DataFrame:
    """Wide gene-by-sample file to long rows; genes all zero or null are dropped."""
    names, lines, long = _wide_lines(spark, path, sep or sniff_separator(spark, path))
    if len(names) < min_samples:
        raise ValueError(f"need at least {min_samples} samples")
    if lines.limit(min_genes).count() < min_genes:
        raise ValueError(f"need at least {min_genes} genes")
    return validate.drop_empty_genes(_numeric_samples(reuse(long)))


def pipeline_matrix(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """As above with the separator by suffix; a matrix with fewer rows than columns is turned."""
    names, lines, long = _wide_lines(spark, path, sep or separator_by_suffix(path))
    rows, cols = lines.count(), len(names)
    long = validate.drop_all_null(reuse(long))
    if rows < cols:
        long = long.select(F.col("sample_id").alias("gene_id"), F.col("gene_id").alias("sample_id"), "value")
    return long


def omics_matrix(spark: SparkSession, path: str) -> DataFrame:
    if not path.lower().endswith((".csv", ".txt", ".tsv")):
        raise ValueError("csv or txt only")
    return expression_matrix(spark, path, min_genes=1, min_samples=1)


def labels(spark: SparkSession, path: str, sample_col: str = "sample_id", label_col: str = "label") -> DataFrame:
    """Sample labels; missing columns, no label at all or repeated samples are errors."""
    df = spark.read.csv(path, sep=separator_by_suffix(path), header=True, inferSchema=True)
    missing = [c for c in (sample_col, label_col) if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    out = df.withColumnRenamed(sample_col, "sample_id").withColumnRenamed(label_col, "label")
    facts = out.agg(F.count(F.lit(1)), F.count("label"), F.count_distinct("sample_id")).first()
    if facts[0] == 0 or facts[1] == 0:
        raise ValueError("no labels")
    if facts[2] != facts[0]:
        raise ValueError("duplicate sample ids")
    return out


def run_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def survival_table(spark: SparkSession, path: str, time: str = "time", event: str = "event") -> DataFrame:
    df = spark.read.csv(path, sep=separator_by_suffix(path), header=True)
    return survival.clean(df, time, event)


def matrix_lines(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Wide text matrix of any number of samples to long rows, line by line; empty cells are left out.

    Every file of the folder starts with the same header line. Ids may be quoted.
    """
    first = spark.read.text(path).first()
    if first is None:
        return spark.createDataFrame([], "gene_id string, sample_id string, value double")
    sep = sep or sniff_separator(spark, path)
    cell = f'{sep}("(?:[^"\\\\]|\\\\.)*"|[^{sep}]*)'
    cells = lambda c: F.regexp_extract_all(F.concat(F.lit(sep), c), F.lit(cell), 1)
    plain = lambda c: F.when(
        c.startswith('"'), F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), r"\\(.)", "$1")
    ).otherwise(c)
    lines = spark.read.text(path)
    header = spark.read.text(path).limit(1).select(F.transform(cells(F.col("value")), plain).alias("h")).scalar()
    at = lines.filter(F.col("value") != first[0]).select(cells(F.col("value")).alias("c"))
    flat = at.select(plain(F.col("c")[0]).alias("gene_id"), F.posexplode("c").alias("i", "t"))
    return flat.filter((F.col("i") > 0) & (F.col("t") != "")).select(
        "gene_id", F.get(header, F.col("i")).alias("sample_id"), F.expr("try_cast(t AS double)").alias("value")
    )


VALUE_WORDS = ("normalized", "count", "tpm", "fpkm", "expression")


def sample_files(spark: SparkSession, paths, sep: str = "\t") -> DataFrame:
    """One file per sample (gzip allowed, # comments): gene_id, sample_id from the file name, value."""
    df = spark.read.csv(paths, sep=sep, comment="#", header=True)
    cols = df.columns
    value = next((c for c in cols[1:] if any(w in c.lower() for w in VALUE_WORDS)), cols[1])
    return df.select(
        F.col(f"`{cols[0]}`").alias("gene_id"),
        F.regexp_replace(F.col("_metadata.file_name"), r"(\.[A-Za-z]+)+$", "").alias("sample_id"),
        F.expr(f"try_cast(`{value}` AS double)").alias("value"),
    )


def event_files(frames: Sequence[DataFrame]) -> DataFrame:
    """Row-wise union of event tables of the same kind; absent columns become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def series_matrix(spark: SparkSession, path) -> DataFrame:
    """Table rows of series-matrix files, long: file, gene_id, sample_id, value.

    Lines are read one by one (a file may be large). Every line outside the table
    starts with "!", the header of the table with ID_REF; rows of another length
    than the header are dropped.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line"))
    body = lines.filter((F.col("line") != "") & ~F.col("line").startswith("!"))
    cells = body.withColumn(
        "c", F.transform(F.split("line", "\t"), lambda x: F.regexp_replace(x, '^"|"$', ""))
    )
    is_head = F.col("c")[0] == "ID_REF"
    head = cells.filter(is_head).select("file", F.col("c").alias("h"))
    rows = cells.filter(~is_head).join(head, "file").filter(F.size("c") == F.size("h"))
    pairs = F.arrays_zip(F.col("h").alias("h"), F.col("c").alias("c"))
    flat = rows.select("file", F.col("c")[0].alias("gene_id"), F.explode(F.slice(pairs, 2, 1 << 30)).alias("x"))
    return flat.select(
        "file", "gene_id", F.col("x.h").alias("sample_id"), F.expr("try_cast(x.c AS double)").alias("value")
    )


def soft_attributes(spark: SparkSession, path, prefix: str = "!Series_") -> DataFrame:
    """Attribute lines of SOFT files: file, key, value."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    hit = lines.filter(F.startswith(F.col("value"), F.lit(prefix)) & F.contains(F.col("value"), F.lit(" = ")))
    parts = F.split("value", " = ", 2)
    return hit.select("file", F.substring(parts[0], len(prefix) + 1, 1 << 20).alias("key"), parts[1].alias("value"))


def miniml_samples(spark: SparkSession, path) -> DataFrame:
    """Sample ids and titles of MINiML XML files."""
    df = spark.read.format("xml").option("rowTag", "Sample").load(path)
    return df.select(F.col("_iid").alias("iid"), F.trim(F.col("Title")).alias("title"))


def edge_file(spark: SparkSession, path: str) -> DataFrame:
    """gene_a, gene_b and an optional weight (default 1)."""
    df = spark.read.csv(path, sep=separator_by_suffix(path), header=True)
    weight = F.expr("try_cast(weight AS double)") if "weight" in df.columns else F.lit(None).cast("double")
    return df.select(F.col("gene_a").alias("src"), F.col("gene_b").alias("dst"), F.coalesce(weight, F.lit(1.0)).alias("weight"))


def published_matrix(long: DataFrame, min_value: float = 1.0, min_share: float = 0.1) -> DataFrame:
    """Strip id versions, keep the first of repeated ids, keep genes above a value in enough samples.

    "First" is the smallest original id, since a distributed table has no row order.
    """
    from genemill.functions.columns import strip_id_version

    d = long.withColumn("_id", strip_id_version("gene_id"))
    first = d.groupBy("_id").agg(F.min("gene_id").alias("gene_id"))
    d = d.join(first, ["_id", "gene_id"]).select(F.col("_id").alias("gene_id"), "sample_id", "value")
    n = d.agg(F.count_distinct("sample_id").alias("n")).scalar()
    ok = d.groupBy("gene_id").agg(F.count_if(F.col("value") > min_value).alias("c"))
    return d.join(ok.filter(F.col("c") >= n * min_share), "gene_id", "left_semi")


def label_by_sample_name(long: DataFrame) -> DataFrame:
    """Tumor or Normal by words in the sample id."""
    s = long.select("sample_id").distinct()
    has = lambda w: F.contains(F.col("sample_id"), F.lit(w))
    kind = F.when(has("Tumor") | has("TP"), "Tumor").when(has("Normal") | has("NT"), "Normal")
    return s.select("sample_id", kind.alias("label"))


def file_registry(spark: SparkSession, folder: str, registry: DataFrame | None = None, data_type: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Files with size and time (content is not read), joined with their registered type."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file_id"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")
    )
    out = files if registry is None else files.join(registry, "file_id", "left")
    if data_type is not None:
        out = out.filter(F.col("data_type") == data_type)
    out = out.orderBy("file_id").offset(offset)
    return out if limit is None else out.limit(limit)


def fingerprint(expr: DataFrame) -> DataFrame:
    """Order-free digest of a matrix: count and sum of cell hashes, as eight hex digits of md5."""
    h = F.xxhash64("gene_id", "sample_id", "value").cast("decimal(38,0)")
    row = expr.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("s"))
    return row.select(F.substring(F.md5(F.concat_ws(":", "n", F.col("s").cast("string"))), 1, 8).alias("fingerprint"), "n")


def jdbc_table(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A relational table; give partitionColumn, lowerBound, upperBound, numPartitions for a parallel scan."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
