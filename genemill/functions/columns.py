"""Column expressions shared by operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sign_log(d) -> Column:
    """sign(d) * log2(|d| + 1)."""
    d = _c(d)
    return F.signum(d) * F.log2(F.abs(d) + 1)


def log2_fold_change(case, control, eps: float = 1e-9) -> Column:
    return F.log2(_c(case) + eps) - F.log2(_c(control) + eps)


def encode_labels(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """Sorted integer codes from 0 for the distinct values of a column."""
    from genemill.operators.distributed import GROUP_LIMIT

    values = df.filter(F.col(col).isNotNull()).select(col).distinct()
    if values.count() > GROUP_LIMIT:
        raise ValueError(f"{col} has too many distinct values to be a class label")
    from pyspark.sql import Window

    codes = values.withColumn(out, F.row_number().over(Window.orderBy(col)) - 1)
    return df.join(codes, col, "left").select(*df.columns, out)


def one_hot(df: DataFrame, col: str, prefix: str | None = None, limit: int = 1000) -> DataFrame:
    """One 0/1 column per value; the number of values is checked."""
    levels = [r[0] for r in df.select(col).distinct().orderBy(col).limit(limit + 1).collect()]
    if len(levels) > limit:
        raise ValueError(f"{col} has more than {limit} values")
    name = lambda v: f"{prefix or col}_{v}"
    return df.select(
        "*", *[F.when(F.col(col) == F.lit(v), 1).otherwise(0).alias(name(v)) for v in levels if v is not None]
    )


def strip_id_version(gene) -> Column:
    """Identifier before the first dot."""
    return F.split_part(_c(gene), F.lit("."), F.lit(1))


def normalize_symbol(text) -> Column:
    return F.upper(F.trim(_c(text)))


def series_accession(text) -> Column:
    """GSE accession: an existing one upper-cased, bare digits get the prefix, else null."""
    t = F.upper(F.trim(_c(text)))
    found = F.regexp_extract(t, r"(GSE\d+)", 1)
    return F.when(found != "", found).when(t.rlike(r"^\d+$"), F.concat(F.lit("GSE"), t))


def clean_run_id(text) -> Column:
    """Keep letters, digits, space, hyphen and underscore; spaces become underscores."""
    kept = F.regexp_replace(_c(text), r"[^A-Za-z0-9 _\-]", "")
    return F.regexp_replace(F.trim(kept), " ", "_")


# Words in a title and the assay type they stand for, first match wins.
ASSAY_WORDS = (
    ("methylation", "methylation"),
    ("chip-seq", "chip_seq"),
    ("chipseq", "chip_seq"),
    ("atac-seq", "atac_seq"),
    ("atacseq", "atac_seq"),
    ("rna-seq", "rna_seq"),
    ("rnaseq", "rna_seq"),
    ("mirna", "mirna"),
    ("microrna", "mirna"),
    ("lncrna", "lncrna"),
)


def assay_type(title) -> Column:
    t = F.lower(_c(title))
    out = None
    for word, kind in ASSAY_WORDS:
        out = (F.when if out is None else out.when)(t.contains(word), kind)
    return out.otherwise("expression")


def stage_binary(text) -> Column:
    """1 for stage III to V, 0 for stage 0 to II, else null."""
    t = F.upper(F.trim(_c(text)))
    late = t.rlike(r"\bSTAGE\s*(III|IV|V)[A-C]?\b")
    early = t.rlike(r"\bSTAGE\s*(0|I|II)[A-C]?\b")
    return F.when(late, 1).when(early, 0)


def mentions_all(text, genes) -> Column:
    """True when every gene of the array occurs in the upper-cased text."""
    up = F.upper(_c(text))
    return F.forall(_c(genes), lambda g: F.contains(up, F.upper(g)))


def split_list(text) -> Column:
    """Items of a comma or semicolon list, trimmed, empty ones dropped."""
    parts = F.transform(F.split(_c(text), "[,;]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


# Weights of evidence level and study type.
LEVEL_WEIGHT = {"A": 1.0, "B": 0.8, "C": 0.6, "D": 0.4}
STUDY_WEIGHT = {
    "RCT": 1.0,
    "meta-analysis": 0.9,
    "cohort": 0.7,
    "case-control": 0.5,
    "guideline": 0.8,
}
LEVEL_ORDER = {"A": 4, "B": 3, "C": 2, "D": 1}


def lookup(col, table: dict, default) -> Column:
    """A small constant table as a CASE expression."""
    c, out = _c(col), None
    for key, value in table.items():
        out = (F.when if out is None else out.when)(c == F.lit(key), F.lit(value))
    return out.otherwise(F.lit(default))


def evidence_weight(reference_year: int = 2024) -> Column:
    """Weight of one evidence row (level, study_type, n, impact, year)."""
    recency = F.greatest(F.lit(0.5), 1 - (F.lit(reference_year) - F.col("year")) / 10)
    return (
        lookup("level", LEVEL_WEIGHT, 0.2)
        * lookup("study_type", STUDY_WEIGHT, 0.3)
        * F.least(F.lit(1.0), F.col("n") / 1000)
        * F.least(F.lit(1.0), F.col("impact") / 20)
        * recency
    )
