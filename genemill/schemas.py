"""Schemas of the tables operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "s": T.StringType(),
    "d": T.DoubleType(),
    "i": T.IntegerType(),
    "l": T.LongType(),
    "b": T.BooleanType(),
    "t": T.TimestampNTZType(),
    "m": T.MapType(T.StringType(), T.DoubleType()),
    "as": T.ArrayType(T.StringType()),
    "ad": T.ArrayType(T.DoubleType()),
}


def _table(spec: str) -> T.StructType:
    """`name:kind` words to a StructType."""
    fields = [word.split(":") for word in spec.split()]
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in fields])


MATRIX = _table("gene_id:s sample_id:s value:d")
SAMPLES = _table("sample_id:s label:s batch:s age:d")
EXPRESSION = _table(
    "run_id:s gene_symbol:s ensembl_id:s gene_name:s chromosome:s start:l end:l strand:s sample_id:s patient_id:s"
    " raw_value:d normalized_value:d log2_value:d tpm:d fpkm:d quality:d detection_p:d is_expressed:b source:s platform:s"
)
CLINICAL = _table(
    "run_id:s patient_id:s sample_id:s age:i gender:s race:s ethnicity:s cancer_type:s cancer_subtype:s stage:s grade:s"
    " tumor_size:d node_status:s metastasis_status:s treatment_type:s treatment_response:s treatment_date:t"
    " survival_status:b survival_months:d dfs_months:d pfs_months:d bmi:d smoking:s alcohol:s family_history:b lab_values:m"
)
MUTATION = _table(
    "run_id:s sample_id:s patient_id:s gene:s chromosome:s position:l ref:s alt:s mutation_type:s variant_type:s"
    " amino_acid_change:s vaf:d depth:i alt_depth:i significance:s cosmic_id:s clinvar_id:s annotations:m"
)
METHYLATION = _table(
    "run_id:s sample_id:s probe_id:s gene:s position:l cpg_context:s beta:d m_value:d detection_p:d bead_count:i"
)
PROTEIN = _table(
    "run_id:s sample_id:s protein_symbol:s uniprot:s raw_value:d normalized_value:d log2_value:d quality:d is_detected:b"
)
DATA_QUALITY = _table(
    "run_id:s sample_id:s data_type:s detection_rate:d mean:d median:d variance:d missing_rate:d is_outlier:b outlier_score:d"
)
BIOMARKER_RESULTS = _table(
    "run_id:s gene:s p_value:d p_adj:d log2fc:d effect_size:d effect_type:s importance:d selection_frequency:d"
    " model_performance:m biomarker_type:s level:s confidence:d significance:s"
)
PATHWAY_ENRICHMENTS = _table("run_id:s gene_set:s method:s score:d p_value:d q:d genes:as")
SURVIVAL_ANALYSES = _table(
    "run_id:s gene:s coef:d hazard_ratio:d se:d p_value:d lower:d upper:d concordance:d n:l events:l"
)
EVIDENCE = _table(
    "biomarker:s disease:s level:s study_type:s significance:s n:l p:d effect:d impact:d year:i"
)
GUIDELINES = _table("disease:s biomarker:s min_level:s required_validation:b requirements:as")
RUNS = _table("run_id:s tenant:s owner:s status:s created_at:t updated_at:t configuration:s")
RUN_ARTEFACTS = _table("run_id:s name:s path:s kind:s created_at:t")
METRICS = _table("event_id:l ts:t host:s metric:s value:d")
ALERTS = _table("event_id:l ts:t host:s value:d alert:s severity:s limit:d resolved:b")
MODEL_UPDATES = _table(
    "round_id:l participant:i layer:s weights:ad n:l loss:d accuracy:d aggregated:b created_at:t"
)
TABLES = {k: v for k, v in globals().items() if isinstance(v, T.StructType)}
