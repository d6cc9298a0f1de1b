"""The driver contract, and rules every query keeps."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
ROOT = Path(__file__).resolve().parents[1]
SAMPLE = [
    "flagship_welch_ranking",
    "qc_sample_metrics",
    "norm_quantile",
    "stats_anova",
    "survival_kaplan_meier",
    "pathway_over_representation",
    "network_smooth_only",
    "join_annotation_flags",
    "clinical_rule_compliance",
    "scan_expression_matrix",
    "stream_latest_health",
    "stream_event_deduplication",
]


@pytest.fixture(scope="module")
def con():
    if not Path(SF).exists():
        pytest.skip("no test data here")
    from check_oracle import connect

    return connect(SF)


def test_entry_runs(spark):
    if not Path(SF).exists():
        pytest.skip("no test data here")
    assert len(entry.entry(spark).collect()) == 50


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    from check_oracle import difference

    got = entry.queries()[name](spark, SF).toPandas()
    note = difference(got, con.sql(entry.oracle_sql()[name]).df())
    assert note is None or note.startswith("(types)"), note


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_code_keeps_to_the_rules():
    for path in (ROOT / "genemill").rglob("*.py"):
        text = path.read_text()
        for word in ("localCheckpoint", "crossJoin", ".rdd", "coalesce(1).write"):
            assert word not in text, f"{word} in {path.name}"
        # matrices never reach the driver: operators collect only bounded lists
        for line in text.splitlines():
            if ".toPandas()" in line:
                assert path.name == "pca.py", line
        if path.parent.name == "operators":
            for line in re.findall(r".*F\.broadcast\(.*", text):
                assert "broadcast(table)" in line, line
