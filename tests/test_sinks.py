"""Sinks: matrices of any width and odd names, analysis tables, and the strength model."""

import json

import pytest
from pyspark.sql import functions as F

from genemill.operators import clinical as CL
from genemill.sources import readers as RD
from genemill.sources import writers as W

CELLS = "gene_id string, sample_id string, value double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def text(path):
    return sorted(line for f in path.glob("part-*") for line in f.read_text().splitlines())


@pytest.mark.parametrize("fmt", ["tsv", "csv"])
def test_a_matrix_comes_back_cell_by_cell(spark, tmp_path, fmt):
    sep = W.SEPARATORS[fmt]
    cells = [
        ("g1", "s1", 1.5), ("g1", "s3", -2.0), ("g2", "s2", 0.0), ("g3", "s1", None), (" g 4 ", "a,b", 1e-300),
        ('q"t', 's"4', 7.0), ("back\\slash", "s\\5", 8.0), ("tab\tbed", "s1", 9.0),
    ]
    W.write_matrix(spark.createDataFrame(cells, CELLS), str(tmp_path / "m"), fmt)
    got = RD.matrix_lines(spark, str(tmp_path / "m"), sep)
    assert rows(got) == sorted((c for c in cells if c[2] is not None), key=repr)
    wide = spark.read.option("ignoreLeadingWhiteSpace", False).csv(str(tmp_path / "m"), header=True, sep=sep)
    assert wide.columns == ["gene_id", "a,b", 's"4', "s1", "s2", "s3", "s\\5"]
    assert {r.gene_id for r in wide.collect()} == {c[0] for c in cells}


def test_repeats_nulls_and_nothing(spark, tmp_path):
    cells = [("g", "s", 2.0), ("g", "s", 1.0), ("g", "s", None), ("g", "t", 5.0), ("g", None, 3.0), (None, "s", 4.0), ("n", "t", None)]
    W.write_matrix(spark.createDataFrame(cells, CELLS), str(tmp_path / "m"))
    assert set(text(tmp_path / "m")) == {"gene_id\ts\tt", "g\t1.0\t5.0", "\t4.0\t", "n\t\t"}
    W.write_matrix(spark.createDataFrame([], CELLS), str(tmp_path / "none"))
    assert rows(RD.matrix_lines(spark, str(tmp_path / "none"), "\t")) == []


def test_more_samples_than_a_table_has_columns(spark, tmp_path):
    n = 30_000
    wide = spark.range(2 * n).selectExpr("concat('g', id % 2) AS gene_id", "concat('s', id div 2) AS sample_id", "cast(id AS double) AS value")
    W.write_matrix(wide, str(tmp_path / "m"))
    got = RD.matrix_lines(spark, str(tmp_path / "m"), "\t")
    assert got.exceptAll(wide).isEmpty() and got.count() == 2 * n


def test_each_analysis_has_its_sink(spark, tmp_path):
    tests = spark.createDataFrame(
        [("t_test", "g1", 0.01, True), ("t_test", "g2", 0.9, False), ("anova", "g2", 0.02, True)],
        "method string, gene_id string, p_adj double, significant_adj boolean",
    )
    W.write_statistics(tests, str(tmp_path / "s"), "csv")
    assert set(text(tmp_path / "s")) == {"method,gene", "t_test,g1", "anova,g2"}
    W.write_statistics(tests, str(tmp_path / "sj"))
    assert sorted(json.loads(line)["gene_id"] for line in text(tmp_path / "sj/tests")) == ["g1", "g2", "g2"]
    ora = spark.createDataFrame([("A", 0.01), ("B", 0.2)], "gene_set string, p_adj double")
    gsea = spark.createDataFrame([("A", 0.5), ("C", 0.001)], "gene_set string, fdr double")
    W.write_pathways(ora, gsea, str(tmp_path / "p"), "csv")
    assert set(text(tmp_path / "p")) == {"gene_set,method,q", "A,ora,0.01", "C,gsea,0.001"}
    W.write_pathways(ora.limit(0), None, str(tmp_path / "pe"), "csv")
    assert text(tmp_path / "pe") == ["gene_set,method,q"]
    flags = spark.createDataFrame(
        [("g1", True, False, None), ("g2", False, False, True)],
        "gene string, is_cancer_gene boolean, has_pathogenic boolean, has_therapeutic boolean",
    )
    W.write_annotation(flags, ["x", "y"], str(tmp_path / "a"), "csv")
    assert text(tmp_path / "a") == ['2,1,1,"x,y"', "n_genes,cancer_genes_count,clinical_genes_count,databases"]
    W.write_evaluation(tests, str(tmp_path / "e"), folds=ora)
    assert len(text(tmp_path / "e/metrics")) == 3 and len(text(tmp_path / "e/folds")) == 2
    with pytest.raises(ValueError, match="unsupported format csv"):
        W.write_evaluation(tests, str(tmp_path / "x"), "csv")


def test_strength_model_takes_any_number_of_categories(spark):
    past = spark.range(3000).selectExpr(
        "concat('b', id) AS biomarker", "concat('d', id % 700) AS disease", "array('A', 'B', 'C')[id % 3] AS evidence_level",
        "array('strong', 'moderate', 'weak')[id % 3] AS strength",
    )
    model = CL.strength_model(past, trees=10)
    got = model.transform(past).selectExpr("count_if(strength = prediction) AS right", "count(*) AS n").first()
    assert (got.right, got.n) == (3000, 3000)
    new = spark.createDataFrame([("never", "seen", "A"), (None, None, None)], "biomarker string, disease string, evidence_level string")
    assert {r.prediction for r in model.transform(new).collect()} <= set(CL.STRENGTH_POINTS)
    assert CL.strength_model(past.limit(9)) is None
    assert CL.strength_model(past.selectExpr("biomarker", "disease", "evidence_level", "cast(NULL AS string) AS strength")) is None


def test_wide_readers_take_any_number_of_columns(spark, tmp_path):
    n = 21_000  # the CSV reader stops at 20,480
    head = ",".join(["id", *(f"S{i}" for i in range(n))])
    lines = [",".join([f'"g,{g}"', *(str(g * (i % 3)) for i in range(n))]) for g in (1, 2, 0)]
    path = str(tmp_path / "wide.csv")
    (tmp_path / "wide.csv").write_text("\n".join([head, *lines, ""]))
    got = RD.omics_matrix(spark, path).groupBy("gene_id").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    assert {r.gene_id: (r.s, r.n) for r in got.collect()} == {"g,1": (float(n), n), "g,2": (2.0 * n, n)}
    turned = RD.pipeline_matrix(spark, path).agg(F.count_distinct("gene_id"), F.count_distinct("sample_id"))
    assert turned.first()[:] == (n, 3)


def test_wide_readers_keep_empty_and_odd_cells_as_nulls(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text('id,a,"b,c",a,text\ng1,1,"2",,x\n\ng2,3,nan?,4,y,9\ng3,5\n')
    got = {(r.gene_id, r.sample_id): r.value for r in RD.omics_matrix(spark, str(path)).collect()}
    assert got == {
        ("g1", "a1"): 1.0, ("g1", "b,c"): 2.0, ("g1", "a3"): None,
        ("g2", "a1"): 3.0, ("g2", "b,c"): None, ("g2", "a3"): 4.0,
        ("g3", "a1"): 5.0, ("g3", "b,c"): None, ("g3", "a3"): None,
    }
