"""Replicates fitted together against one fit at a time."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from genemill.operators import selection as S


@pytest.fixture(scope="module")
def cases(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 5)) * [1, 10, 0.1, 3, 0] + [0, 5, 0, -2, 4]
    y = (x[:, 0] + 0.2 * x[:, 1] - 1 + rng.normal(size=120) > 0).astype(int)
    rows = [(f"s{i}", float(b), Vectors.dense(a)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["sample_id", "label", "features"]).repartition(5).persist()


def test_draws_are_poisson_of_mean_one():
    w = S.draws(np.arange(200_000), np.array([0, 1]))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert (w[0] != w[1]).mean() > 0.5 and abs(np.corrcoef(w)[0, 1]) < 0.01


def test_coefficients_equal_a_fit_of_each_replicate(spark, cases):
    fits = S.bootstrap_lasso(cases, range(6), alpha=0.03)
    assert [b for b, _, _ in fits] == list(range(6)) and all(ok for _, _, ok in fits)
    keyed = cases.withColumn("k", F.xxhash64("sample_id", F.lit(42))).toPandas()
    w = S.draws(keyed.k.to_numpy(), np.arange(6))
    for b, got, _ in fits:
        keyed["w"] = w[b]
        size = keyed.groupby("label").w.sum()
        keyed["w"] *= keyed.label.map(keyed.label.value_counts() / size)
        weighted = spark.createDataFrame(keyed[keyed.w > 0][["sample_id", "label", "features", "w"]])
        want = LogisticRegression(
            regParam=0.03, elasticNetParam=1.0, weightCol="w", maxIter=500, tol=1e-10
        ).fit(weighted).coefficients.toArray()
        # the reference divides by n - 1 in the deviations
        assert np.allclose(got, want, atol=0.02 * np.abs(want).max()), (got, want)
        assert got[4] == 0


def test_partitions_do_not_matter_and_shares_are_counts(spark, cases):
    names = [f"f{i}" for i in range(5)]
    a = S.stability_selection(cases, names, 20, alpha=0.05).orderBy("feature").collect()
    b = S.stability_selection(cases.repartition(2), names, 20, alpha=0.05).orderBy("feature").collect()
    assert a == b
    assert [r.n_fits for r in a] == [20] * 5 and [r.n_converged for r in a] == [20] * 5
    score = {r.feature: r.score for r in a}
    assert score["f0"] == score["f1"] == 1.0 and score["f4"] == 0.0


def test_blocks_of_replicates_give_the_same(cases, monkeypatch):
    names = [f"f{i}" for i in range(5)]
    whole = S.stability_selection(cases, names, 5, alpha=0.05).collect()
    monkeypatch.setattr(S, "MOMENT_BYTES", 8 * 49 * 2)
    assert S.stability_selection(cases, names, 5, alpha=0.05).collect() == whole


def test_one_class_and_no_rows(spark, cases):
    names = [f"f{i}" for i in range(5)]
    for none in (cases.filter("label = 1"), cases.limit(0)):
        got = S.stability_selection(none, names, 3).collect()
        assert [(r.score, r.selected, r.n_fits) for r in got] == [(None, None, 0)] * 5


def test_consensus_equals_weighted_correlations(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6, 40))
    label = (x[2] + 0.5 * x[4] > 0).astype(int)
    expr = spark.createDataFrame(
        [(f"g{i}", f"s{j}", float(x[i, j])) for i in range(6) for j in range(40)] + [("g0", "s1", None)],
        "gene_id string, sample_id string, value double",
    ).repartition(7)
    samples = spark.createDataFrame([(f"s{j}", int(label[j])) for j in range(40)], "sample_id string, label int")
    got = {r.feature: r for r in S.bootstrap_consensus(expr, samples, "label", 30, 2, 0.0).collect()}
    keys = np.array([r[0] for r in samples.select(F.xxhash64("sample_id", F.lit(42)), "sample_id").orderBy(F.expr("int(substr(sample_id, 2))")).collect()])
    w = S.draws(keys, np.arange(30))
    score = np.zeros((30, 6))
    for b in range(30):
        for i in range(6):
            c = np.cov(x[i], label, aweights=w[b], ddof=0)
            score[b, i] = abs(c[0, 1]) / np.sqrt(c[0, 0] * c[1, 1])
    rank = (-score).argsort(axis=1).argsort(axis=1)
    want = {f"g{i}": ((rank[:, i] < 2).mean(), (score[:, i] / score.max(axis=1)).mean()) for i in range(6)}
    best = sorted(want, key=lambda g: -want[g][1])[:2]
    assert set(got) == set(best)
    for g in best:
        assert np.allclose([got[g].frequency, got[g].consensus_score], want[g])
