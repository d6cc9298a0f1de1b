"""Operators against NumPy or brute force on small fixtures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from genemill.operators import annotate, batch, federated, network, normalize, padjust, pathways, pca, results, stats, survival, validate
from genemill.operators import evaluate as E
from genemill.operators import selection as S
from genemill.operators import transform as T


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(11)
    genes, samples = [f"g{i:02d}" for i in range(25)], [f"s{i:02d}" for i in range(18)]
    x = rng.lognormal(2, 1, (25, 18)).round(3)
    x[:5, 9:] += 6
    pdf = pd.DataFrame(x, index=genes, columns=samples)
    long = pdf.rename_axis("gene_id").reset_index().melt("gene_id", var_name="sample_id", value_name="value")
    side = pd.DataFrame(
        {"sample_id": samples, "label": [0] * 9 + [1] * 9, "batch": ["a", "b", "c"] * 6, "age": rng.normal(50, 9, 18)}
    )
    return spark.createDataFrame(long).persist(), spark.createDataFrame(side).persist(), pdf, side


def test_mann_whitney_exact_and_t(matrix):
    expr, samples, pdf, _ = matrix
    mw = stats.mann_whitney(expr, samples).toPandas().set_index("gene_id")
    for gene in ("g00", "g20"):
        a, b = pdf.loc[gene].to_numpy()[:9], pdf.loc[gene].to_numpy()[9:]
        u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
        assert mw.loc[gene, "statistic"] == u
    t = stats.t_test(expr, samples).toPandas().set_index("gene_id")
    a, b = pdf.to_numpy()[:, :9], pdf.to_numpy()[:, 9:]
    sp = np.sqrt((a.var(1, ddof=1) + b.var(1, ddof=1)) / 2)
    expected = (a.mean(1) - b.mean(1)) / (sp * math.sqrt(2 / 9))
    assert np.allclose(t.sort_index()["statistic"], expected)


def test_unknown_names_and_empty_overlap(matrix):
    expr, samples, *_ = matrix
    with pytest.raises(ValueError):
        stats.differential_expression(expr, samples, method="nope")
    with pytest.raises(ValueError):
        stats.differential_expression(expr, samples.withColumn("sample_id", F.lit("x")))
    with pytest.raises(ValueError):
        normalize.normalize(expr, "nope")
    with pytest.raises(ValueError):
        normalize.normalize(expr.filter("false"))


@pytest.mark.parametrize("method", [m for m in padjust.METHODS])
def test_adjusted_p_is_valid_and_same_on_both_plans(spark, method):
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.beta(0.3, 1, 60), [0.02, 0.02, 0.5, 1.0]]).round(6)
    df = spark.createDataFrame(pd.DataFrame({"gene": [f"g{i}" for i in range(len(p))], "p_value": p}))
    a = padjust.adjust_p(df, "p_value", method).toPandas().sort_values("gene")
    assert ((a["p_adj"] >= a["p_value"] - 1e-12) | method.startswith(("fdr_ts", "fdr_gbs"))).all()
    assert a["p_adj"].between(0, 1).all()
    order = a.sort_values("p_value")["p_adj"].to_numpy()
    assert (np.diff(order) >= -1e-12).all()
    if method != "none":
        b = padjust.adjust_p(df, "p_value", method, small=False).toPandas().sort_values("gene")
        assert np.allclose(a["p_adj"], b["p_adj"])


def test_hommel_hull_equals_the_quadratic_form():
    rng = np.random.default_rng(6)
    for n in (2, 3, 40, 300):
        p = np.sort(rng.beta(0.5, 1.0, n).round(3))
        ranks = np.arange(1, n + 1)
        slow = np.full(n, (n * p / ranks).min())
        for m in range(n - 1, 1, -1):
            bound = (m * p[n - m + 1 :] / np.arange(2, m + 1)).min()
            q = np.minimum(m * p, bound)
            q[n - m + 1 :] = q[n - m]
            slow = np.maximum(slow, q)
        slow = np.maximum(slow, p)
        u, last = np.unique(p, return_index=False), np.searchsorted(p, np.unique(p), side="right")
        hx, hy = padjust._lower_hull(last.astype(float), u)
        fast = padjust._hommel_values(u, n, hx, hy)
        assert np.allclose(fast, slow[last - 1])


def test_hommel_closed_testing(spark):
    from itertools import combinations

    p = np.array([0.01, 0.02, 0.03, 0.2, 0.6])
    n = len(p)
    expected = []
    for i in range(n):
        worst = 0.0
        for r in range(1, n + 1):
            for c in combinations(range(n), r):
                if i in c:
                    q = np.sort(p[list(c)])
                    worst = max(worst, (q * r / np.arange(1, r + 1)).min())
        expected.append(min(1.0, worst))
    df = spark.createDataFrame(pd.DataFrame({"g": range(n), "p_value": p}))
    got = padjust.adjust_p(df, "p_value", "hommel").toPandas().sort_values("g")["p_adj"]
    assert np.allclose(got, expected)


def test_quantile_normalised_samples_share_a_distribution(matrix):
    expr, *_ = matrix
    for small in (None, False):
        out = normalize.quantile_normalize(expr, small=small).toPandas()
        wide = out.pivot(index="gene_id", columns="sample_id", values="value").to_numpy()
        assert np.allclose(np.sort(wide, axis=0), np.sort(wide, axis=0)[:, [0]])


def test_bootstrap_weights_in_tasks_are_those_of_the_column(spark, monkeypatch):
    ids = spark.range(40).select((F.col("id") * 977 - 3).alias("id"))
    want = ids.crossJoin(spark.range(50).select(F.col("id").cast("int").alias("rep"))).select(
        "id", "rep", S.poisson_weight(F.col("id"), F.col("rep") + F.lit(7)).alias("w")
    ).toPandas().pivot(index="id", columns="rep", values="w")
    hashed = ids.orderBy("id").select(F.xxhash64("id")).toPandas().to_numpy()[:, 0]
    assert (S.poisson_weights(hashed, np.arange(50) + 7) == want.to_numpy()).all()
    monkeypatch.setattr(E, "REPLICATE_CELLS", 20)
    cases = ids.select(F.lit("m").alias("model"), "id", (F.col("id") % 2).alias("y"), (F.col("id") % 5 / 4).alias("score"))
    got = E._replicate_weights(cases, 50, 0).groupBy("rep").agg(F.sum("w").alias("w")).orderBy("rep").toPandas()["w"]
    assert (got.to_numpy() == S.poisson_weights(hashed, np.arange(50)).sum(axis=0)).all()


def test_equal_final_scores_are_ranked_by_gene(spark):
    stat = spark.createDataFrame([("p", "a", True), ("fc", "a", False)], "method string, gene string, significant boolean")
    ml = spark.createDataFrame([("b", 0.75)], "gene string, consensus_score double")
    got = {r.gene: (r.final_score, r.final_rank) for r in results.merge_evidence(stat, ml).collect()}
    assert got == {"a": (0.3, 1), "b": (0.3, 2)}


def test_tmm_keeps_all_genes_that_tie_at_a_cut(spark):
    # 182 * 88 = 91 * 176: one mean of logarithms, at places 7 and 8 of 11, and 0.7 cuts at place 7
    cells = [(i + 1, 2) for i in range(7)] + [(181, 87), (90, 175), (300, 200), (400, 300)]
    rows = [(f"g{i}", s, float(c[j])) for i, c in enumerate(cells) for j, s in enumerate(("x", "ref"))]
    expr = spark.createDataFrame(rows, "gene_id string, sample_id string, value double")
    found = {r.sample_id: r.size_factor for r in normalize.tmm_factors(expr, "ref").collect()}
    x, r = np.array(cells, dtype=float).T + 1
    a, m = 0.5 * np.log2(x * r), np.log2(x / r)
    keep = slice(3, 9)
    assert np.isclose(found["x"], np.exp((m / (1 + a))[keep].sum() / (1 / (1 + a))[keep].sum()))


def test_batch_correction_levels_the_means(matrix):
    expr, samples, *_ = matrix
    out = batch.correct(expr, samples, "linear_regression", covariates=["age"])
    m = out.join(samples, "sample_id").groupBy("gene_id", "batch").agg(F.avg("value").alias("m")).toPandas()
    assert m.groupby("gene_id")["m"].apply(lambda v: v.max() - v.min()).max() < 1e-8
    coef = batch.linear_coefficients(out, samples, "age").toPandas()["coefficient"]
    assert np.abs(coef).max() < 1e-8


def test_pca_gram_and_subspace_agree(matrix):
    expr, samples, pdf, _ = matrix
    z = pdf.sub(pdf.mean(1), axis=0).div(pdf.std(1, ddof=0), axis=0).to_numpy().T
    s = np.linalg.svd(z, compute_uv=False)
    a = pca.pca(expr, 3)
    ratio = a.variance.orderBy("component").toPandas()["ratio"].to_numpy()
    assert np.allclose(ratio, (s**2 / (s**2).sum())[:3])
    b = pca.pca(expr, 3, gram_limit=1)
    assert np.allclose(b.variance.orderBy("component").toPandas()["ratio"], ratio, atol=1e-6)
    x = a.scores.toPandas().sort_values(["component", "sample_id"])["score"].to_numpy()
    y = b.scores.toPandas().sort_values(["component", "sample_id"])["score"].to_numpy()
    assert np.allclose(x, y, atol=1e-3)
    full = pca.pca(expr, 18)
    rebuilt = full.scores.join(full.loadings, "component").groupBy("gene_id", "sample_id").agg(
        F.sum(F.col("score") * F.col("loading")).alias("v")
    ).toPandas().pivot(index="sample_id", columns="gene_id", values="v").to_numpy()
    assert np.allclose(rebuilt, z, atol=1e-8)


def test_pca_of_few_genes_needs_no_rounds_whatever_the_samples(spark, monkeypatch):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(size=(40, 7)) @ np.diag(range(1, 8)), [f"s{i:02d}" for i in range(40)], list("abcdefg"))
    expr = spark.createDataFrame(pdf.rename_axis("sample_id").reset_index().melt("sample_id", var_name="gene_id"))
    whole = pca.pca(expr, 5)
    monkeypatch.setattr(pca, "_subspace", lambda *_: pytest.fail("the Gram matrix of the genes is small"))
    monkeypatch.setattr(pca, "BLOCK_CELLS", 30)
    few = pca.pca(expr, 40, gram_limit=10)  # samples beyond the limit, genes within
    z = ((pdf - pdf.mean()) / pdf.std(ddof=0)).to_numpy()
    u, s, v = np.linalg.svd(z, full_matrices=False)
    sign = np.sign(u[np.abs(u).argmax(0), range(7)])
    got = few.scores.toPandas().pivot(index="sample_id", columns="component", values="score").to_numpy()
    assert np.allclose(got, u * s * sign)
    load = few.loadings.toPandas().pivot(index="gene_id", columns="component", values="loading").to_numpy()
    assert np.allclose(load, v.T * sign)
    five = whole.scores.toPandas().pivot(index="sample_id", columns="component", values="score").to_numpy()
    assert np.allclose(five, got[:, :5])
    pairs = pca.inner_products(few.scores, block=9).toPandas()
    names = list(pdf.index)
    assert sorted(zip(pairs["sample_1"], pairs["sample_2"])) == [(a, b) for i, a in enumerate(names) for b in names[i:]]
    i, j = (pairs[c].map(names.index).to_numpy() for c in ("sample_1", "sample_2"))
    assert np.allclose(pairs["product"], (z @ z.T)[i, j])


def test_products_of_samples_are_shuffled_in_few_copies(spark):
    rng = np.random.default_rng(5)
    names, v = [f"s{i}" for i in rng.permutation(70)], rng.normal(size=(70, 3))
    cells = [(n, j + 1, float(x)) for n, r in zip(names, v) for j, x in enumerate(r)]
    scores = spark.createDataFrame(cells, "sample_id string, component int, score double")
    found = pca.inner_products(scores, block=1)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.collect()
    got = {(r.sample_1, r.sample_2): r["product"] for r in rows}
    want = {(a, b): v[i] @ v[j] for i, a in enumerate(names) for j, b in enumerate(names) if a <= b}
    assert len(rows) == len(want) and got.keys() == want.keys()
    assert all(np.isclose(got[x], want[x]) for x in want)
    vectors = spark.createDataFrame(list(zip(names, v.tolist())), "sample_id string, v array<double>")
    assert pca._block_pairs(vectors, pca.MOST_BLOCKS).count() == (pca.MOST_BLOCKS + 1) * 70
    assert pca.inner_products(scores.limit(0)).count() == 0


@pytest.fixture(scope="module")
def subjects(spark):
    rng = np.random.default_rng(2)
    n = 60
    pdf = pd.DataFrame(
        {
            "sample_id": [f"s{i}" for i in range(n)],
            "time": rng.integers(1, 25, n).astype(float),
            "event": rng.integers(0, 2, n),
            "x": rng.normal(size=n).round(1),
            "w": rng.normal(size=n),
        }
    )
    return spark.createDataFrame(pdf).persist(), pdf


def test_concordance_both_plans(subjects):
    df, pdf = subjects
    pairs = good = tied = 0
    for a in pdf.itertuples():
        for b in pdf.itertuples():
            if a.event == 1 and (a.time < b.time or (a.time == b.time and b.event == 0)):
                pairs += 1
                good += a.x > b.x
                tied += a.x == b.x
    for small in (None, False):
        row = survival.concordance(df, risk="x", small=small).first()
        assert (row["pairs"], row["good"], row["tied"]) == (pairs, good, tied)


def _efron(beta, pdf, cols):
    eta = pdf[cols].to_numpy() @ beta
    ll = 0.0
    for t in np.unique(pdf["time"][pdf["event"] == 1]):
        risk = np.exp(eta[(pdf["time"] >= t).to_numpy()]).sum()
        d = ((pdf["time"] == t) & (pdf["event"] == 1)).to_numpy()
        tied = np.exp(eta[d]).sum()
        ll += eta[d].sum() - sum(math.log(risk - k / d.sum() * tied) for k in range(d.sum()))
    return ll


def test_cox_maximises_efron_likelihood(subjects):
    df, pdf = subjects
    fit = survival.cox(df, ["x", "w"], penalizer=0.0).toPandas().set_index("covariate")
    best = fit.loc[["x", "w"], "coef"].to_numpy()
    top = _efron(best, pdf, ["x", "w"])
    assert abs(fit["log_likelihood"].iloc[0] - top) < 1e-8
    for step in ([1e-3, 0], [-1e-3, 0], [0, 1e-3], [0, -1e-3]):
        assert _efron(best + np.array(step), pdf, ["x", "w"]) < top
    shrunk = survival.cox(df, ["x", "w"], penalizer=0.5).toPandas().set_index("covariate")
    assert (shrunk["coef"].abs() <= fit["coef"].abs() + 1e-9).all()


@pytest.mark.parametrize("ties,spread", [(1, 1.0), (5, 0.1), (17, 2.0), (400, 0.01), (400, 50.0), (30_000, 1.0)])
def test_tie_sums_equal_term_by_term_sums(spark, ties, spread):
    """Log-likelihood, gradient and information at one event time against the sum over all tied events."""
    rng = np.random.default_rng(ties)
    n = ties + int(ties * spread) + 1
    x, event = rng.normal(size=n), np.r_[np.ones(ties, int), np.zeros(n - ties, int)]
    time = np.where(event == 1, 5.0, np.where(rng.random(n) < 0.5, 5.0, 9.0))
    df = spark.createDataFrame(pd.DataFrame({"time": time, "event": event, "x": x}))
    row = survival._score(df, [], F.col("x") * 0.4, ["x"], True).first()
    w, dead = np.exp(0.4 * x), event == 1
    f = np.arange(ties) / ties
    z = [(w * x**k).sum() - f * (w * x**k)[dead].sum() for k in range(3)]
    assert row.ll == pytest.approx((0.4 * x[dead]).sum() - np.log(z[0]).sum(), rel=1e-10, abs=1e-9)
    assert row.g0 == pytest.approx(x[dead].sum() - (z[1] / z[0]).sum(), rel=1e-8, abs=1e-8)
    assert row.h0_0 == pytest.approx((z[2] / z[0] - (z[1] / z[0]) ** 2).sum(), rel=1e-8, abs=1e-10)


def test_a_million_tied_events(spark):
    """A time with a million events is one row of sums; with equal weights they are those of a harmonic series."""
    d = 1_000_000
    df = spark.range(d + 1).select(
        F.lit(3.0).alias("time"), F.when(F.col("id") < d, 1).otherwise(0).alias("event"), (F.col("id") % 2).cast("double").alias("x")
    )
    row = survival._score(df, [], F.lit(0.0), ["x"], True).first()
    f = np.arange(d) / d
    z0, z1 = d + 1 - f * d, (d + 1) // 2 - f * (d // 2)
    assert row.ll == pytest.approx(-np.log(z0).sum(), rel=1e-12)
    assert row.g0 == pytest.approx(d // 2 - (z1 / z0).sum(), rel=1e-6, abs=1e-6)
    assert row.h0_0 == pytest.approx((z1 / z0 - (z1 / z0) ** 2).sum(), rel=1e-9)


def test_univariate_cox_equals_single_fits(spark, subjects):
    df, pdf = subjects
    long = df.select("sample_id", F.lit("x").alias("gene_id"), F.col("x").alias("value")).unionByName(
        df.select("sample_id", F.lit("w").alias("gene_id"), F.col("w").alias("value"))
    )
    got = survival.univariate_cox(df, long).toPandas().set_index("gene_id")
    for c in ("x", "w"):
        one = survival.cox(df, [c], penalizer=0.0).first()
        assert abs(got.loc[c, "coef"] - one["coef"]) < 1e-6
        assert abs(got.loc[c, "p_value"] - one["p_value"]) < 1e-6


def test_kaplan_meier_both_ends(spark):
    df = spark.createDataFrame(
        [(float(t), e, "g") for t, e in [(1, 1), (2, 0), (3, 1), (3, 1), (5, 0), (6, 1)]], "time double, event int, grp string"
    )
    km = survival.kaplan_meier(df).orderBy("time").toPandas()
    assert np.allclose(km["survival"], [5 / 6, 5 / 6, 5 / 12, 5 / 12, 0.0])


def test_logrank_k_groups_is_two_group_formula(spark, subjects):
    df, pdf = subjects
    two = survival.logrank(df.withColumn("grp", F.when(F.col("x") > 0, "a").otherwise("b"))).first()
    assert two["df"] == 1 and 0 <= two["p_value"] <= 1
    three = survival.logrank(df.withColumn("grp", F.pmod(F.xxhash64("sample_id"), F.lit(3)).cast("string"))).first()
    assert three["df"] == 2


def test_gsea_score_is_the_running_sum_peak(spark):
    rng = np.random.default_rng(9)
    score = np.sort(rng.normal(size=40))[::-1]
    genes = [f"g{i:02d}" for i in range(40)]
    member = {"up": genes[:8], "mix": genes[::5]}
    scores = spark.createDataFrame(pd.DataFrame({"gene": genes, "score": score}))
    sets = spark.createDataFrame([(s, g) for s, gs in member.items() for g in gs], "gene_set string, gene string")
    got = pathways.enrichment_scores(scores, sets, 2, 100).toPandas().set_index("gene_set")
    for name, gs in member.items():
        hit = np.isin(genes, gs)
        run = np.cumsum(np.where(hit, np.abs(score) / np.abs(score)[hit].sum(), -1 / (40 - hit.sum())))
        peak = run[np.argmax(np.abs(run))]
        assert abs(got.loc[name, "es"] - peak) < 1e-12
    full = pathways.gsea(scores, sets, 2, 100, n_perm=30).toPandas().set_index("gene_set")
    assert full.loc["up", "p_value"] <= 0.1 and full["fdr"].between(0, 1).all()


def test_auc_matches_pair_counting_on_both_plans(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"model": "m", "id": range(80), "y": rng.integers(0, 2, 80), "score": rng.random(80).round(1)})
    df = spark.createDataFrame(pdf)
    pos, neg = pdf[pdf.y == 1].score.to_numpy(), pdf[pdf.y == 0].score.to_numpy()
    expected = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    for small in (None, False):
        assert abs(E.auc(df, small=small).first()["roc_auc"] - expected) < 1e-12


def test_exact_label_permutation_matches_simulation(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"model": "m", "id": range(60), "y": rng.integers(0, 2, 60)})
    pdf["yhat"] = np.where(rng.random(60) < 0.6, pdf["y"], 1 - pdf["y"])
    exact = E.permutation_accuracy_exact(spark.createDataFrame(pdf)).first()["p_value"]
    acc = (pdf.y == pdf.yhat).mean()
    sim = np.mean([(rng.permutation(pdf.y) == pdf.yhat).mean() >= acc for _ in range(4000)])
    assert abs(exact - sim) < 0.05


def test_shapiro_ranks_once_and_equals_known_values(spark):
    # the eleven weights of Shapiro and Wilk's paper, and a sample of four
    sets = {"w": [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], "s": [1.0, 2.0, 4.0, 8.0]}
    rows = [(g, f"s{i}", float(v)) for g, vs in sets.items() for i, v in enumerate(vs)]
    out = T.shapiro_wilk(spark.createDataFrame(rows, "gene_id string, sample_id string, value double"))
    assert out._jdf.queryExecution().analyzed().toString().count("row_number()") == 1
    got = {r.gene_id: (r.w, r.p_value) for r in out.collect()}
    assert abs(got["w"][0] - 0.79) < 0.005 and abs(got["w"][1] - 0.0067) < 5e-4
    assert abs(got["s"][0] - 0.9247) < 0.02


def test_mann_whitney_scans_distinct_values_only(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"gene_id": "g", "sample_id": [f"s{i}" for i in range(400)], "value": rng.integers(0, 7, 400) / 2})
    pdf.loc[:3, "value"] = [np.nan, np.nan, 90.5, -0.0]
    side = pd.DataFrame({"sample_id": pdf.sample_id, "label": rng.integers(0, 2, 400)})
    seen, scan = [], stats.ordered_scan
    monkeypatch.setattr(stats, "ordered_scan", lambda df, *a, **k: (seen.append(df.count()), scan(df, *a, **k))[1])
    expr = spark.createDataFrame(pdf).withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    args = (expr, spark.createDataFrame(side), "label")
    r = stats.mann_whitney(*args).first()
    monkeypatch.setattr(stats, "fits", lambda *a: False)
    big = stats.mann_whitney(*args).first().asDict()
    assert seen == [8, 8]
    d = pdf.merge(side).dropna()
    a, b = d[d.label == 0].value.to_numpy(), d[d.label == 1].value.to_numpy()
    ranks = d.value.rank()
    assert (r.n1, r.n2, r.median1, r.median2) == (len(a), len(b), np.median(a), np.median(b))
    assert abs(r.mean1 - a.mean()) < 1e-12 and abs(r.mean2 - b.mean()) < 1e-12
    assert r.statistic == ranks[d.label == 0].sum() - len(a) * (len(a) + 1) / 2
    assert all(big[k] == v or abs(big[k] - v) < 1e-12 for k, v in r.asDict().items() if k != "gene_id")


def test_mapped_ids_are_averaged_apart_from_the_join(spark):
    expr = spark.createDataFrame([("a", "s", 1.0), ("b", "s", 4.0), ("c", "s", 7.0), ("x", "s", None)], "gene_id string, sample_id string, value double")
    out = annotate.map_gene_ids(expr, spark.createDataFrame([("a", "c"), ("b", "d"), ("x", "d")], "from_id string, to_id string"))
    assert {tuple(r) for r in out.collect()} == {("c", "s", 4.0), ("d", "s", 4.0)}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("partial_avg") < plan.index("REPARTITION_BY_COL") < plan.index("Join")


def test_feature_matrices_of_queries_read_the_cells_once(spark):
    from genemill.operators.distributed import release
    from genemill.plans.model_queries import _matrix
    from genemill.plans.standins import Tables

    tables = Tables(spark, "/root/testdata/sf0.001")
    data, names = _matrix(tables, 4)
    assert len(names) == 4 and tables.expr().storageLevel.useMemory
    data.unpersist()
    release()


def test_label_shuffles_rank_few_cases_and_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"model": ["a"] * 6000 + ["b"] * 50, "id": range(6050), "y": rng.integers(0, 3, 6050)})
    pdf["yhat"] = np.where(rng.random(6050) < 0.02, pdf["y"], rng.integers(0, 4, 6050))
    ranked, ordinal_ranks = [], E.ordinal_ranks
    monkeypatch.setattr(E, "ordinal_ranks", lambda df, *a, **k: (ranked.append(df.count()), ordinal_ranks(df, *a, **k))[1])
    got = E.permutation_accuracy(spark.createDataFrame(pdf), 20, 3).toPandas().set_index("model")
    assert sum(ranked) < 6050 * 20 / 200
    h = spark.createDataFrame(pdf).crossJoin(spark.range(20).select(F.col("id").cast("int").alias("rep")))
    h = h.select("model", "rep", "y", "yhat", "id", F.xxhash64("id", F.col("rep") + 400000).alias("h")).toPandas()
    h["h"] = h["h"].to_numpy().view(np.uint64)
    for model, part in h.groupby("model"):
        acc = [(g.sort_values("h").yhat.to_numpy() == np.sort(g.y)).mean() for _, g in part.groupby("rep")]
        true = (part.y == part.yhat).mean()
        assert abs(got.loc[model, "mean_permuted"] - np.mean(acc)) < 1e-12
        assert got.loc[model, "share"] == np.mean([x >= true - 1e-12 for x in acc])


def test_split_and_folds_are_stratified(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("sample_id"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    s = E.stratified_split(df, {"train": 0.8, "test": 0.2}).groupBy("label", "split").count().toPandas()
    assert set(map(tuple, s.values)) == {(0, "train", 120), (0, "test", 30), (1, "train", 40), (1, "test", 10)}
    f = E.stratified_folds(df, 5).groupBy("fold", "label").count().toPandas()
    assert f.groupby("label")["count"].nunique().max() == 1


def test_ring_masks_cancel_and_leave_the_average(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "l", p, float(rng.normal())) for i in range(5) for p in range(3)]
    w = spark.createDataFrame(rows, "participant int, layer string, pos int, w double")
    m = federated.add_ring_masks(w, 5)
    assert federated.mask_sums(m).filter("not zero_sum").count() == 0
    sums = m.groupBy("pos").agg(F.sum("w").alias("a"), F.sum("masked").alias("b")).toPandas()
    assert np.allclose(sums["a"], sums["b"])
    assert m.filter("abs(mask) < 1e-12").count() == 0


def test_smoothing_by_blocks_equals_the_join(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5), ("a", "a", 0.2), ("c", "d", 1.0)], "src string, dst string, weight double")
    cells = [("a", "s", 2.0), ("b", "s", None), ("b", "t", None), ("c", "t", 4.0), ("d", "u", 5.0)]
    expr = spark.createDataFrame(cells, "gene_id string, sample_id string, value double")
    dense = {r[:] for r in network.smooth_expression(expr, edges).collect()}
    assert ("c_nbr", "u", 5.0) in dense and ("a_nbr", "t", None) in dense
    monkeypatch.setattr(network, "DENSE_GENES", 0)
    assert dense == {r[:] for r in network.smooth_expression(expr, edges).collect()}


def test_smoothing_equals_matrix_product(spark, matrix):
    expr, _, pdf, _ = matrix
    edges = spark.createDataFrame([("g00", "g01", 2.0), ("g01", "g02", 0.5), ("g00", "zz", 9.0)], "src string, dst string, weight double")
    genes = expr.select(F.col("gene_id").alias("gene")).distinct()
    a = np.eye(25)
    a[0, 1] = a[1, 0] = 2.0
    a[1, 2] = a[2, 1] = 0.5
    d = 1 / np.sqrt(a.sum(1) + 1e-8)
    expected = (d[:, None] * a * d[None, :]) @ pdf.to_numpy()
    sm = network.smooth_expression(expr, network.normalized_adjacency(network.adjacency(edges, genes)), "smooth_only")
    got = sm.toPandas().pivot(index="gene_id", columns="sample_id", values="value").sort_index().to_numpy()
    assert np.allclose(got, expected)


def test_validation_finds_planted_problems(spark, matrix):
    expr, samples, *_ = matrix
    bad = expr.withColumn("value", F.when(F.col("gene_id") == "g01", -1.0).otherwise(F.col("value")))
    checks = {r["check"]: r["status"] for r in validate.six_checks(bad, samples).collect()}
    assert checks["data_quality"] == "warning" and checks["duplicates"] == "passed"
    issues = validate.integrity_issues(expr, samples.limit(3)).toPandas()
    assert "few_common_samples" in set(issues["check"])
    with pytest.raises(ValueError):
        validate.raise_on_errors(validate.integrity_issues(expr, samples.limit(3)))


def test_top_scores_prefers_planted_genes(matrix):
    expr, samples, *_ = matrix
    top = {r["feature"] for r in S.top_scores(S.f_scores(expr, samples, "label"), 5).collect()}
    assert len(top & {f"g0{i}" for i in range(5)}) >= 3


def test_enrichment_null_is_the_same_by_arrow_and_by_joins(spark):
    rng = np.random.default_rng(4)
    genes = [f"g{i}" for i in range(300)]
    scores = spark.createDataFrame([(g, float(v)) for g, v in zip(genes, rng.normal(size=300))], "gene string, score double")
    sets = [(f"s{k}", g) for k in range(6) for g in rng.choice(genes, 5 + 20 * k, replace=False)]
    sets += [("all", g) for g in genes]
    sets = spark.createDataFrame(sets, "gene_set string, gene string")
    ranked = pathways.ranked_list(scores).cache()
    hits = pathways._sized_hits(ranked, sets, 1, 300)
    a, b = (
        pathways.null_scores(ranked, hits, 300, 300, 60, 1.0, 42, by_joins=j).toPandas().sort_values(["rep", "gene_set"])
        for j in (False, True)
    )
    assert len(a) == 60 * 7
    assert (a[["rep", "gene_set"]].to_numpy() == b[["rep", "gene_set"]].to_numpy()).all()
    assert np.allclose(a["es"], b["es"], atol=1e-9)
    got = pathways.gsea(scores, sets, 1, 300, n_perm=60).toPandas().set_index("gene_set")
    null = a.set_index("gene_set")["es"]
    for name, row in got.iterrows():
        same = null[name][np.sign(null[name] + 1e-300) == np.sign(row["es"] + 1e-300)]
        want = (abs(same) >= abs(row["es"])).mean() if len(same) else 1.0
        assert abs(row["p_value"] - want) < 1e-9


@pytest.mark.parametrize("kind", ["yeo-johnson", "box-cox"])
def test_power_lambda_is_the_maximum(spark, kind):
    rng = np.random.default_rng(7)
    data = {
        "a": rng.lognormal(1, 1, 200), "b": rng.gamma(3, 2, 150), "c": rng.normal(5, 0.5, 120) ** 3,
        "d": 1 / rng.gamma(4, 1, 100), "e": np.full(20, 3.0),
    }
    if kind == "yeo-johnson":
        data["f"] = rng.normal(-1, 2, 200) ** 3
    rows = [(g, f"s{i}", float(v)) for g, vs in data.items() for i, v in enumerate(vs)] + [("a", "none", None)]
    got = {r[0]: r[1] for r in T.power_lambdas(spark.createDataFrame(rows, "gene_id string, sample_id string, value double"), kind).collect()}

    def likelihood(x, lam):
        size, sign = (np.log(x), np.ones_like(x)) if kind == "box-cox" else (np.log1p(abs(x)), np.where(x >= 0, 1.0, -1.0))
        m = lam if kind == "box-cox" else np.where(sign > 0, lam, 2 - lam)
        y = sign * np.where(abs(m) < 1e-12, size, np.expm1(m * size) / np.where(m == 0, 1, m))
        return -len(x) / 2 * np.log(y.var()) + (lam - 1) * (sign * size).sum()

    assert got.pop("e") == 1.0
    for g, lam in got.items():
        assert lam * 4096 == round(lam * 4096)
        best = max(np.arange(-6, 6, 1 / 256), key=lambda v: likelihood(data[g], v))
        fine = max(best + np.arange(-32, 33) / 4096, key=lambda v: likelihood(data[g], v))
        assert abs(lam - fine) <= 1 / 4096
