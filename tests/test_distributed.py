"""The plain-window plan and the bucketed plan must give the same rows."""

import numpy as np
import pandas as pd
import pytest

from genemill.operators import distributed as D


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    key = np.where(rng.random(600) < 0.5, "hot", rng.choice(["a", "b", "c"], 600))
    val = np.where(rng.random(600) < 0.4, 0.0, np.round(rng.lognormal(0, 2, 600), 1))
    pdf = pd.DataFrame({"k": key, "id": [f"i{i:04d}" for i in range(600)], "v": val})
    return spark.createDataFrame(pdf), pdf


def _sorted(df):
    return df.toPandas().sort_values(["k", "id"]).reset_index(drop=True)


@pytest.mark.parametrize("method", ["average", "min", "max", "dense", "first"])
def test_ranks(skewed, method):
    df, pdf = skewed
    small = _sorted(D.ranks(df, ["k"], "v", "r", method, tie="id"))
    large = _sorted(D.ranks(df, ["k"], "v", "r", method, tie="id", small=False))
    pdf = pdf.sort_values(["k", "id"]).reset_index(drop=True)
    expected = pdf.groupby("k")["v"].rank(method=method)
    assert np.allclose(small["r"], expected)
    assert np.allclose(large["r"], expected)


def test_percentiles(skewed):
    df, pdf = skewed
    probs = {"q25": 0.25, "q50": 0.5, "q95": 0.95}
    expected = pdf.groupby("k")["v"].quantile([0.25, 0.5, 0.95]).unstack()
    for small in (None, False):
        got = D.percentiles(df, ["k"], "v", probs, small=small).toPandas().set_index("k").sort_index()
        assert np.allclose(got[["q25", "q50", "q95"]], expected)
        whole = D.percentiles(df, [], "v", probs, small=small).toPandas()
        assert np.allclose(whole.iloc[0], pdf["v"].quantile([0.25, 0.5, 0.95]))


def test_ordered_scan_both_directions(skewed):
    df, pdf = skewed
    counts = df.groupBy("k", "v").count()
    specs = {"up": ("sum", "count", "asc"), "down": ("min", "count", "desc")}
    a = D.ordered_scan(counts, ["k"], "v", specs).toPandas().sort_values(["k", "v"])
    b = D.ordered_scan(counts, ["k"], "v", specs, small=False).toPandas().sort_values(["k", "v"])
    assert np.allclose(a[["up", "down"]], b[["up", "down"]])


def test_descending_ordinal(skewed):
    df, _ = skewed
    a = _sorted(D.ordinal_ranks(df, ["k"], "v", "id", descending=True))
    b = _sorted(D.ordinal_ranks(df, ["k"], "v", "id", descending=True, small=False))
    assert (a["rank"] == b["rank"]).all()
