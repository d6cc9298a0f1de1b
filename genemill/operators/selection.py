"""Feature selection: filter scores, model-based selections, voting and consensus.

Every method returns rows (feature, score); selections are rows
(method, feature, score, rank), so votes and consensus are plain aggregations.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genemill.operators import stats
from genemill.operators.distributed import ordinal_ranks, reuse, top_per_key
from genemill.operators.normalize import tagged

MAX_MODEL_FEATURES = 20_000


# ---- filter scores ---------------------------------------------------------------------------


def variance_scores(expr: DataFrame, samples=None, label=None) -> DataFrame:
    return expr.groupBy(F.col("gene_id").alias("feature")).agg(F.var_samp("value").alias("score"))


def f_scores(expr: DataFrame, samples: DataFrame, label: str, numeric: bool = False) -> DataFrame:
    """ANOVA F for class labels, regression F for numeric ones."""
    res = (stats.regression if numeric else stats.anova)(expr, samples, label)
    return res.select(F.col("gene_id").alias("feature"), F.coalesce("statistic", F.lit(0.0)).alias("score"))


def correlation_scores(expr: DataFrame, samples: DataFrame, label: str) -> DataFrame:
    """|Pearson r| with the numeric or encoded label; undefined counts as 0."""
    from genemill.functions.columns import encode_labels

    s = samples.select("sample_id", label)
    if s.schema[label].dataType.simpleString() == "string":
        s = encode_labels(s, label, "_code").select("sample_id", F.col("_code").alias(label))
    d = stats.labelled(expr, s, label)
    r = F.abs(F.corr("value", F.col("grp").cast("double")))
    return d.groupBy(F.col("gene_id").alias("feature")).agg(
        F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)).alias("score")
    )


def chi2_scores(expr: DataFrame, samples: DataFrame, label: str) -> DataFrame:
    """Class sums against class share times the total; values are shifted when one is negative."""
    low = expr.agg(F.least(F.lit(0.0), F.min("value")).alias("lo")).scalar()
    d = stats.labelled(expr, samples, label).withColumn("value", F.col("value") - low)
    units = d.select("sample_id", "grp").distinct()
    shares = units.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    total = units.agg(F.count(F.lit(1)).alias("t")).scalar()
    seen = d.groupBy("gene_id", "grp").agg(F.sum("value").alias("o"))
    whole = seen.groupBy("gene_id").agg(F.sum("o").alias("t"), F.count(F.lit(1)).alias("k"))
    j = seen.join(whole, "gene_id").join(shares, "grp")
    expected = F.col("n") / total * F.col("t")
    # classes without any cell of the gene add their whole expected sum
    part = j.groupBy("gene_id").agg(
        F.sum(F.pow(F.col("o") - expected, F.lit(2)) / expected - expected).alias("s"),
        F.max("t").alias("t"),
    )
    return part.select(
        F.col("gene_id").alias("feature"), F.when(F.col("t") > 0, F.col("s") + F.col("t")).otherwise(F.lit(0.0)).alias("score")
    )


def mutual_information_scores(
    expr: DataFrame, samples: DataFrame, label: str, bins: int = 10
) -> DataFrame:
    """Mutual information of the value, cut into equal-width bins per gene, and the class."""
    d = stats.labelled(expr, samples, label)
    span = d.groupBy("gene_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    where = F.when(
        F.col("hi") > F.col("lo"),
        F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)),
    ).otherwise(F.lit(0))
    joint = d.join(span, "gene_id").groupBy("gene_id", where.alias("bin"), "grp").agg(
        F.count(F.lit(1)).cast("double").alias("nxy")
    )
    nx = joint.groupBy("gene_id", "bin").agg(F.sum("nxy").alias("nx"))
    ny = joint.groupBy("gene_id", "grp").agg(F.sum("nxy").alias("ny"))
    n = joint.groupBy("gene_id").agg(F.sum("nxy").alias("n"))
    j = joint.join(nx, ["gene_id", "bin"]).join(ny, ["gene_id", "grp"]).join(n, "gene_id")
    term = F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return j.groupBy(F.col("gene_id").alias("feature")).agg(
        F.greatest(F.lit(0.0), F.sum(term)).alias("score")
    )


def _digamma(n) -> F.Column:
    """Digamma of whole numbers from 1 on, by its series from n + 6."""
    x = n.cast("double") + 6
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return series - sum((1 / (n + i) for i in range(6)), F.lit(0.0))


def neighbour_information_scores(expr: DataFrame, samples: DataFrame, label: str, neighbours: int = 3) -> DataFrame:
    """Mutual information of the value and the class from distances to nearest neighbours (Ross 2014).

    For each sample: the distance to its k-th neighbour of the same class, and the number of samples of any class
    nearer than that (itself included; equal values if the distance is 0). Neighbours of a value in sorted order are
    the rows next to it, and numbers within a distance are differences of running counts, so every step is a sort
    within a gene. Samples alone in their class are left out.
    """
    d = stats.labelled(expr, samples, label)
    own = Window.partitionBy("gene_id", "grp")
    d = d.withColumn("n_c", F.count(F.lit(1)).over(own)).filter("n_c > 1")
    d = d.withColumn("k", F.least(F.lit(neighbours).cast("long"), F.col("n_c") - 1))
    by_value = own.orderBy("value", "sample_id")
    left = [F.lit(0.0)] + [F.col("value") - F.lag("value", j).over(by_value) for j in range(1, neighbours + 1)]
    right = [F.lit(0.0)] + [F.lead("value", j).over(by_value) - F.col("value") for j in range(1, neighbours + 1)]
    d = d.select("*", F.array(*left).alias("_l"), F.array(*right).alias("_r"))

    def at(k: int):
        # j neighbours on the left and k - j on the right, where there are so many
        pairs = [
            F.when(F.col("_l")[j].isNotNull() & F.col("_r")[k - j].isNotNull(), F.greatest(F.col("_l")[j], F.col("_r")[k - j]))
            for j in range(k + 1)
        ]
        return F.array_min(F.array(*pairs))

    radius = None
    for k in range(1, neighbours + 1):
        radius = F.when(F.col("k") == k, at(k)) if radius is None else radius.when(F.col("k") == k, at(k))
    d = d.withColumn("_d", radius)
    tied = F.col("_d") == 0
    # points (kind 1) between the bounds that do not count equal values (0 above, 2 below), or do if they are tied
    events = d.select(
        "gene_id", "sample_id", "k", "n_c",
        F.explode(
            F.array(
                F.struct(F.col("value").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("side")),
                F.struct((F.col("value") + F.col("_d")).alias("at"), F.when(tied, 2).otherwise(0).alias("kind"), F.lit(1).alias("side")),
                F.struct((F.col("value") - F.col("_d")).alias("at"), F.when(tied, 0).otherwise(2).alias("kind"), F.lit(-1).alias("side")),
            )
        ).alias("e"),
    ).select("gene_id", "sample_id", "k", "n_c", "e.*")
    order = Window.partitionBy("gene_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = events.withColumn("_c", F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).over(order)).filter("side <> 0")
    near = counted.groupBy("gene_id", "sample_id", "k", "n_c").agg(F.sum(F.col("_c") * F.col("side")).alias("m"))
    mean = lambda c: F.avg(_digamma(F.col(c)))
    score = _digamma(F.count(F.lit(1))) + mean("k") - mean("n_c") - mean("m")
    return near.groupBy(F.col("gene_id").alias("feature")).agg(F.greatest(F.lit(0.0), score).alias("score"))


FILTERS: dict[str, Callable] = {
    "variance": variance_scores,
    "f_test": f_scores,
    "mutual_info": mutual_information_scores,
    "mutual_info_knn": neighbour_information_scores,
    "correlation": correlation_scores,
    "anova": f_scores,
    "chi2": chi2_scores,
}


def top_scores(scores: DataFrame, n: int) -> DataFrame:
    """The n best features with their rank; ties by name."""
    best = scores.orderBy(F.col("score").desc(), "feature").limit(n)
    return ordinal_ranks(best, [], "score", "feature", "rank", descending=True, small=True)


def filter_scores(expr, samples, label, methods=("variance", "f_test", "mutual_info", "correlation")) -> DataFrame:
    """All scores of all methods: method, feature, score."""
    unknown = [m for m in methods if m not in FILTERS]
    if unknown:
        raise ValueError(f"unknown filter methods {unknown}; use {sorted(FILTERS)}")
    return tagged({m: FILTERS[m](expr, samples, label) for m in methods})


def filter_select(expr, samples, label, methods=("variance", "f_test", "mutual_info", "correlation"), n: int = 50) -> DataFrame:
    """The n best features of each method."""
    return top_per_method(filter_scores(expr, samples, label, methods), n)


def variance_threshold(expr: DataFrame, n: int, strict: bool = False) -> DataFrame:
    """Top n by sample variance; `strict` keeps population variances above the n-th sample variance."""
    scores = expr.groupBy(F.col("gene_id").alias("feature")).agg(
        F.var_samp("value").alias("score"), F.var_pop("value").alias("pop")
    )
    if not strict:
        return top_scores(scores.drop("pop"), n)
    cut = scores.orderBy(F.col("score").desc()).limit(n).agg(F.min("score").alias("c")).scalar()
    return scores.filter(F.col("pop") > cut).select("feature", F.col("pop").alias("score"))


# ---- feature matrix and model-based scores -----------------------------------------------------


def feature_matrix(
    expr: DataFrame, samples: DataFrame, label: str, features: DataFrame
) -> tuple[DataFrame, list[str]]:
    """sample_id, label, features VECTOR for a bounded set of features; absent cells are 0."""
    names = [
        r[0]
        for r in features.select("feature").distinct().orderBy("feature").limit(MAX_MODEL_FEATURES + 1).collect()
    ]
    if len(names) > MAX_MODEL_FEATURES:
        raise ValueError(f"select at most {MAX_MODEL_FEATURES} features before fitting a model")
    spark = expr.sparkSession
    table = spark.createDataFrame(list(enumerate(names)), "i int, gene_id string")  # size checked above
    # cells of other genes go before anything is shuffled
    cells = expr.join(F.broadcast(table), "gene_id").groupBy("sample_id").agg(
        F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("m")
    )
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))
    )
    side = samples.filter(F.col(label).isNotNull()).select("sample_id", F.col(label).cast("double").alias("label"))
    return (
        cells.join(side, "sample_id").select("sample_id", "label", array_to_vector(dense).alias("features")),
        names,
    )


def _importance(spark, names: Sequence[str], values) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "feature string, score double")


def _coefficients(model):
    if hasattr(model, "coefficientMatrix"):
        m = abs(model.coefficientMatrix.toArray())
        return m.max(axis=0)
    return abs(model.coefficients.toArray())


def model_scores(
    data: DataFrame, names: Sequence[str], method: str, task: str = "classification", seed: int = 42, **o
) -> DataFrame:
    """Importance per feature: |coefficient| of linear models, impurity gain of trees."""
    reg = task == "regression"
    common = {"featuresCol": "features", "labelCol": "label"}
    if "weightCol" in o:
        common["weightCol"] = o["weightCol"]
    n_iter = o.get("max_iter", 50)
    if method in ("lasso", "elastic_net"):
        mix = 1.0 if method == "lasso" else o.get("l1_ratio", 0.5)
        est = (LinearRegression if reg else LogisticRegression)(
            regParam=o.get("alpha", 0.01), elasticNetParam=mix, maxIter=n_iter, **common
        )
    elif method == "logistic":
        est = LogisticRegression(regParam=o.get("alpha", 0.01), maxIter=n_iter, **common)
    elif method == "linear":
        est = LinearRegression(regParam=o.get("alpha", 0.01), maxIter=n_iter, **common)
    elif method == "svm":
        est = LinearSVC(regParam=o.get("alpha", 0.01), maxIter=n_iter, **common)
    elif method == "random_forest":
        est = (RandomForestRegressor if reg else RandomForestClassifier)(
            numTrees=o.get("trees", 100), maxDepth=o.get("depth", 5), seed=seed, **common
        )
    elif method in ("xgboost", "gbt"):
        est = (GBTRegressor if reg else GBTClassifier)(
            maxIter=o.get("rounds", 20), maxDepth=o.get("depth", 3), seed=seed, **common
        )
    else:
        raise ValueError(f"unknown model method {method}")
    model = est.fit(data)
    tree = hasattr(model, "featureImportances")
    values = model.featureImportances.toArray() if tree else _coefficients(model)
    return _importance(data.sparkSession, names, values)


def embedded_select(data, names, method: str, n: int | None = None, **o) -> DataFrame:
    """Non-zero coefficients of linear models; trees keep importances above the mean."""
    scores = model_scores(data, names, method, **o)
    if method in ("random_forest", "xgboost", "gbt"):
        cut = scores.agg(F.avg("score").alias("m")).scalar()
        kept = scores.filter(F.col("score") > cut)
    else:
        kept = scores.filter(F.abs("score") > 1e-10)
    return top_scores(kept, n or len(names))


def restrict(data: DataFrame, names: Sequence[str], keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A feature matrix with only some of its columns."""
    from pyspark.ml.feature import VectorSlicer

    keep = list(keep)
    at = {f: i for i, f in enumerate(names)}
    out = VectorSlicer(inputCol="features", outputCol="_f", indices=[at[f] for f in keep]).transform(data)
    return out.drop("features").withColumnRenamed("_f", "features"), keep


def rfe(data, names, n: int, method: str = "logistic", step: float = 0.1, **o) -> DataFrame:
    """Drop the weakest features round by round until n are left."""
    data = data.persist()
    current, frame = list(names), data
    while True:
        rows = model_scores(frame, current, method, **o).collect()
        ranked = sorted(rows, key=lambda r: (-r["score"], r["feature"]))
        if len(current) <= n:
            break
        drop = max(1, int(step * len(names)) if step < 1 else int(step))
        current = [r["feature"] for r in ranked[: max(n, len(current) - drop)]]
        frame, current = restrict(data, names, current)
    data.unpersist()
    out = _importance(data.sparkSession, [r["feature"] for r in ranked], [r["score"] for r in ranked])
    return top_scores(out, n)


def sequential(data, names, n: int, direction: str = "forward", folds: int = 3, max_iter: int = 20) -> DataFrame:
    """Greedy search by cross-validated accuracy; every candidate is tried in each round."""
    from genemill.operators.models import cv_accuracy

    data = data.persist()
    chosen = [] if direction == "forward" else list(names)
    trail = []
    while len(chosen) != n:
        if direction == "forward":
            options = [(f, [*chosen, f]) for f in names if f not in chosen]
        else:
            options = [(f, [c for c in chosen if c != f]) for f in chosen]
        scored = []
        for f, subset in options:
            frame, _ = restrict(data, names, subset)
            scored.append((cv_accuracy(frame, folds, max_iter), f, subset))
        best = max(scored, key=lambda s: (s[0], s[1]))
        chosen = best[2]
        trail.append((best[1], float(best[0]), len(trail) + 1))
    data.unpersist()
    spark = data.sparkSession
    if direction == "forward":
        return spark.createDataFrame(trail, "feature string, score double, rank int")
    last = trail[-1][1] if trail else None
    rows = [(f, last, i + 1) for i, f in enumerate(sorted(chosen))]
    return spark.createDataFrame(rows, "feature string, score double, rank int")


def poisson_weight(key, seed) -> F.Column:
    """Bootstrap count of a row: Poisson(1) from a hash of its key and the replicate.

    The inverse distribution goes to 18, beyond which lies less than the hash can tell (2^-53).
    """
    u = F.pmod(F.xxhash64(key, seed), F.lit(1 << 53)) / float(1 << 53)
    out, term, total = None, 0.36787944117144233, 0.0
    for k in range(18):
        total += term
        out = F.when(u < total, float(k)) if out is None else out.when(u < total, float(k))
        term /= k + 1
    return out.otherwise(18.0)


def salted_hashes(hashed: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """`F.xxhash64(row, seed)` as unsigned numbers, rows by seeds, from the rows' own hashes and seeds of type int."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    word = (seeds.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64) * p1
    h = (hashed.astype(np.int64).view(np.uint64) + p5 + np.uint64(4))[:, None] ^ word[None, :]
    other = h >> np.uint64(41)
    h <<= np.uint64(23)
    h |= other
    h *= p2
    h += p3
    for shift, factor in ((33, p2), (29, p3), (32, np.uint64(1))):
        np.right_shift(h, np.uint64(shift), out=other)
        h ^= other
        h *= factor
    return h


def poisson_weights(hashed: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """`poisson_weight` of rows by seeds, from the rows' hashed keys (`F.xxhash64`) and seeds of type int."""
    u = (salted_hashes(hashed, seeds) & np.uint64((1 << 53) - 1)).astype(np.float64) * 2.0**-53
    return np.searchsorted(_WEIGHT_STEPS, u, side="right").astype(np.float64)


def _weight_steps() -> list[float]:
    out, term, total = [], 0.36787944117144233, 0.0
    for k in range(18):
        total += term
        out.append(total)
        term /= k + 1
    return out


_WEIGHT_STEPS = np.array(_weight_steps())


# Replicates are fitted together up to this number of features; their moments take this many bytes in a task.
MOMENT_FEATURES = 2_048
MOMENT_BYTES = 1 << 26
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def draws(keys: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """Bootstrap counts, replicates x rows: Poisson(1) from a 64-bit key of the row and the replicate."""
    z = keys.astype(np.uint64)[None, :] + (replicates.astype(np.uint64) + np.uint64(1))[:, None] * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return np.searchsorted(_POISSON, u, side="right").astype(np.float64)


def _summed(rows: DataFrame, task, keys: str, total: list[str]) -> DataFrame:
    """Sums over all partitions of the vectors that `task` adds up in each: the keys, and `v`."""
    parts = rows.mapInPandas(task, f"{keys}, v array<double>").withColumn("v", array_to_vector("v"))
    return parts.groupBy(*total).agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("v"))


def _batches(frames):
    for f in frames:
        if len(f):
            yield np.stack(f["x"].to_numpy()).astype(np.float64), f["y"].to_numpy(np.float64), f["k"].to_numpy(np.int64)


def bootstrap_lasso(
    data: DataFrame, replicates: Sequence[int], alpha: float = 0.01, passes: int = 30, tolerance: float = 1e-6, seed: int = 42
) -> list[tuple[int, np.ndarray, bool]]:
    """L1 logistic fits of bootstrap replicates, all in the same passes: (replicate, coefficients, converged).

    `data` holds sample_id, label (0 or 1) and features. Draws are within class: each class keeps its size.
    A replicate without one of the classes is left out. Features are standardised within a replicate and the
    mean loss has the penalty alpha * sum |coefficient|. A pass adds up, for every replicate, the weighted
    cross products of the features and the working response; soft-thresholded coordinate descent on them
    gives the next coefficients. What goes between tasks and to the driver depends on the number of
    features and replicates only.
    """
    rows = data.select(
        F.xxhash64("sample_id", F.lit(seed)).alias("k"), F.col("label").cast("double").alias("y"),
        vector_to_array("features").alias("x"),
    )
    reps = np.array(list(replicates), dtype=np.int64)

    def moments(frames):
        acc = 0.0
        for x, y, k in _batches(frames):
            w = draws(k, reps)
            a = np.hstack([np.ones((len(x), 1)), x, x * x])
            acc = acc + np.stack([(w * (y == 0)) @ a, (w * (y == 1)) @ a], axis=1)
        if not np.isscalar(acc):
            yield pd.DataFrame({
                "b": np.repeat(reps, 2), "c": np.tile([0, 1], len(reps)), "v": list(acc.reshape(2 * len(reps), -1)),
            })

    sums = {(r.b, r.c): np.array(r.v) for r in _summed(rows, moments, "b bigint, c int", ["b", "c"]).collect()}
    sizes = {r.label: r["count"] for r in data.groupBy("label").count().collect()}
    scale, place = {}, {}
    for b in map(int, reps):
        got = [sums.get((b, c)) for c in (0, 1)]
        if any(g is None or g[0] == 0 for g in got):
            continue
        f = [sizes[c] / g[0] for c, g in enumerate(got)]
        m = f[0] * got[0] + f[1] * got[1]
        p = (len(m) - 1) // 2
        mean = m[1 : p + 1] / m[0]
        spread = m[p + 1 :] / m[0] - mean**2
        sd = np.sqrt(np.where(spread > 1e-12 * np.maximum(1.0, mean**2), spread, 0.0))
        scale[b], place[b] = f, (mean, sd)
    if not scale:
        return []
    n = float(sum(sizes.values()))
    p = len(next(iter(place.values()))[0])
    live = {b: np.zeros(p + 1) for b in scale}
    done = {}
    last = {b: math.inf for b in scale}
    for _ in range(passes):
        now = {b: v.copy() for b, v in live.items()}

        def products(frames, now=now):
            acc = {b: np.zeros((p + 2, p + 2)) for b in now}
            for x, y, k in _batches(frames):
                w = draws(k, np.array(sorted(now), dtype=np.int64))
                for b, wb in zip(sorted(now), w):
                    mean, sd = place[b]
                    xs = np.divide(x - mean, sd, out=np.zeros_like(x), where=sd > 0)
                    eta = now[b][0] + xs @ now[b][1:]
                    mu = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
                    v = np.maximum(mu * (1 - mu), 1e-5)
                    a = np.hstack([np.ones((len(x), 1)), xs, (eta + (y - mu) / v)[:, None]])
                    acc[b] += (a * (wb * np.where(y == 1, scale[b][1], scale[b][0]) * v)[:, None]).T @ a
            for b, m in acc.items():
                yield pd.DataFrame({"b": b, "i": np.arange(p + 2), "v": list(m)})

        def solve(f):
            b = int(f["b"].iloc[0])
            m = np.stack(f.sort_values("i")["v"].to_numpy()) / n
            return pd.DataFrame({"b": [b], "beta": [_descend(m, now[b], alpha)]})

        total = _summed(rows, products, "b bigint, i int", ["b", "i"])
        for r in total.groupBy("b").applyInPandas(solve, "b bigint, beta array<double>").collect():
            new = np.array(r.beta)
            step = float(np.max(np.abs(new - now[r.b])))
            live[r.b] = new if step < last[r.b] else (new + now[r.b]) / 2
            last[r.b] = step
            if step < tolerance:
                done[r.b] = live.pop(r.b)
        if not live:
            break
    out = [(b, v, True) for b, v in done.items()] + [(b, v, False) for b, v in live.items()]
    return [(b, np.divide(v[1:], place[b][1], out=np.zeros(p), where=place[b][1] > 0), ok) for b, v, ok in sorted(out, key=lambda t: t[0])]


def _descend(m: np.ndarray, start: np.ndarray, alpha: float) -> np.ndarray:
    """Lasso by coordinate descent from the cross products of (1, features, response); the intercept is free."""
    q, r = m[:-1, :-1], m[:-1, -1]
    beta = start.copy()
    grad = r - q @ beta
    for _ in range(10_000):
        most = 0.0
        for j in range(len(beta)):
            if q[j, j] <= 0:
                continue
            z = grad[j] + q[j, j] * beta[j]
            new = (z if j == 0 else math.copysign(max(abs(z) - alpha, 0.0), z)) / q[j, j]
            if new != beta[j]:
                grad -= q[:, j] * (new - beta[j])
                most = max(most, abs(new - beta[j]))
                beta[j] = new
        if most < 1e-10:
            break
    return beta


def stability_selection(
    data, names, n_bootstrap: int = 100, threshold: float = 0.5, method: str = "lasso", seed: int = 42, **o
) -> DataFrame:
    """Share of bootstrap fits that keep each feature: feature, score, selected, n_fits, n_converged.

    The L1 logistic fits of two classes go through `bootstrap_lasso`, as many replicates at once as their
    moments allow. Other methods, labels and more than MOMENT_FEATURES features are fitted one by one.
    """
    data = data.persist()
    odd = data.filter(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).limit(1).count()
    if method == "lasso" and not odd and len(names) <= MOMENT_FEATURES and set(o) <= {"alpha"}:
        block = max(1, MOMENT_BYTES // (8 * (len(names) + 2) ** 2))
        fits = []
        for at in range(0, n_bootstrap, block):
            fits += bootstrap_lasso(data, range(at, min(at + block, n_bootstrap)), seed=seed, **o)
        data.unpersist()
        kept = np.array([np.abs(v) > 1e-10 for _, v, _ in fits]).reshape(len(fits), len(names))
        share = kept.mean(axis=0) if fits else [None] * len(names)
        rows = [(f, None if v is None else float(v)) for f, v in zip(names, share)]
        out = data.sparkSession.createDataFrame(rows, "feature string, score double")
        return out.select(
            "*", (F.col("score") >= threshold).alias("selected"), F.lit(len(fits)).alias("n_fits"),
            F.lit(sum(ok for _, _, ok in fits)).alias("n_converged"),
        )
    parts = None
    for b in range(n_bootstrap):
        w = data.withColumn("w", poisson_weight(F.col("sample_id"), F.lit(seed * 1000 + b))).filter("w > 0")
        got = model_scores(w, names, method, weightCol="w", **o).select(
            "feature", F.when(F.col("score") > 1e-10, 1.0).otherwise(0.0).alias("hit")
        )
        parts = got if parts is None else parts.unionByName(got)
    data.unpersist()
    return (
        parts.groupBy("feature")
        .agg(F.avg("hit").alias("score"))
        .select(
            "*", (F.col("score") >= threshold).alias("selected"), F.lit(n_bootstrap).alias("n_fits"),
            F.lit(None).cast("int").alias("n_converged"),
        )
    )


# ---- voting and consensus ----------------------------------------------------------------------


def top_per_method(scores: DataFrame, n: int) -> DataFrame:
    """First n features of each method, with rank."""
    return top_per_key(scores, ["method"], "score", "feature", n)


def ensemble_vote(selections: DataFrame, voting_threshold: float = 0.5) -> DataFrame:
    """Features with at least int(threshold * methods) votes."""
    total = selections.agg(F.count_distinct("method").alias("m")).scalar()
    votes = selections.groupBy("feature").agg(F.count_distinct("method").alias("votes"))
    return votes.filter(F.col("votes") >= F.greatest(F.lit(1), F.floor(total * voting_threshold)))


def consensus(selections: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Share of method lists that hold each feature, with the lists; rows below the threshold go."""
    total = selections.agg(F.count_distinct("method").alias("m")).scalar()
    votes = selections.groupBy("feature").agg(
        F.count_distinct("method").alias("selection_count"),
        F.concat_ws(",", F.array_sort(F.collect_set("method"))).alias("methods"),
    )
    return votes.withColumn("consensus_score", F.col("selection_count") / total).filter(
        F.col("consensus_score") >= threshold
    )


def normalized_consensus(scores: DataFrame) -> DataFrame:
    """Mean over methods of score / best score of the method."""
    best = scores.groupBy("method").agg(F.max("score").alias("_max"))
    return scores.join(best, "method").groupBy("feature").agg(
        F.avg(F.when(F.col("_max") != 0, F.col("score") / F.col("_max"))).alias("consensus_score")
    )


def top_k_stability(scores: DataFrame, n: int) -> DataFrame:
    """Share of the methods that score a feature in whose first n it is."""
    top = top_per_method(scores, n).groupBy("feature").agg(F.count(F.lit(1)).alias("_hits"))
    seen = scores.groupBy("feature").agg(F.count(F.lit(1)).alias("_seen"))
    share = F.coalesce(F.col("_hits"), F.lit(0)) / F.col("_seen")
    return seen.join(top, "feature", "left").select("feature", share.alias("stability"))


def final_selection(scores: DataFrame, n: int = 50, stability: float = 0.6) -> DataFrame:
    """Best n by normalised consensus among features stable over the methods."""
    scores = reuse(scores)
    j = normalized_consensus(scores).join(top_k_stability(scores, n), "feature")
    return j.filter(F.col("stability") >= stability).orderBy(F.col("consensus_score").desc(), "feature").limit(n)


def bootstrap_consensus(
    expr: DataFrame,
    samples: DataFrame,
    label: str,
    n_bootstrap: int = 100,
    n: int = 50,
    frequency: float = 0.6,
    seed: int = 42,
) -> DataFrame:
    """Correlation scores on hash bootstraps, all replicates in one pass over the cells.

    A replicate is a weight per sample. Cells are laid out by gene, a long gene over several tasks; a task adds
    up six weighted sums per replicate and sends one row for each gene it meets.
    """
    d = stats.labelled(expr, samples, label).filter(F.col("value").isNotNull() & F.col("grp").isNotNull())
    cells = d.select(
        "gene_id", F.xxhash64("sample_id", F.lit(seed)).alias("k"), F.col("value").alias("x"), F.col("grp").cast("double").alias("y")
    )
    reps = np.arange(n_bootstrap)

    def moments(frames):
        gene, acc = None, None
        for f in frames:
            if not len(f):
                continue
            x, y = f["x"].to_numpy(np.float64), f["y"].to_numpy(np.float64)
            terms = np.stack([np.ones(len(f)), x, y, x * x, y * y, x * y], axis=1)
            w = draws(f["k"].to_numpy(np.int64), reps)
            ids = f["gene_id"].to_numpy()
            cuts = np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = w[:, lo:hi] @ terms[lo:hi]
                if acc is not None and ids[lo] == gene:
                    acc = acc + part
                    continue
                if acc is not None:
                    yield pd.DataFrame({"gene_id": [gene], "v": [acc.ravel()]})
                gene, acc = ids[lo], part
        if acc is not None:
            yield pd.DataFrame({"gene_id": [gene], "v": [acc.ravel()]})

    laid = cells.repartitionByRange("gene_id", "k").sortWithinPartitions("gene_id", "k")
    kind = cells.schema["gene_id"].dataType.simpleString()
    sums = _summed(laid, moments, f"gene_id {kind}", ["gene_id"])
    names = ("w", "x", "y", "xx", "yy", "xy")
    each = F.transform(
        F.sequence(F.lit(0), F.lit(n_bootstrap - 1)),
        lambda b: F.struct(b.alias("b"), *[F.get("v", b * 6 + i).alias(c) for i, c in enumerate(names)]),
    )
    frames = sums.select("gene_id", F.explode(each).alias("s"))
    s = lambda c: F.col(f"s.{c}")
    vx = s("w") * s("xx") - s("x") * s("x")
    vy = s("w") * s("yy") - s("y") * s("y")
    r = F.when((vx > 0) & (vy > 0), F.abs((s("w") * s("xy") - s("x") * s("y")) / F.sqrt(vx * vy))).otherwise(0.0)
    scored = frames.select(F.col("s.b").alias("method"), F.col("gene_id").alias("feature"), r.alias("score"))
    best = scored.groupBy("method").agg(F.max("score").alias("_max"))
    ranked = ordinal_ranks(scored.join(best, "method"), ["method"], "score", "feature", "rank", descending=True)
    out = ranked.groupBy("feature").agg(
        F.avg(F.when(F.col("rank") <= n, 1.0).otherwise(0.0)).alias("frequency"),
        F.avg(F.when(F.col("_max") > 0, F.col("score") / F.col("_max"))).alias("consensus_score"),
    )
    return out.filter(F.col("frequency") >= frequency).orderBy(F.col("consensus_score").desc(), "feature").limit(n)


def selection_summary(selections: DataFrame, categories: dict[str, str]) -> DataFrame:
    """Methods, selections and distinct features per category of methods."""
    from genemill.functions.columns import lookup

    return (
        selections.withColumn("category", lookup("method", categories, "other"))
        .groupBy("category")
        .agg(
            F.count_distinct("method").alias("n_methods"),
            F.count(F.lit(1)).alias("n_selections"),
            F.count_distinct("feature").alias("n_features"),
        )
    )


def overlap_stability(baseline: DataFrame, runs: DataFrame, n_features: int) -> DataFrame:
    """Per run: share of the baseline selection found again, and what chance would give."""
    size = baseline.agg(F.count_distinct("feature").alias("s")).scalar()
    hits = runs.join(baseline.select("feature").distinct().withColumn("_hit", F.lit(1)), "feature", "left")
    return hits.groupBy("run").agg(
        (F.count("_hit") / size).alias("overlap"), (F.count(F.lit(1)) / n_features).alias("chance")
    )


def overlap_t_test(overlaps: DataFrame) -> DataFrame:
    """One-sample t of the overlaps against the mean chance overlap."""
    from genemill.functions.special import t_sf2

    m = overlaps.agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("overlap").alias("mean_overlap"),
        F.stddev_samp("overlap").alias("std_overlap"),
        F.avg("chance").alias("chance"),
    )
    t = (F.col("mean_overlap") - F.col("chance")) / (F.col("std_overlap") / F.sqrt("runs"))
    return (
        m.withColumn("statistic", F.when(F.col("std_overlap") > 0, t))
        .withColumn("_df", (F.col("runs") - 1).cast("double"))
        .withColumn("p_value", t_sf2("statistic", "_df"))
        .drop("_df")
    )
