"""Survival curves, log-rank tests, Cox models and concordance.

Everything is built from counts per distinct time: subjects are collapsed to
(group, time) before any ordered pass, so tied times cost one row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genemill.functions.special import chi2_sf, chi2_upper, norm_sf2, normal_upper
from genemill.operators.distributed import fits, median_by, ordered_scan, reuse, value_buckets
from genemill.session import ensure_checkpoint_dir


def clean(df: DataFrame, time: str = "time", event: str = "event") -> DataFrame:
    """Numeric time and integer event; rows without either, or with time <= 0, are dropped."""
    out = df.withColumn(time, F.expr(f"try_cast(`{time}` AS double)")).withColumn(
        event, F.expr(f"try_cast(try_cast(`{event}` AS double) AS int)")
    )
    return out.filter(F.col(time).isNotNull() & F.col(event).isNotNull() & (F.col(time) > 0))


def prepare(df: DataFrame, covariates: Sequence[str], time: str = "time", event: str = "event") -> DataFrame:
    """Complete rows only, covariates centred and scaled by the population deviation."""
    d = df.dropna(subset=[time, event, *covariates])
    stats = d.agg(
        *[F.avg(c).alias(f"m_{c}") for c in covariates],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in covariates],
    )
    for c in covariates:
        m, s = stats.select(f"m_{c}").scalar(), stats.select(f"s_{c}").scalar()
        d = d.withColumn(c, (F.col(c) - m) / F.when(s > 0, s).otherwise(F.lit(1.0)))
    return d


def with_gene_values(survival: DataFrame, expr: DataFrame) -> DataFrame:
    """Inner join of subjects with expression: one row per subject and gene."""
    return survival.join(expr, "sample_id")


def median_split(df: DataFrame, col: str, out: str = "grp") -> DataFrame:
    """Two groups by the median of a column: low (<=) and high (>)."""
    med = median_by(df, [], col, "m").scalar()
    return df.filter(F.col(col).isNotNull()).withColumn(
        out, F.when(F.col(col) <= med, "low").otherwise("high")
    )


def life_table(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct time: events d, rows c and number at risk n."""
    t = reuse(
        df.groupBy(*keys, "time").agg(
            F.sum("event").cast("long").alias("d"), F.count(F.lit(1)).alias("c")
        )
    )
    return ordered_scan(t, keys, "time", {"n": ("sum", "c", "desc")})


def kaplan_meier(df: DataFrame, group: str = "grp", min_group: int = 5) -> DataFrame:
    """Product-limit curve per group: time, n at risk, events, survival."""
    big = df.groupBy(group).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= min_group)
    t = reuse(life_table(df.join(big, group, "left_semi"), [group]))
    alive = F.col("d") < F.col("n")
    t = t.withColumn("_l", F.when(alive, F.log1p(-F.col("d") / F.col("n"))).otherwise(F.lit(0.0)))
    t = t.withColumn("_z", F.when(alive, 0).otherwise(1))
    t = ordered_scan(t, [group], "time", {"_ll": ("sum", "_l", "asc"), "_zz": ("sum", "_z", "asc")})
    s = F.when(F.col("_zz") > 0, F.lit(0.0)).otherwise(F.exp("_ll"))
    return t.select(
        group, "time", F.col("n").alias("at_risk"), F.col("d").alias("events"), s.alias("survival")
    )


def survival_summary(df: DataFrame, group: str = "grp", at: Sequence[float] = (365.0, 1825.0)) -> DataFrame:
    """Per group: subjects, events, median survival and survival at fixed times (by time)."""
    df = reuse(df)
    km = kaplan_meier(df, group)
    aggs = [F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median_survival")]
    for t in at:
        hit = F.col("time") <= t
        last = F.max_by(F.when(hit, F.col("survival")), F.when(hit, F.col("time")))
        aggs.append(F.coalesce(last, F.lit(1.0)).alias(f"survival_at_{int(t)}"))
    sizes = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.sum("event").cast("long").alias("events")
    )
    return km.groupBy(group).agg(*aggs).join(sizes, group)


def logrank(df: DataFrame, group: str = "grp", max_groups: int = 100) -> DataFrame:
    """k-group log-rank test, one row: statistic, df, p_value, n_groups."""
    levels = [r[0] for r in df.select(group).distinct().orderBy(group).limit(max_groups + 1).collect()]
    k = len(levels)
    if not 2 <= k <= max_groups:
        raise ValueError(f"log-rank needs 2 to {max_groups} groups")
    ones = [F.when(F.col(group) == F.lit(v), 1).otherwise(0) for v in levels]
    t = df.groupBy("time").agg(
        F.sum("event").cast("double").alias("d"),
        F.count(F.lit(1)).cast("double").alias("c"),
        *[F.sum(o).cast("double").alias(f"c{i}") for i, o in enumerate(ones)],
        *[F.sum(o * F.col("event")).cast("double").alias(f"d{i}") for i, o in enumerate(ones)],
    )
    specs = {"n": ("sum", "c", "desc")}
    specs.update({f"n{i}": ("sum", f"c{i}", "desc") for i in range(k)})
    t = ordered_scan(t, [], "time", specs).filter(F.col("d") > 0)
    n, d = F.col("n"), F.col("d")
    spread = F.when(n > 1, d * (n - d) / (n - 1)).otherwise(F.lit(0.0))
    aggs = [F.sum(F.col(f"d{i}") - F.col(f"n{i}") * d / n) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for i, j in pairs:
        a, b = F.col(f"n{i}") / n, F.col(f"n{j}") / n
        aggs.append(F.sum(spread * (a * (1 - b) if i == j else -a * b)))
    row = t.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
    gap = np.array([row[i] or 0.0 for i in range(k)])
    cov = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[k:]):
        cov[i, j] = cov[j, i] = v or 0.0
    stat = float(gap[1:] @ np.linalg.pinv(cov[1:, 1:]) @ gap[1:])
    p = float(chi2_upper(np.array([max(stat, 0.0)]), float(k - 1))[0])
    return df.sparkSession.createDataFrame(
        [(stat, k - 1, p, k)], "statistic double, df int, p_value double, n_groups int"
    )


# ---- Cox ------------------------------------------------------------------------------------


TIES_ADDED = 16  # tied events whose terms are added one by one; sums over more have a closed form


def _tie_sums(d, extra):
    """Sums over x = v, v + 1, ..., v + d - 1 of log x, 1 / x and 1 / x^2, for v = 1 + extra.

    The `TIES_ADDED` smallest terms are added one by one. The others are differences of log-gamma, digamma and trigamma,
    written by their series so that nothing cancels; from 17 on the series are exact to about 1e-13.
    """
    v = 1.0 + extra
    m = F.least(d, F.lit(TIES_ADDED))
    steps = F.sequence(F.lit(0), m.cast("int") - 1)

    def add(term):
        return F.aggregate(steps, F.lit(0.0), lambda a, j: a + term(v + j))

    added = [add(F.log), add(lambda x: 1.0 / x), add(lambda x: 1.0 / (x * x))]
    k, w = (d - m).cast("double"), v + m
    u = w + k
    gap = lambda n: 1.0 / F.pow(w, F.lit(float(n))) - 1.0 / F.pow(u, F.lit(float(n)))
    wide = F.log1p(k / w)
    closed = (
        k * F.log(w) + (u - 0.5) * wide - k - gap(1) / 12 + gap(3) / 360 - gap(5) / 1260,
        wide + k / (2.0 * u * w) + gap(2) / 12 - gap(4) / 120 + gap(6) / 252,
        k / (u * w) + k * (u + w) / (2.0 * u * u * w * w) + gap(3) / 6 - gap(5) / 30 + gap(7) / 42,
    )
    return [x + F.when(k > 0, y).otherwise(0.0) for x, y in zip(added, closed)]


def _score(data: DataFrame, keys: Sequence[str], eta, x: Sequence[str], small: bool) -> DataFrame:
    """Partial log-likelihood, gradient and information per key, in one ordered pass."""
    p = len(x)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    d = data.withColumn("_eta", eta).withColumn("_w", F.exp("_eta"))
    moments = {"s0": F.col("_w")}
    moments.update({f"s1_{i}": F.col("_w") * F.col(x[i]) for i in range(p)})
    moments.update({f"s2_{i}_{j}": F.col("_w") * F.col(x[i]) * F.col(x[j]) for i, j in pairs})
    ev = F.col("event") == 1
    aggs = [F.sum(m).alias(f"r_{n}") for n, m in moments.items()]
    aggs += [F.sum(F.when(ev, m).otherwise(0.0)).alias(f"e_{n}") for n, m in moments.items()]
    aggs += [
        F.sum("event").cast("long").alias("d"),
        F.sum(F.when(ev, F.col("_eta")).otherwise(0.0)).alias("_le"),
        *[F.sum(F.when(ev, F.col(c)).otherwise(0.0)).alias(f"_x{i}") for i, c in enumerate(x)],
    ]
    t = d.groupBy(*keys, "time").agg(*aggs)
    t = ordered_scan(t, keys, "time", {n: ("sum", f"r_{n}", "desc") for n in moments}, small)
    t = t.filter(F.col("d") > 0)

    # with z(f) = risk sum - f * event sum at f = 0, 1/d, ..., the terms of Efron's correction are (e0 / d) * (v, v + 1, ...)
    d, e0 = F.col("d"), F.col("e_s0")
    extra = F.greatest(F.lit(0.0), F.col("s0") - e0) * d / e0
    logs, ones, squares = _tie_sums(d, extra)
    t = t.withColumns(
        {"_logs": d * F.log(e0 / d) + logs, "_r1": ones * d / e0, "_r2": squares * (d / e0) * (d / e0)}
    )

    def split(name):
        """z of a moment as a constant and a multiple of z of the weights."""
        return F.col(name) - F.col(f"e_{name}") * F.col("s0") / e0, F.col(f"e_{name}") / e0

    out = [F.sum(F.col("_le") - F.col("_logs")).alias("ll")]
    for i in range(p):
        c, e = split(f"s1_{i}")
        out.append(F.sum(F.col(f"_x{i}") - (c * F.col("_r1") + e * d)).alias(f"g{i}"))
    for i, j in pairs:
        (c, e), (ci, ei), (cj, ej) = split(f"s2_{i}_{j}"), split(f"s1_{i}"), split(f"s1_{j}")
        products = ci * cj * F.col("_r2") + (ci * ej + cj * ei) * F.col("_r1") + ei * ej * d
        out.append(F.sum(c * F.col("_r1") + e * d - products).alias(f"h{i}_{j}"))
    return t.groupBy(*keys).agg(*out) if keys else t.agg(*out)


def cox(
    df: DataFrame,
    covariates: Sequence[str],
    penalizer: float = 0.1,
    max_steps: int = 100,
    tol: float = 1e-9,
) -> DataFrame:
    """Penalised Cox regression with Efron ties; one row per covariate, `converged` tells whether the steps sufficed.

    Covariates are standardised for the fit and the L2 penalty is n/2 * penalizer
    * sum(beta^2) on that scale. Each Newton step is one pass over the data; the
    driver holds p numbers and a p-by-p matrix.
    """
    covariates = list(covariates)
    d = df.dropna(subset=["time", "event", *covariates]).select("time", "event", *covariates)
    facts = d.agg(
        F.count(F.lit(1)),
        F.sum("event"),
        *[F.avg(c) for c in covariates],
        *[F.stddev_samp(c) for c in covariates],
    ).first()
    n, events, p = facts[0], facts[1], len(covariates)
    mean = np.array(facts[2 : 2 + p], dtype=float)
    sd = np.array([v if v else 1.0 for v in facts[2 + p :]], dtype=float)
    for i, c in enumerate(covariates):
        d = d.withColumn(c, (F.col(c) - float(mean[i])) / float(sd[i]))
    d = d.persist()
    small = fits(d.select("time").distinct(), [])
    beta, step_scale = np.zeros(p), 1.0

    def evaluate(b):
        eta = F.lit(0.0)
        for i, c in enumerate(covariates):
            eta = eta + F.col(c) * float(b[i])
        row = _score(d, [], eta, covariates, small).first()
        ll, g = row["ll"], np.array([row[f"g{i}"] for i in range(p)])
        h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        return ll, ll - n * 0.5 * penalizer * float(b @ b), g - n * penalizer * b, h + n * penalizer * np.eye(p)

    ll, target, g, h = evaluate(beta)
    converged = False
    for _ in range(max_steps):
        step = np.linalg.solve(h, g)
        converged = float(g @ step) / 2 < tol
        if converged:
            break
        trial = evaluate(beta + step_scale * step)
        if trial[1] < target - 1e-12:
            step_scale /= 2
            continue
        beta = beta + step_scale * step
        ll, target, g, h = trial
        step_scale = min(1.0, step_scale * 2)
    d.unpersist()
    se = np.sqrt(np.diag(np.linalg.inv(h))) / sd
    coef = beta / sd
    z = coef / se
    out = pd.DataFrame(
        {
            "covariate": covariates,
            "coef": coef,
            "hazard_ratio": np.exp(coef),
            "se": se,
            "z": z,
            "p_value": 2 * normal_upper(np.abs(z)),
            "lower": np.exp(coef - 1.959963984540054 * se),
            "upper": np.exp(coef + 1.959963984540054 * se),
            "log_likelihood": ll,
            "n": n,
            "events": events,
            "converged": converged,
        }
    )
    return df.sparkSession.createDataFrame(out)


def linear_predictor(df: DataFrame, fit: DataFrame, out: str = "risk") -> DataFrame:
    """Sum of coefficient times covariate for each subject (coefficients are a handful of rows)."""
    score = F.lit(0.0)
    for row in fit.select("covariate", "coef").collect():
        score = score + F.col(row["covariate"]) * float(row["coef"])
    return df.withColumn(out, score)


def univariate_cox(
    survival: DataFrame, expr: DataFrame, min_samples: int = 10, steps: int = 25, tol: float = 1e-8
) -> DataFrame:
    """One Cox model per gene, all genes in the same Newton steps; `converged` is false where they did not suffice.

    The coefficients (one row per gene) are checkpointed after each step, so no
    step repeats the ones before it.
    """
    spark = expr.sparkSession
    ensure_checkpoint_dir(spark)
    d = with_gene_values(survival.select("sample_id", "time", "event"), expr).dropna(
        subset=["value", "time", "event"]
    )
    info = d.groupBy("gene_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("event").cast("long").alias("n_events"),
        F.avg("value").alias("_m"),
        F.stddev_samp("value").alias("_s"),
    ).filter((F.col("n") >= min_samples) & (F.col("_s") > 0) & (F.col("n_events") > 0))
    d = d.join(info, "gene_id").select(
        "gene_id", "time", "event", ((F.col("value") - F.col("_m")) / F.col("_s")).alias("x")
    ).persist()
    small = fits(d, ["gene_id"])
    beta = info.select("gene_id", F.lit(0.0).alias("b"))
    for _ in range(steps):
        s = _score(d.join(beta, "gene_id"), ["gene_id"], F.col("b") * F.col("x"), ["x"], small)
        move = F.when(F.col("h0_0") > 0, F.col("g0") / F.col("h0_0")).otherwise(F.lit(0.0))
        # one step never moves further than two standard deviations' worth of log-hazard
        move = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), move))
        beta = beta.join(s, "gene_id").select(
            "gene_id", (F.col("b") + move).alias("b"), F.abs(move).alias("move")
        ).checkpoint()
        worst = beta.agg(F.max("move")).first()[0]
        last, beta = beta, beta.drop("move")
        if worst is None or worst < tol:
            break
    s = _score(d.join(beta, "gene_id"), ["gene_id"], F.col("b") * F.col("x"), ["x"], small)
    c = concordance(
        d.join(beta, "gene_id").withColumn("risk", F.col("x") * F.signum("b")), ["gene_id"], small=small
    )
    out = last.join(s.select("gene_id", "h0_0", "ll"), "gene_id").join(info, "gene_id").join(
        c.select("gene_id", "concordance"), "gene_id", "left"
    )
    coef = F.col("b") / F.col("_s")
    se = F.when(F.col("h0_0") > 0, 1 / F.sqrt("h0_0") / F.col("_s"))
    out = out.select(
        "gene_id", "n", "n_events", "concordance", coef.alias("coef"), se.alias("se"),
        (F.col("b") * F.sqrt("h0_0")).alias("z"), F.col("ll").alias("log_likelihood"),
        (F.col("move") < tol).alias("converged"),
    )
    hr = F.exp("coef")
    return (
        out.withColumn("hazard_ratio", hr)
        .withColumn("p_value", norm_sf2("z"))
        .withColumn("lower", F.exp(F.col("coef") - 1.959963984540054 * F.col("se")))
        .withColumn("upper", F.exp(F.col("coef") + 1.959963984540054 * F.col("se")))
        .withColumn("significant", F.col("p_value") < 0.05)
        .withColumn("highly_significant", F.col("p_value") < 0.001)
        .withColumn("effect", F.when(hr < 1, "Protective").when(hr > 1, "Risk").otherwise("Neutral"))
    )


def top_survival_genes(fits_: DataFrame, top: int = 50) -> DataFrame:
    return (
        fits_.filter("significant")
        .withColumn(
            "biomarker_type", F.when(F.col("effect") == "Neutral", "Neutral").otherwise("Prognostic")
        )
        .withColumn("effect_size", F.abs(F.col("hazard_ratio") - 1))
        .orderBy("p_value", F.col("concordance").desc(), "gene_id")
        .limit(top)
    )


# ---- concordance ----------------------------------------------------------------------------


def _count_below(t: np.ndarray, r: np.ndarray, is_event: np.ndarray) -> np.ndarray:
    """For every event: how many rows have a later time order and a smaller risk.

    Merge counting: blocks of doubling width, all blocks of a level searched at once.
    """
    m = len(t)
    total = np.zeros(m, dtype=np.int64)
    if m < 2:
        return total
    order = np.lexsort((r, t))  # by time; equal times are taken out below
    t, r = t[order], r[order]
    rank = np.unique(r, return_inverse=True)[1].astype(np.int64)
    out = np.zeros(m, dtype=np.int64)
    width = 1
    span = int(rank.max()) + 2
    pos = np.arange(m)
    while width < m:
        block = pos // (2 * width)
        right = (pos // width) % 2 == 1
        keys = np.sort(block[right] * span + rank[right])
        left = ~right
        low = np.searchsorted(keys, block[left] * span, side="left")
        hit = np.searchsorted(keys, block[left] * span + rank[left], side="left")
        out[left] += hit - low
        width *= 2
    # equal times sit next to each other, sorted by risk, so none of them was counted as smaller
    total[order] = out
    return np.where(is_event, total, 0)


def concordance(
    df: DataFrame, keys: Sequence[str] = (), risk: str = "risk", small: bool | None = None
) -> DataFrame:
    """Harrell's C per key: a higher risk should go with an earlier event; ties in risk count half.

    A pair counts when the earlier subject has an event; at equal times an event
    comes before a censored subject and two events are not compared. Pairs are
    counted, never produced.
    """
    keys = list(keys)
    d = reuse(df.select(*keys, "time", "event", F.col(risk).alias("r")).dropna())
    # order of (time, event first): 2 t for events, 2 t + 1 for censored, on dense time ranks
    times = d.groupBy(*keys, "time").agg(F.lit(1).alias("one"))
    dense = ordered_scan(times, keys, "time", {"o": ("sum", "one", "asc")}, small)
    d = d.join(dense.select(*keys, "time", "o"), [*keys, "time"]).withColumn(
        "o", (F.col("o") * 2 + F.when(F.col("event") == 1, 0).otherwise(1)).cast("double")
    )
    pairs = _later_pairs(d, keys, small, "pairs")
    ties = _later_pairs(d, [*keys, "r"], small, "tied")
    ties = ties.groupBy(*keys).agg(F.sum("tied").alias("tied")) if keys else ties.agg(F.sum("tied").alias("tied"))
    if fits(d, keys, small):
        good = _strip_count(d, keys, None)
    else:
        good = _grid_count(d, keys)
    good = good.groupBy(*keys).agg(F.sum("good").alias("good")) if keys else good.agg(F.sum("good").alias("good"))
    if keys:
        out = pairs.join(ties, keys).join(good, keys)
    else:
        out = pairs.withColumn("tied", ties.scalar()).withColumn("good", good.scalar())
    share = (F.col("good") + 0.5 * F.col("tied")) / F.col("pairs")
    return out.withColumn("concordance", F.when(F.col("pairs") > 0, share))


def _later_pairs(d: DataFrame, keys, small, name: str) -> DataFrame:
    """Comparable pairs within each key, from counts per time order."""
    t = d.groupBy(*keys, "o").agg(
        F.count(F.lit(1)).alias("c"), F.sum("event").cast("long").alias("e")
    )
    t = ordered_scan(t, keys, "o", {"up": ("sum", "c", "desc")}, small)
    total = F.coalesce(F.sum(F.col("e") * (F.col("up") - F.col("c"))), F.lit(0)).alias(name)
    return t.groupBy(*keys).agg(total) if keys else t.agg(total)


def _strip_count(d: DataFrame, keys, strip: str | None, across: str | None = None) -> DataFrame:
    """Count later-and-smaller rows inside each strip; with `across`, only from lower buckets of it."""
    group = [*keys, *([strip] if strip else [])]
    fields = {f.name: f.dataType.simpleString() for f in d.schema}
    schema = ", ".join([f"`{k}` {fields[k]}" for k in keys] + ["good long"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf[across] if across else pdf["r"]
        found = _count_below(
            pdf["o"].to_numpy(float), r.to_numpy(float), pdf["event"].to_numpy() == 1
        ).sum()
        row = {k: [pdf[k].iloc[0]] for k in keys}
        row["good"] = [int(found)]
        return pd.DataFrame(row)

    cols = [*group, "o", "r", "event"] + ([across] if across else [])
    return d.select(*dict.fromkeys(cols)).groupBy(*group).applyInPandas(count, schema)


def _grid_count(d: DataFrame, keys) -> DataFrame:
    """Strips for equal risk or time buckets, and a grid of counts for the rest."""
    d = value_buckets(d, "r", "rb")
    d = value_buckets(d, "o", "tb")
    same_risk = _strip_count(d, keys, "rb")
    same_time = _strip_count(d, keys, "tb", across="rb")
    # lower risk bucket, later time bucket
    cells = d.groupBy(*keys, "rb", "tb").agg(
        F.count(F.lit(1)).alias("c"), F.sum("event").cast("long").alias("e")
    )
    top = int(d.agg(F.max("tb")).first()[0] or 0)
    row = cells.groupBy(*keys, "rb").agg(
        *[F.sum(F.when(F.col("tb") > b, F.col("c")).otherwise(0)).alias(f"_l{b}") for b in range(top + 1)]
    )
    later = row.select(
        *keys, "rb", F.posexplode(F.array(*[F.col(f"_l{b}") for b in range(top + 1)])).alias("tb", "later")
    ).withColumn("tb", F.col("tb").cast("double"))
    # one row per (risk bucket, time bucket): the groups hold at most one row per risk bucket
    below = ordered_scan(later, [*keys, "tb"], "rb", {"upto": ("sum", "later", "asc")}, True)
    far = cells.join(below, [*keys, "rb", "tb"]).select(
        *keys, (F.col("e") * (F.col("upto") - F.col("later"))).alias("good")
    )
    # the strip of one risk bucket also sees equal-time pairs of that bucket only, so the three
    # parts (same risk bucket / lower bucket same time bucket / lower bucket later bucket) are disjoint
    return same_risk.unionByName(same_time).unionByName(far)


def overview(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum("event").cast("long").alias("n_events"),
        F.avg("event").alias("event_rate"),
        F.min("time").alias("min_time"),
        F.max("time").alias("max_time"),
    )
