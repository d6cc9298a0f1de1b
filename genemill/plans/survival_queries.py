"""Survival queries over customers as subjects."""

from __future__ import annotations

from pyspark.sql import functions as F

from genemill.operators import survival as S
from genemill.plans.registry import query, rounded
from genemill.plans.standins import sql_normal_two_sided, with_views

_LT = """t AS (SELECT grp, time, CAST(sum(event) AS BIGINT) AS d, count(*) AS c FROM survival GROUP BY 1, 2),
    lt AS (SELECT *, CAST(sum(c) OVER (PARTITION BY grp ORDER BY time DESC) AS BIGINT) AS n FROM t),
    km AS (SELECT grp, time, n, d, CASE WHEN sum(CASE WHEN d >= n THEN 1 ELSE 0 END) OVER w > 0 THEN 0.0::DOUBLE
        ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n::DOUBLE) ELSE 0 END) OVER w) END AS s
        FROM lt WINDOW w AS (PARTITION BY grp ORDER BY time))"""


@query(
    "survival_clean",
    with_views("survival", "SELECT sample_id, time, event, grp, age, round(spend, 2) AS spend FROM survival WHERE time > 0"),
)
def clean(t):
    d = t.survival().withColumn("time", F.col("time").cast("string"))
    return rounded(S.clean(d), 2)


@query(
    "survival_prepare_standardised",
    with_views(
        "survival",
        """SELECT sample_id, time, event, grp, round(spend, 2) AS spend,
        round((age - (SELECT avg(age) FROM survival)) / (SELECT stddev_pop(age) FROM survival), 6) AS age FROM survival""",
    ),
)
def prepare(t):
    return rounded(S.prepare(t.survival(), ["age"]), 6, spend=2)


@query(
    "survival_kaplan_meier",
    with_views(
        "survival",
        f"WITH {_LT} SELECT grp, time, n AS at_risk, d AS events, round(s, 6) AS survival FROM km",
    ),
)
def km(t):
    return rounded(S.kaplan_meier(t.survival()))


@query(
    "survival_median_and_fixed_times",
    with_views(
        "survival",
        f"""WITH {_LT} SELECT grp, min(time) FILTER (s <= 0.5) AS median_survival,
        round(coalesce(arg_max(s, time) FILTER (time <= 365), 1.0::DOUBLE), 6) AS survival_at_365,
        round(coalesce(arg_max(s, time) FILTER (time <= 1825), 1.0::DOUBLE), 6) AS survival_at_1825,
        (SELECT count(*) FROM survival x WHERE x.grp = km.grp) AS n, CAST(sum(d) AS BIGINT) AS events FROM km GROUP BY grp""",
    ),
)
def medians(t):
    return rounded(S.survival_summary(t.survival()))


@query(
    "survival_median_split_groups",
    with_views(
        "survival",
        """WITH m AS (SELECT quantile_cont(spend, 0.5) AS m FROM survival)
        SELECT CASE WHEN spend <= m THEN 'low' ELSE 'high' END AS grp, count(*) AS n, CAST(sum(event) AS BIGINT) AS events
        FROM survival, m GROUP BY 1""",
    ),
)
def split(t):
    return S.median_split(t.survival().drop("grp"), "spend").groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event").cast("long").alias("events")
    )


@query(
    "survival_logrank_two_groups",
    with_views(
        "survival",
        f"""WITH t AS (SELECT time, sum(event)::DOUBLE AS d, count(*)::DOUBLE AS c, sum(CASE WHEN grp = 'high' THEN 1 ELSE 0 END)::DOUBLE AS c1,
            sum(CASE WHEN grp = 'high' THEN event ELSE 0 END)::DOUBLE AS d1 FROM survival GROUP BY 1),
        r AS (SELECT *, sum(c) OVER (ORDER BY time DESC) AS n, sum(c1) OVER (ORDER BY time DESC) AS n1 FROM t),
        s AS (SELECT sum(d1 - n1 * d / n) AS gap, sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * (n1 / n) * (1 - n1 / n) ELSE 0 END) AS v FROM r WHERE d > 0),
        z AS (SELECT gap * gap / v AS chi FROM s)
        SELECT round(chi, 6) AS statistic, 1 AS df, round({sql_normal_two_sided('sqrt(chi)')}, 6) AS p_value, 2 AS n_groups FROM z""",
    ),
)
def logrank2(t):
    return rounded(S.logrank(t.survival()))


@query("survival_logrank_k_groups")
def logrank_k(t):
    s = t.survival().drop("grp").join(
        t.customer.select(
            F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("sample_id"),
            F.col("c_mktsegment").alias("grp"),
        ),
        "sample_id",
    )
    return rounded(S.logrank(s))


@query("survival_cox_regression")
def cox(t):
    s = t.survival().withColumn("spend", F.col("spend") / 1e6)
    return rounded(S.cox(s, ["age", "spend"]), 6)


def _supplier_survival(t):
    """Suppliers as subjects: days from first to last shipment, event by last status."""
    per = t.lineitem.groupBy("l_suppkey").agg(
        (F.datediff(F.max("l_shipdate"), F.min("l_shipdate")) - 2000).cast("double").alias("time"),
        F.when(F.max_by("l_linestatus", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")) == "F", 1)
        .otherwise(0)
        .alias("event"),
    )
    return per.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("sample_id"), "time", "event"
    ).filter("time > 0")


@query("survival_univariate_cox")
def univariate(t):
    return rounded(S.univariate_cox(_supplier_survival(t), t.expr()), 5)


@query("survival_top_genes")
def top_genes(t):
    fit = S.univariate_cox(_supplier_survival(t), t.expr())
    return rounded(S.top_survival_genes(fit, 20), 5)


@query(
    "survival_concordance",
    with_views(
        "survival",
        """WITH p AS (SELECT a.age AS ra, b.age AS rb FROM survival a JOIN survival b ON a.event = 1
            AND (a.time < b.time OR (a.time = b.time AND b.event = 0)))
        SELECT count(*) AS pairs, count(*) FILTER (ra = rb) AS tied, count(*) FILTER (ra > rb) AS good,
        round((count(*) FILTER (ra > rb) + 0.5 * count(*) FILTER (ra = rb)) / count(*)::DOUBLE, 6) AS concordance FROM p""",
    ),
)
def concordance(t):
    out = S.concordance(t.survival().withColumn("risk", F.col("age")))
    return rounded(out.select("pairs", "tied", "good", "concordance"))


@query(
    "survival_overview",
    with_views(
        "survival",
        """SELECT count(*) AS n_samples, CAST(sum(event) AS BIGINT) AS n_events, round(avg(event), 6) AS event_rate,
        min(time) AS min_time, max(time) AS max_time FROM survival""",
    ),
)
def overview(t):
    return rounded(S.overview(t.survival()))


@query(
    "join_expression_to_clinical",
    with_views(
        "expr samples",
        """SELECT sample_id, age AS time, label AS event, gene_id, value FROM samples JOIN expr USING (sample_id) WHERE age > 0""",
    ),
)
def expr_clinical(t):
    clin = t.samples().select("sample_id", F.col("age").alias("time"), F.col("label").alias("event"))
    return S.with_gene_values(S.clean(clin), t.expr())
