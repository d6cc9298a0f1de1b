"""Omics-shaped views over the given tables, in Spark and as SQL of the same meaning.

genes are part brand and type (150), samples are suppliers, values are sums of
returned quantity, so cells are zero-inflated and some are absent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _gene():
    return F.concat_ws("_", "p_brand", "p_type")


def _sample(col="l_suppkey"):
    return F.concat(F.lit("S"), F.col(col).cast("string"))


class Tables:
    """The given parquet tables by name, and the stand-in views as methods."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _cells(self):
        genes = self.part.select("p_partkey", _gene().alias("gene_id"))
        return self.lineitem.join(genes, F.col("l_partkey") == F.col("p_partkey")).groupBy(
            "gene_id", _sample().alias("sample_id")
        )

    def expr(self) -> DataFrame:
        returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
        return self._cells().agg(F.sum(returned).alias("value"))

    def counts(self) -> DataFrame:
        """Every quantity, hardly any zero."""
        return self._cells().agg(F.sum("l_quantity").alias("value"))

    def expr_nulls(self) -> DataFrame:
        """As `expr`, with missing cells."""
        returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
        return self._cells().agg(
            F.when(F.max("l_discount") >= 0.05, F.sum(returned)).alias("value")
        )

    def expr_sparse(self) -> DataFrame:
        """One gene per part, mostly zeros."""
        large = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)
        return self.lineitem.groupBy(
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("gene_id"),
            _sample().alias("sample_id"),
        ).agg(F.sum(F.when(large, F.col("l_quantity")).otherwise(0.0)).alias("value"))

    def expr_fine(self) -> DataFrame:
        """One gene per part: many genes, few samples each."""
        return self.lineitem.groupBy(
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("gene_id"),
            _sample().alias("sample_id"),
        ).agg(F.sum("l_quantity").alias("value"))

    def samples(self) -> DataFrame:
        acct = F.col("s_acctbal")
        return (
            self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                _sample("s_suppkey").alias("sample_id"),
                F.when(acct >= 4500, 1).otherwise(0).alias("label"),
                F.when(acct < 2667, "low").when(acct < 6333, "mid").otherwise("top").alias("tier"),
                F.col("r_name").alias("batch"),
                acct.alias("age"),
            )
        )

    def omics(self) -> DataFrame:
        """Three layers in one long table."""
        cells = self._cells().agg(
            F.sum("l_quantity").alias("expression"),
            (F.avg("l_discount") * 10).alias("methylation"),
            F.avg("l_extendedprice").alias("protein"),
        )
        return cells.unpivot(
            ["gene_id", "sample_id"], ["expression", "methylation", "protein"], "layer", "value"
        ).select("layer", "gene_id", "sample_id", "value")

    def survival(self) -> DataFrame:
        per = self.orders.groupBy("o_custkey").agg(
            (F.datediff(F.max("o_orderdate"), F.min("o_orderdate")) + 1).cast("double").alias("time"),
            F.when(F.max_by("o_orderstatus", "o_orderkey") == "F", 1).otherwise(0).alias("event"),
            F.sum("o_totalprice").alias("spend"),
        )
        return per.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).select(
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("sample_id"),
            "time",
            "event",
            F.when(F.col("c_acctbal") >= 4500, "high").otherwise("low").alias("grp"),
            F.col("c_acctbal").alias("age"),
            "spend",
        )

    def gene_sets(self) -> DataFrame:
        by = lambda col: self.part.select(F.col(col).alias("gene_set"), _gene().alias("gene"))
        return by("p_brand").unionByName(by("p_type")).distinct()

    def edges(self) -> DataFrame:
        """Genes on neighbouring lines of one order."""
        lines = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey")).select(
            "l_orderkey", "l_linenumber", _gene().alias("gene")
        )
        nxt = lines.select(
            "l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("gene").alias("dst")
        )
        return (
            lines.withColumnRenamed("gene", "src")
            .join(nxt, ["l_orderkey", "l_linenumber"])
            .filter(F.col("src") != F.col("dst"))
            .groupBy("src", "dst")
            .agg((F.count(F.lit(1)) / 10).alias("weight"))
        )

    def results(self) -> DataFrame:
        """A biomarker result table: one row per part, one run per part type."""
        agg = self.lineitem.groupBy("l_partkey").agg(
            F.round(F.avg("l_discount") * 10, 6).alias("p_value"),
            F.round(F.log2(F.avg("l_quantity") / 25.5) * 4, 6).alias("log2fc"),
            F.round(F.avg("l_tax") / 0.08, 6).alias("importance"),
            F.count(F.lit(1)).alias("n_lines"),
            F.max("l_shipdate").alias("created_at"),
        )
        return agg.join(self.part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.concat(F.lit("run_"), F.lower("p_type")).alias("run_id"),
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("gene"),
            "p_value",
            "log2fc",
            "importance",
            F.when(F.col("n_lines") % 4 == 0, "A")
            .when(F.col("n_lines") % 4 == 1, "B")
            .when(F.col("n_lines") % 4 == 2, "C")
            .otherwise("D")
            .alias("level"),
            F.col("p_brand").alias("biomarker_type"),
            F.col("p_size").alias("owner"),
            "created_at",
        )

    def predictions(self) -> DataFrame:
        """Scores of two models for the same cases."""
        base = self.orders.select(
            F.col("o_orderkey").alias("id"),
            F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"),
            F.least(F.lit(1.0), F.round(F.col("o_totalprice") / 500000, 3)).alias("price"),
            F.round(F.dayofyear("o_orderdate") / 366, 3).alias("season"),
        )
        return base.unpivot(["id", "y"], ["price", "season"], "model", "score").select(
            "model", "id", "y", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("yhat"), "score"
        )

    def evidence(self) -> DataFrame:
        joined = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).join(
            self.nation, F.col("c_nationkey") == F.col("n_nationkey")
        )
        pr, st = F.col("o_orderpriority"), F.col("o_orderkey") % 6
        return joined.select(
            F.col("n_name").alias("biomarker"),
            F.col("c_mktsegment").alias("disease"),
            F.when(pr == "1-URGENT", "A").when(pr == "2-HIGH", "B").when(pr == "3-MEDIUM", "C")
            .otherwise("D").alias("level"),
            F.when(st == 0, "RCT").when(st == 1, "meta-analysis").when(st == 2, "cohort")
            .when(st == 3, "case-control").when(st == 4, "guideline").otherwise("other")
            .alias("study_type"),
            F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "moderate")
            .otherwise("low").alias("significance"),
            F.floor(F.col("o_totalprice") / 300).cast("long").alias("n"),
            (F.dayofmonth("o_orderdate") / 40).alias("p"),
            (F.col("o_totalprice") / 300000).alias("effect"),
            (F.month("o_orderdate") * 2.0).alias("impact"),
            (F.year("o_orderdate") + 22).alias("year"),
        )

    def metrics(self) -> DataFrame:
        """Monitoring rows: events as metric samples of a host."""
        return self.events.select(
            "event_id",
            "ts",
            F.concat(F.lit("host"), F.col("user_id").cast("string")).alias("host"),
            F.col("event_type").alias("metric"),
            "value",
        )


_CELLS = (
    "FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"
)
_KEYS = "p_brand || '_' || p_type AS gene_id, 'S' || l_suppkey AS sample_id"
_RETURNED = "sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END)"

SQL = {
    "expr": f"SELECT {_KEYS}, CAST({_RETURNED} AS DOUBLE) AS value {_CELLS}",
    "counts": f"SELECT {_KEYS}, CAST(sum(l_quantity) AS DOUBLE) AS value {_CELLS}",
    "expr_nulls": f"""SELECT {_KEYS},
        CASE WHEN max(l_discount) >= 0.05 THEN CAST({_RETURNED} AS DOUBLE) END AS value {_CELLS}""",
    "expr_sparse": """SELECT 'P' || l_partkey AS gene_id, 'S' || l_suppkey AS sample_id,
        CAST(sum(CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN l_quantity ELSE 0.0 END) AS DOUBLE) AS value
        FROM lineitem GROUP BY 1, 2""",
    "expr_fine": """SELECT 'P' || l_partkey AS gene_id, 'S' || l_suppkey AS sample_id,
        CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2""",
    "samples": """SELECT 'S' || s_suppkey AS sample_id,
        CASE WHEN s_acctbal >= 4500 THEN 1 ELSE 0 END AS label,
        CASE WHEN s_acctbal < 2667 THEN 'low' WHEN s_acctbal < 6333 THEN 'mid' ELSE 'top' END AS tier,
        r_name AS batch, s_acctbal AS age
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "omics": f"""SELECT layer, gene_id, sample_id, value FROM (
        UNPIVOT (SELECT {_KEYS}, CAST(sum(l_quantity) AS DOUBLE) AS expression,
            avg(l_discount) * 10 AS methylation, avg(l_extendedprice) AS protein {_CELLS})
        ON expression, methylation, protein INTO NAME layer VALUE value)""",
    "survival": """SELECT 'C' || o_custkey AS sample_id, time, event,
        CASE WHEN c_acctbal >= 4500 THEN 'high' ELSE 'low' END AS grp, c_acctbal AS age, spend
        FROM (SELECT o_custkey,
            CAST(date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) + 1 AS DOUBLE) AS time,
            CASE WHEN arg_max(o_orderstatus, o_orderkey) = 'F' THEN 1 ELSE 0 END AS event,
            sum(o_totalprice) AS spend FROM orders GROUP BY o_custkey) JOIN customer ON o_custkey = c_custkey""",
    "gene_sets": """SELECT p_brand AS gene_set, p_brand || '_' || p_type AS gene FROM part
        UNION SELECT p_type, p_brand || '_' || p_type FROM part""",
    "edges": """SELECT a.gene AS src, b.gene AS dst, count(*) / 10.0::DOUBLE AS weight
        FROM (SELECT l_orderkey, l_linenumber, p_brand || '_' || p_type AS gene
              FROM lineitem JOIN part ON l_partkey = p_partkey) a
        JOIN (SELECT l_orderkey, l_linenumber, p_brand || '_' || p_type AS gene
              FROM lineitem JOIN part ON l_partkey = p_partkey) b
        ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
        WHERE a.gene <> b.gene GROUP BY 1, 2""",
    "results": """SELECT 'run_' || lower(p_type) AS run_id, 'P' || p_partkey AS gene, p_value, log2fc, importance,
        CASE n_lines % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS level,
        p_brand AS biomarker_type, p_size AS owner, created_at
        FROM (SELECT l_partkey, round(avg(l_discount) * 10, 6) AS p_value,
            round(log2(avg(l_quantity) / 25.5) * 4, 6) AS log2fc, round(avg(l_tax) / 0.08, 6) AS importance,
            count(*) AS n_lines, max(l_shipdate) AS created_at FROM lineitem GROUP BY 1)
        JOIN part ON l_partkey = p_partkey""",
    "predictions": """SELECT model, id, y, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS yhat, score FROM (
        UNPIVOT (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
            least(1.0::DOUBLE, round(o_totalprice / 500000, 3)) AS price,
            round(dayofyear(o_orderdate) / 366.0::DOUBLE, 3) AS season FROM orders)
        ON price, season INTO NAME model VALUE score)""",
    "evidence": """SELECT n_name AS biomarker, c_mktsegment AS disease,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'B' WHEN '3-MEDIUM' THEN 'C' ELSE 'D' END AS level,
        CASE o_orderkey % 6 WHEN 0 THEN 'RCT' WHEN 1 THEN 'meta-analysis' WHEN 2 THEN 'cohort'
            WHEN 3 THEN 'case-control' WHEN 4 THEN 'guideline' ELSE 'other' END AS study_type,
        CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'moderate' ELSE 'low' END AS significance,
        CAST(floor(o_totalprice / 300) AS BIGINT) AS n, day(o_orderdate) / 40.0::DOUBLE AS p,
        o_totalprice / 300000 AS effect, month(o_orderdate) * 2.0::DOUBLE AS impact, year(o_orderdate) + 22 AS year
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "metrics": """SELECT event_id, ts, 'host' || user_id AS host, event_type AS metric, value FROM events""",
}


def with_views(names: str, body: str) -> str:
    """`body` behind a WITH clause holding the named stand-in views."""
    parts = ", ".join(f"{n} AS ({SQL[n]})" for n in names.split())
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {parts}, {body[5:]}"
    return f"WITH {parts} {body}"


# --- tail probabilities in SQL, by Simpson's rule on smooth integrands -------------------------

_STEPS = 1600


def _simpson(lo: str, hi: str, integrand: str) -> str:
    """Integral of `integrand` (an expression in x) from lo to hi."""
    h = f"(({hi}) - ({lo})) / {_STEPS}.0"
    body = integrand.replace("{x}", f"(({lo}) + i * {h})")
    weight = f"(CASE WHEN i = 0 OR i = {_STEPS} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)"
    return (
        f"(list_sum(list_transform(range(0, {_STEPS + 1}), lambda i: CAST({weight} AS DOUBLE) * ({body})))"
        f" * {h} / 3.0)"
    )


def sql_t_two_sided(t: str, df: str) -> str:
    """Two-sided t tail through t = sqrt(df) tan(x)."""
    const = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi())"
    lo = f"atan(abs({t}) / sqrt({df}))"
    return f"(2 * {const} * {_simpson(lo, 'pi() / 2', f'pow(greatest(cos({{x}}), 0), {df} - 1)')})"


def sql_chi2_even(x: str, df: int) -> str:
    """Chi-squared tail for even degrees of freedom (closed form)."""
    terms, fact = [], 1
    for j in range(df // 2):
        fact = fact * j if j else 1
        terms.append(f"pow({x} / 2, {j}) / {fact}.0")
    return f"(exp(-({x}) / 2) * ({' + '.join(terms)}))"


def sql_normal_two_sided(z: str) -> str:
    """Two-sided normal tail of z >= 0, integrated over [z, z + 10]."""
    return f"(2 / sqrt(2 * pi()) * {_simpson(f'({z})', f'({z}) + 10', 'exp(-{x} * {x} / 2)')})"


def sql_f_sf_df1_2(f: str, d2: str) -> str:
    """F tail when the numerator has two degrees of freedom."""
    return f"pow(1 + 2 * ({f}) / ({d2}), -({d2}) / 2.0)"


def sql_f_sf_df1_4(f: str, d2: str) -> str:
    """F tail when the numerator has four degrees of freedom."""
    u = f"(4 * ({f}) / ({d2}))"
    return f"(pow(1 + {u}, -({d2}) / 2.0) * (1 + ({d2}) / 2.0 * {u} / (1 + {u})))"
