"""Scans and sinks over files written from the given tables, and streaming jobs over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from genemill.operators import omics as O
from genemill.operators import survival as S
from genemill.plans.registry import query, rounded
from genemill.plans.standins import with_views
from genemill.sources import readers as RD
from genemill.sources import writers as W
from genemill.streaming import monitor as MO

_EXPR = "SELECT gene_id, sample_id, value FROM expr"


def _matrix_file(t, fmt="csv"):
    path = MO.scratch(t.spark, f"matrix.{fmt}")
    W.write_matrix(t.expr(), path, fmt)
    return path


@query("scan_expression_matrix", with_views("expr", _EXPR))
def scan_matrix(t):
    return RD.expression_matrix(t.spark, _matrix_file(t)).filter("value IS NOT NULL")


@query("scan_pipeline_matrix", with_views("expr", _EXPR))
def scan_pipeline(t):
    path = _matrix_file(t, "tsv")
    return RD.pipeline_matrix(t.spark, path, "\t").filter("value IS NOT NULL")


@query("scan_omics_matrix", with_views("expr", _EXPR))
def scan_omics(t):
    path = MO.scratch(t.spark, "layer") + ".csv"
    W.write_matrix(t.expr(), path, "csv")
    return RD.omics_matrix(t.spark, path).filter("value IS NOT NULL")


@query("scan_matrix_lines", with_views("expr", _EXPR))
def scan_lines(t):
    """A matrix written and read line by line, for any number of samples."""
    return RD.matrix_lines(t.spark, _matrix_file(t, "tsv"), "\t")


@query("scan_labels", with_views("samples", "SELECT sample_id, tier AS label, batch FROM samples"))
def scan_labels(t):
    path = MO.scratch(t.spark, "labels") + ".csv"
    W.write_table(t.samples().select("sample_id", "tier", "batch"), path, "csv")
    return RD.labels(t.spark, path, "sample_id", "tier")


@query("scan_run_metadata", "SELECT r_regionkey AS run, r_name AS name FROM region")
def scan_metadata(t):
    path = MO.scratch(t.spark, "meta")
    t.region.select(F.col("r_regionkey").alias("run"), F.col("r_name").alias("name")).write.partitionBy("run").json(path)
    return RD.run_metadata(t.spark, path).select(F.col("run").cast("int").alias("run"), "name")


@query(
    "scan_survival_table",
    with_views("survival", "SELECT sample_id, time, event, grp FROM survival WHERE time > 0"),
)
def scan_survival(t):
    path = MO.scratch(t.spark, "survival") + ".csv"
    W.write_table(t.survival().select("sample_id", "time", "event", "grp"), path, "csv")
    return RD.survival_table(t.spark, path)


@query(
    "scan_sample_files",
    """SELECT gene_id, 'b' || s AS sample_id, CAST(count AS DOUBLE) AS value FROM (SELECT 'P' || l_partkey AS gene_id, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS s,
    count(*) AS count FROM lineitem GROUP BY 1, 2)""",
)
def scan_sample_files(t):
    """One gzipped tsv per sample, read together; the sample is the name of the file."""
    base = MO.scratch(t.spark, "samples")
    d = t.lineitem.groupBy(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("gene_id"), "l_returnflag"
    ).agg(F.lit("x").alias("gene_name"), F.count(F.lit(1)).alias("read_count"))
    code = F.when(F.col("l_returnflag") == "A", "b1").when(F.col("l_returnflag") == "N", "b2").otherwise("b3")
    d.withColumn("part", code).drop("l_returnflag").write.partitionBy("part").option("compression", "gzip").csv(
        base, sep="\t", header=True
    )
    # a written folder per sample stands for a file per sample: the folder names the sample
    out = RD.sample_files(t.spark, [f"{base}/part=b{i}" for i in (1, 2, 3)])
    return out.withColumn("sample_id", F.regexp_extract(F.input_file_name(), r"part=(b\d)", 1))


@query(
    "scan_event_file_union",
    """SELECT event_id, user_id, NULL::VARCHAR AS props FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, NULL, props FROM events WHERE event_type <> 'view'""",
)
def scan_event_union(t):
    a = t.events.filter("event_type = 'view'").select("event_id", "user_id")
    b = t.events.filter("event_type <> 'view'").select("event_id", "props")
    return RD.event_files([a, b])


@query(
    "scan_series_matrix",
    with_views("samples", "SELECT sample_id AS gene_id, 'GSM1' AS sample_id, CAST(label AS DOUBLE) AS value FROM samples UNION ALL SELECT sample_id, 'GSM2', age FROM samples"),
)
def scan_series(t):
    path = MO.scratch(t.spark, "series")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    # a study in as many files as there are shuffle partitions, each with its own header lines
    files = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    rows = t.samples().select(
        F.pmod(F.xxhash64("sample_id"), F.lit(files)).alias("file"), F.lit(2).alias("o"),
        F.concat_ws("\t", q(F.col("sample_id")), F.col("label").cast("string"), F.col("age").cast("string")).alias("line"),
    )
    around = F.array(
        F.struct(F.lit(0).alias("o"), F.lit("!Series_title\tx").alias("line")),
        F.struct(F.lit(1).alias("o"), F.lit('"ID_REF"\t"GSM1"\t"GSM2"').alias("line")),
        F.struct(F.lit(3).alias("o"), F.lit("short row").alias("line")),
    )
    extra = t.spark.range(files).select(F.col("id").alias("file"), F.inline(around))
    lines = rows.unionByName(extra).repartition("file").sortWithinPartitions("file", "o")
    lines.select("file", "line").write.partitionBy("file").text(path)
    return RD.series_matrix(t.spark, path).select("gene_id", "sample_id", "value")


@query(
    "scan_soft_attributes",
    "SELECT 'title_' || n_nationkey AS key, n_name || ' = study' AS value FROM nation",
)
def scan_soft(t):
    path = MO.scratch(t.spark, "soft")
    t.nation.select(
        F.concat(F.lit("!Series_title_"), F.col("n_nationkey").cast("string"), F.lit(" = "), "n_name", F.lit(" = study")).alias("v")
    ).union(t.region.select(F.concat(F.lit("!Sample_x = "), "r_name"))).write.text(path)
    return RD.soft_attributes(t.spark, path).select("key", "value")


@query("scan_miniml_samples", "SELECT 'GSM' || s_suppkey AS iid, s_name AS title FROM supplier")
def scan_miniml(t):
    path = MO.scratch(t.spark, "miniml")
    # files of a family, each a document of its own
    files = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    sample = F.concat(F.lit('<Sample iid="GSM'), F.col("s_suppkey").cast("string"), F.lit('"><Title> '), "s_name", F.lit(" </Title></Sample>"))
    rows = t.supplier.select(F.pmod(F.xxhash64("s_suppkey"), F.lit(files)).alias("file"), F.lit(1).alias("o"), sample.alias("line"))
    ends = F.array(
        F.struct(F.lit(0).alias("o"), F.lit("<MINiML>").alias("line")), F.struct(F.lit(2).alias("o"), F.lit("</MINiML>").alias("line"))
    )
    lines = rows.unionByName(t.spark.range(files).select(F.col("id").alias("file"), F.inline(ends)))
    lines = lines.repartition("file").sortWithinPartitions("file", "o")
    lines.select("file", "line").write.partitionBy("file").text(path)
    return RD.miniml_samples(t.spark, path)


@query(
    "scan_edge_file",
    with_views("edges", "SELECT src, dst, CASE WHEN weight < 0.2 THEN 1.0::DOUBLE ELSE weight END AS weight FROM edges"),
)
def scan_edges(t):
    path = MO.scratch(t.spark, "edges")
    e = t.edges()
    out = e.withColumn("weight", F.when(F.col("weight") >= 0.2, F.col("weight")))  # light ones are written without weight
    W.write_table(out.select(F.col("src").alias("gene_a"), F.col("dst").alias("gene_b"), "weight"), path, "tsv")
    return RD.edge_file(t.spark, path)


@query(
    "scan_published_matrix",
    """WITH x AS (SELECT 'P' || l_partkey AS gene_id, 'S' || (l_suppkey % 10) AS sample_id, CAST(sum(CASE WHEN l_discount > 0.09 AND l_quantity > 40 THEN l_quantity ELSE 0 END) AS DOUBLE) AS value, l_linenumber % 2 AS v
        FROM lineitem GROUP BY 1, 2, 4),
    y AS (SELECT gene_id || '.' || v AS g, gene_id, sample_id, value FROM x),
    f AS (SELECT y.gene_id, sample_id, value FROM y JOIN (SELECT gene_id, min(g) AS g FROM y GROUP BY 1) m ON y.g = m.g)
    SELECT * FROM f WHERE gene_id IN (SELECT gene_id FROM f GROUP BY 1 HAVING count(*) FILTER (value > 1) >= 0.1 * (SELECT count(DISTINCT sample_id) FROM f))""",
)
def scan_published(t):
    hit = (F.col("l_discount") > 0.09) & (F.col("l_quantity") > 40)
    d = t.lineitem.groupBy(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.lit("."), (F.col("l_linenumber") % 2).cast("string")).alias("gene_id"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 10).cast("string")).alias("sample_id"),
    ).agg(F.sum(F.when(hit, F.col("l_quantity")).otherwise(0.0)).alias("value"))
    return RD.published_matrix(d)


@query(
    "scan_validation_dataset",
    """SELECT CASE WHEN l_returnflag = 'A' THEN 'Tumor' WHEN l_returnflag = 'R' THEN 'Normal' END AS label, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1""",
)
def scan_validation(t):
    word = F.when(F.col("l_returnflag") == "A", "-Tumor").when(F.col("l_returnflag") == "R", "-Normal").otherwise("-other")
    d = t.lineitem.select(F.concat(F.col("l_suppkey").cast("string"), word).alias("sample_id"))
    return RD.label_by_sample_name(d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("scan_file_registry")
def scan_registry(t):
    """The given files by size; the registry says what each holds."""
    reg = t.region.select(F.lit("lineitem.parquet").alias("file_id"), F.lit("expression").alias("data_type")).distinct()
    return RD.file_registry(t.spark, t.sf_dir, reg).select("file_id", "size", "data_type")


@query("scan_fingerprint")
def fingerprint(t):
    return RD.fingerprint(t.expr())


@query("scan_parquet_table_by_run", with_views("results", "SELECT run_id, gene, p_value FROM results WHERE run_id = 'run_promo'"))
def by_run(t):
    """Results written by run and read back with partition pruning."""
    path = MO.scratch(t.spark, "results")
    t.results().select("run_id", "gene", "p_value").write.partitionBy("run_id").parquet(path)
    return t.spark.read.parquet(path).filter("run_id = 'run_promo'").select("run_id", "gene", "p_value")


def _register_sink(fmt):
    @query(f"sink_{fmt}", with_views("results", "SELECT gene, p_value, level FROM results"))
    def run(t):
        path = MO.scratch(t.spark, f"sink-{fmt}")
        d = t.results().select("gene", "p_value", "level")
        W.write_table(d, path, fmt)
        if fmt == "parquet":
            return t.spark.read.parquet(path)
        if fmt == "json":
            return t.spark.read.schema(d.schema).json(path)
        return t.spark.read.schema(d.schema).csv(path, sep="\t" if fmt == "tsv" else ",", header=True)


for _f in ("csv", "tsv", "parquet", "json"):
    _register_sink(_f)


@query("sink_run_artefacts", with_views("results", "SELECT 'biomarkers' AS artefact, count(*) AS n FROM results UNION ALL SELECT 'significant', count(*) FILTER (p_value < 0.3) FROM results"))
def sink_run(t):
    path = MO.scratch(t.spark, "run")
    r = t.results()
    W.write_run({"biomarkers": r, "significant": r.filter("p_value < 0.3")}, path, "r1")
    read = lambda n: t.spark.read.parquet(f"{path}/{n}").filter("run_id = 'r1'").agg(
        F.lit(n).alias("artefact"), F.count(F.lit(1)).alias("n")
    )
    return read("biomarkers").union(read("significant"))


# ---- streams ---------------------------------------------------------------------------------------

# event types stand for the monitored metrics
_KIND = "CASE event_type WHEN 'view' THEN 'cpu' WHEN 'click' THEN 'memory' WHEN 'purchase' THEN 'disk' WHEN 'error' THEN 'database' ELSE 'redis' END"
_MET = f"met AS (SELECT event_id, ts, 'host' || user_id AS host, {_KIND} AS metric, CASE WHEN event_type IN ('error', 'signup') AND value < 5 THEN 0 ELSE value END AS value FROM events)"


def _as_metrics(df):
    kind = F.col("event_type")
    metric = (
        F.when(kind == "view", "cpu").when(kind == "click", "memory").when(kind == "purchase", "disk")
        .when(kind == "error", "database").otherwise("redis")
    )
    low = kind.isin("error", "signup") & (F.col("value") < 5)
    return df.select(
        "event_id", "ts", F.concat(F.lit("host"), F.col("user_id").cast("string")).alias("host"),
        metric.alias("metric"), F.when(low, 0.0).otherwise(F.col("value")).alias("value"),
    )


def _stream(t):
    return _as_metrics(MO.metric_stream(t.spark, f"{t.sf_dir}/event[s].parquet", t.events.schema))


@query("stream_metric_ingest", f"WITH {_MET} SELECT * FROM met")
def ingest(t):
    return MO.drain(_stream(t), "ingest")


_ALERTS = f"""{_MET}, al AS (SELECT event_id, ts, host, value, metric || CASE WHEN metric IN ('cpu', 'memory', 'disk') THEN '_high' ELSE '_unhealthy' END AS alert,
    CASE WHEN metric IN ('disk', 'database') THEN 'critical' ELSE 'warning' END AS severity,
    CASE metric WHEN 'cpu' THEN 80.0::DOUBLE WHEN 'memory' THEN 85 WHEN 'disk' THEN 90 ELSE 0 END AS "limit" FROM met
    WHERE (metric = 'cpu' AND value > 80) OR (metric = 'memory' AND value > 85) OR (metric = 'disk' AND value > 90) OR (metric IN ('database', 'redis') AND value <= 0))"""


@query("stream_threshold_alerts", f"WITH {_ALERTS} SELECT * FROM al")
def alerts(t):
    return MO.drain(MO.alerts(_stream(t)), "alerts")


@query(
    "stream_latest_health",
    f"""WITH {_MET}, l AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts DESC, event_id DESC) AS rn FROM met)
    SELECT host, ts, metric, value, CASE WHEN value > 90 THEN 'critical' WHEN value > 80 THEN 'warning' ELSE 'healthy' END AS health FROM l WHERE rn = 1""",
)
def health(t):
    return MO.latest_health(MO.drain(MO.health_updates(_stream(t)), "health", ["host", "span"]))


@query(
    "stream_hourly_windows",
    f"""WITH {_MET} SELECT date_trunc('hour', ts) AS hour, metric, round(avg(value), 6) AS mean, max(value) AS max, count(*) AS n FROM met GROUP BY 1, 2""",
)
def hourly(t):
    return rounded(MO.drain(MO.hourly(_stream(t)), "hourly", ["hour", "metric"]))


@query(
    "stream_metric_history",
    f"WITH {_MET} SELECT * FROM met WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-20'",
)
def history(t):
    filed = MO.drain(MO.with_day(_stream(t)), "history", partition="day")
    return MO.history(filed, "2024-01-20 00:00:00", 24)


@query(
    "stream_active_alerts",
    f"""WITH {_ALERTS} SELECT event_id, ts, alert, severity FROM al WHERE event_id % 3 <> 0""",
)
def active(t):
    # every third event is followed by a resolution two days later
    done = MO.alerts(_stream(t)).filter("event_id % 3 = 0").select(
        "event_id", "alert", (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts")
    )
    updates = MO.drain(MO.alert_updates(MO.alerts(_stream(t)), done), "active", ["event_id", "alert", "span"])
    return MO.active_alerts(updates).select("event_id", "ts", "alert", "severity")


@query(
    "stream_run_progress",
    """WITH p AS (SELECT user_id AS run_id, CAST(json_extract_string(props, '$.k') AS INT) AS progress, event_type AS status, ts,
        row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n_events FROM events)
    SELECT run_id, progress, status, ts, n_events FROM p WHERE rn = 1""",
)
def progress(t):
    raw = MO.metric_stream(t.spark, f"{t.sf_dir}/event[s].parquet", t.events.schema)
    p = raw.select(
        "event_id", "ts", F.col("user_id").alias("run_id"), F.from_json("props", "k int")["k"].alias("progress"),
        F.col("event_type").alias("status"),
    )
    return MO.run_progress(MO.drain(MO.run_updates(p), "progress", ["run_id", "span"]))


@query(
    "stream_event_deduplication",
    "SELECT DISTINCT sha256(user_id || ':' || event_type) AS idempotency_key FROM events",
)
def dedup(t):
    raw = MO.metric_stream(t.spark, f"{t.sf_dir}/event[s].parquet", t.events.schema)
    keyed = raw.select(
        "ts", F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), "event_type"), 256).alias("idempotency_key")
    )
    return MO.drain(MO.deduplicate(keyed), "dedup").select("idempotency_key")
