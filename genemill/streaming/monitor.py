"""Structured Streaming jobs over metric rows (event_id, ts, host, metric, value).

The same functions work on a static DataFrame. Keyed state comes in two steps: a stream of updates by key and
time span (`*_updates`), and a read of the updates that merges the spans of a key.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits above which a metric raises an alert, and its severity.
THRESHOLDS = {
    "cpu": (80.0, "warning"),
    "memory": (85.0, "warning"),
    "disk": (90.0, "critical"),
}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder of the cluster; a temporary one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="genemill-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def metric_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New metric files of a folder (or glob) as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def alerts(metrics: DataFrame) -> DataFrame:
    """Stateless rules: one row per broken limit."""
    found = []
    for name, (limit, severity) in THRESHOLDS.items():
        hit = (F.col("metric") == name) & (F.col("value") > limit)
        found.append(
            F.when(
                hit,
                F.struct(
                    F.lit(f"{name}_high").alias("alert"), F.lit(severity).alias("severity"), F.lit(limit).alias("limit")
                ),
            )
        )
    for name, severity in (("database", "critical"), ("redis", "warning")):
        down = (F.col("metric") == name) & (F.col("value") <= 0)
        found.append(
            F.when(
                down,
                F.struct(
                    F.lit(f"{name}_unhealthy").alias("alert"), F.lit(severity).alias("severity"), F.lit(0.0).alias("limit")
                ),
            )
        )
    a = F.explode(F.array_compact(F.array(*found))).alias("a")
    return metrics.select("event_id", "ts", "host", "value", a).select(
        "event_id", "ts", "host", "value", "a.alert", "a.severity", "a.limit"
    )


def health_of(value: Column) -> Column:
    return F.when(value > 90, "critical").when(value > 80, "warning").otherwise("healthy")


def spans(rows: DataFrame, keys: list[str], ttl: str | None, *aggs: Column) -> DataFrame:
    """Aggregates by key and by time span of length `ttl`: the keyed state of a stream.

    A span leaves the state once the newest event is a span length past its end, so the state holds the
    keys of the last two spans only; the table of updates keeps what it was. Rows later than that are
    dropped. Without `ttl` all of a key is one span and nothing is dropped or evicted. Rows without a time
    belong to no span and are left out.
    """
    t = rows.withColumn("_t", F.col("ts").cast("timestamp")).filter(F.col("_t").isNotNull())
    if ttl is None:
        return t.groupBy(*keys, F.lit(0).cast("timestamp").alias("span")).agg(*aggs)
    g = t.withWatermark("_t", ttl).groupBy(*keys, F.window("_t", ttl).alias("_w")).agg(*aggs)
    return g.withColumn("span", F.col("_w.start")).drop("_w")


def health_updates(metrics: DataFrame, ttl: str | None = "30 days") -> DataFrame:
    """Newest value per host and span; ties in time go to the larger event_id."""
    newest = F.max_by(F.struct("ts", "event_id", "metric", "value"), F.struct("ts", "event_id")).alias("m")
    return spans(metrics, ["host"], ttl, newest)


def latest_health(updates: DataFrame) -> DataFrame:
    """Newest value per host over its spans, and its state."""
    m = F.max_by("m", F.struct("m.ts", "m.event_id")).alias("m")
    g = updates.groupBy("host").agg(m)
    return g.select("host", "m.ts", "m.metric", "m.value", health_of(F.col("m.value")).alias("health"))


def hourly(metrics: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly mean, maximum and count per metric; rows later than the watermark are dropped."""
    m = metrics.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = m.groupBy(F.window("ts", "1 hour"), "metric").agg(
        F.avg("value").alias("mean"), F.max("value").alias("max"), F.count(F.lit(1)).alias("n")
    )
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "metric", "mean", "max", "n")


def with_day(metrics: DataFrame) -> DataFrame:
    """Rows with the day they are filed under."""
    return metrics.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


def history(metrics: DataFrame, until: str, hours: int = 24) -> DataFrame:
    """Rows of the last hours up to a moment, oldest first.

    Of a table filed by `day` only the days of the window are read.
    """
    end = F.lit(until).cast("timestamp_ntz")
    start = end - F.make_dt_interval(F.lit(0), F.lit(hours))
    rows = metrics
    if "day" in metrics.columns:
        first, last = (F.date_format(c, "yyyy-MM-dd") for c in (start, end))
        rows = metrics.filter((F.col("day") >= first) & (F.col("day") <= last)).drop("day")
    return rows.filter((F.col("ts") >= start) & (F.col("ts") <= end)).orderBy("ts", "event_id")


def alert_updates(alert_rows: DataFrame, resolutions: DataFrame, ttl: str | None = "30 days") -> DataFrame:
    """State by (event_id, alert): the alert as raised, and whether a resolution (event_id, alert, ts) came.

    Either may come first, and they may be any time apart: they meet when the updates are read.
    """
    payload = ("ts", "host", "value", "severity", "limit")
    raised = alert_rows.select(
        "event_id", "alert", "ts", F.struct(*payload).alias("raised"), F.lit(False).alias("resolved")
    )
    done = resolutions.select(
        "event_id", "alert", "ts", F.lit(None).cast(raised.schema["raised"].dataType).alias("raised"),
        F.lit(True).alias("resolved"),
    )
    return spans(
        raised.unionByName(done), ["event_id", "alert"], ttl,
        F.max("raised").alias("raised"), F.bool_or("resolved").alias("resolved"),
    )


def active_alerts(updates: DataFrame, limit: int | None = None) -> DataFrame:
    """Alerts raised and not resolved, newest first."""
    g = updates.groupBy("event_id", "alert").agg(
        F.max("raised").alias("raised"), F.bool_or("resolved").alias("resolved")
    )
    out = g.filter(F.col("raised").isNotNull() & ~F.col("resolved")).select("event_id", "alert", "raised.*")
    out = out.orderBy(F.col("ts").desc(), F.col("event_id").desc(), "alert")
    return out if limit is None else out.limit(limit)


def run_updates(events: DataFrame, ttl: str | None = "30 days") -> DataFrame:
    """Newest progress and number of events of each run and span."""
    newest = F.max_by(F.struct("ts", "event_id", "progress", "status"), F.struct("ts", "event_id")).alias("p")
    return spans(events, ["run_id"], ttl, newest, F.count(F.lit(1)).alias("n"))


def run_progress(updates: DataFrame) -> DataFrame:
    """Latest progress and status of each run over its spans."""
    g = updates.groupBy("run_id").agg(
        F.max_by("p", F.struct("p.ts", "p.event_id")).alias("p"), F.sum("n").alias("n_events")
    )
    return g.select("run_id", "p.progress", "p.status", "p.ts", "n_events")


def deduplicate(events: DataFrame, key: str = "idempotency_key", late: str | None = None) -> DataFrame:
    """One delivery per key for all time, or within `late` if it is given (which bounds the state)."""
    if late is None:
        return events.dropDuplicates([key])
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _children(spark: SparkSession, folder: str) -> list[str]:
    """Names of finished tables in a folder: those whose write was committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [f.getPath() for f in fs.listStatus(path) if f.isDirectory()]
    mark = spark._jvm.org.apache.hadoop.fs.Path
    return [f.getName() for f in found if fs.exists(mark(f, "_SUCCESS"))]


def _number(name: str) -> int:
    return int(name.rsplit("=", 1)[1])


def current(spark: SparkSession, out: str, keys: list[str], schema) -> DataFrame:
    """The newest row of each key in a table of updates: the last base and the batches after it."""
    bases = [_number(n) for n in _children(spark, f"{out}/base")]
    upto = max(bases, default=-1)
    batches = [n for n in _children(spark, f"{out}/log") if _number(n) > upto]
    parts = [f"{out}/base/upto={upto}"] if bases else []
    rows = spark.createDataFrame([], schema).withColumn("_n", F.lit(-1).cast("bigint"))
    if parts:
        rows = rows.unionByName(spark.read.schema(schema).parquet(*parts).withColumn("_n", F.lit(upto).cast("bigint")))
    if batches:
        log = spark.read.schema(schema).parquet(*[f"{out}/log/{n}" for n in batches])
        number = F.regexp_extract(F.col("_metadata.file_path"), "/log/batch=([0-9]+)/", 1).cast("bigint")
        rows = rows.unionByName(log.withColumn("_n", number))
    rest = [c for c in schema.names if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_n").alias("_r"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in schema.names])


def keep_updates(out: str, keys: list[str], base_every: int = 64):
    """Writer of micro-batches: each batch into the folder of its number.

    A batch that is repeated after a failure overwrites its own folder and nothing else. Readers see folders
    with a committed write only. Every `base_every` batches what is current is written as a new base, so a
    reader never opens more batches than that.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out}/log/batch={batch_id}")
        if (batch_id + 1) % base_every == 0:
            current(spark, out, keys, batch.schema).write.mode("overwrite").parquet(f"{out}/base/upto={batch_id}")

    return write


def drain(
    stream: DataFrame, name: str, keys: list[str] | None = None, path: str | None = None,
    partition: str | None = None, base_every: int = 64,
) -> DataFrame:
    """Run a stream over what is there now, and read back what it wrote so far.

    Without `keys` the stream appends to a parquet sink with exactly-once files, filed by `partition` if
    given. With `keys` it writes only the rows that changed, and the newest row of each key is read back.
    State is kept in RocksDB, on the disks of the executors and in the checkpoint. With the same `path` a
    later call goes on where the last one ended, also after a failure in the middle of a batch.
    """
    spark = stream.sparkSession
    path = path or scratch(spark, name)
    out, state = f"{path}/out", f"{path}/state"
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if keys is None:
        writer = writer.outputMode("append").format("parquet").option("path", out)
        if partition:
            writer = writer.partitionBy(partition)
    else:
        writer = writer.outputMode("update").foreachBatch(keep_updates(out, keys, base_every))
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        query = writer.start()
    finally:
        spark.conf.set(_PROVIDER, before)
    query.awaitTermination()
    if keys is not None:
        return current(spark, out, keys, stream.schema)
    target = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(out)
