"""Structured Streaming forms of the batch operators (ST-1..3).

The reference monitors "by lot" over slices of a sample; here the same work
runs on a real stream:

* ST-1 ``windowed_metrics``: event-time tumbling windows with a watermark;
  the streaming state holds only additive parts (confusion counts and
  positive / negative counts per score bucket), so AUC — which is not
  additive — is finished in batch from the bucket counts.
* ST-2 ``quality_stream``: the fused quality suite on every micro-batch via
  ``foreachBatch``, plus a stateless valid / quarantine split.
* ST-3 ``ingest_incremental``: file source with an explicit schema,
  ``trigger(availableNow=True)``; the checkpoint makes re-runs idempotent
  (files already ingested are not read again).

Sinks write per-batch folders keyed by ``batch_id`` with overwrite, so a
replayed micro-batch (after a failure) replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import quality as QC


def _commits(spark: SparkSession, checkpoint: str) -> int:
    """Micro-batches that the commit log of a streaming checkpoint holds."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/commits")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return 0
    ids = [int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()]
    return max(ids, default=-1) + 1  # old entries are cleaned up, ids go on


def ingest_incremental(spark: SparkSession, src: str, dst: str, schema, checkpoint: str,
                       fmt: str = "parquet", options: dict | None = None,
                       max_files_per_trigger: int | None = None, glob: str | None = None) -> dict:
    """ST-3: ingest whatever new files the folder ``src`` holds (optionally
    only names matching ``glob``), then stop.  Returns the number of input
    rows processed by this run."""
    from tessera.sources.files import path_exists_nonempty

    def written() -> int:  # from the footers
        return spark.read.schema(r.schema).parquet(dst).count() if path_exists_nonempty(spark, dst) else 0
    r = stream_source(spark, src, schema, fmt, max_files_per_trigger, glob, options)
    before, commits = written(), _commits(spark, checkpoint)
    q = (r.writeStream.format("parquet").option("checkpointLocation", checkpoint)
          .outputMode("append").trigger(availableNow=True).start(dst))
    q.awaitTermination()
    # the query remembers only its last progress reports; sink and commit log know all
    return {"rows": written() - before, "batches": _commits(spark, checkpoint) - commits}


def score_buckets(prob_col, n_buckets: int = 100):
    """Bucket of a probability in [0, 1]: ``floor(p * n)`` capped at n-1."""
    return F.least(F.floor(F.col(prob_col) * n_buckets), F.lit(n_buckets - 1)).cast("int")


def event_instant(col):
    """Event time as a TIMESTAMP instant (watermarks need it).  A
    TIMESTAMP_NTZ wall clock is read as UTC, whatever the session time zone,
    so windows align with the wall-clock days of the data."""
    c = F.col(col) if isinstance(col, str) else col
    return F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone())


def wall_clock(col):
    """Inverse of :func:`event_instant` for output: the UTC wall clock as
    TIMESTAMP_NTZ."""
    c = F.col(col) if isinstance(col, str) else col
    return F.from_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz")


def windowed_parts(stream: DataFrame, ts: str, size: str, watermark: str, label: str, pred: str,
                   prob: str, n_buckets: int = 100) -> DataFrame:
    """ST-1 streaming part: per (window, score bucket) additive counts."""
    y, p = F.col(label), F.col(pred)
    if dict(stream.dtypes).get(ts) == "timestamp_ntz":
        stream = stream.withColumn(ts, event_instant(ts))
    return (stream.withWatermark(ts, watermark)
            .groupBy(F.window(ts, size).alias("w"), score_buckets(prob, n_buckets).alias("bucket"))
            .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"),
                 F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                 F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"))
            .select(wall_clock("w.start").alias("window_start"), wall_clock("w.end").alias("window_end"),
                    "bucket", "pos", "neg", "tp", "fp", "tn", "fn"))


def finish_windowed_metrics(parts: DataFrame) -> DataFrame:
    """ST-1 batch part: metrics per window from the bucket counts; AUC with
    ties inside a bucket counted one half.  The cumulative window runs over
    at most ``n_buckets`` rows per window."""
    w = Window.partitionBy("window_start").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    d = parts.withColumn("nb", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    g = d.groupBy("window_start", "window_end").agg(
        F.sum(F.col("pos") * (F.col("nb") + F.col("neg") / 2.0)).alias("u"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")])
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def div0(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("u") / (F.col("P") * F.col("N"))).otherwise(0.5)
    return g.select("window_start", "window_end", (tp + fp + tn + fn).alias("n"), auc.alias("roc_auc"),
                    div0(2 * tp, 2 * tp + fp + fn).alias("f1"), div0(tp, tp + fn).alias("recall"),
                    div0(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def _batch_sink(path: str):
    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def windowed_metrics(spark: SparkSession, stream: DataFrame, ts: str, size: str, watermark: str,
                     label: str, pred: str, prob: str, sink: str, checkpoint: str,
                     n_buckets: int = 100) -> DataFrame:
    """ST-1: run the windowed aggregation to the end of the available input
    (update mode: each micro-batch emits the windows it changed), then finish
    the metrics from the latest version of every (window, bucket) row."""
    parts = windowed_parts(stream, ts, size, watermark, label, pred, prob, n_buckets)
    q = (parts.writeStream.outputMode("update").foreachBatch(_batch_sink(sink))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(sink)
    latest = Window.partitionBy("window_start", "bucket").orderBy(F.desc("batch_id"))
    out = out.withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r", "batch_id")
    return finish_windowed_metrics(out)


def quality_stream(spark: SparkSession, stream: DataFrame, suite: dict, sink: str, checkpoint: str) -> DataFrame:
    """ST-2: the quality suite per micro-batch (``checks/batch_id=n``) and the
    row split into ``valid/`` and ``quarantine/``.  Returns the checks of
    all batches processed by this run."""
    def per_batch(batch: DataFrame, batch_id: int):
        batch.persist()
        checks = QC.run_suite(batch, suite).withColumn("batch_id", F.lit(batch_id))
        checks.write.mode("overwrite").parquet(f"{sink}/checks/batch_id={batch_id}")
        valid, bad = QC.split_valid(batch, QC.row_rules_from_suite(suite, batch))
        valid.write.mode("overwrite").parquet(f"{sink}/valid/batch_id={batch_id}")
        bad.write.mode("overwrite").parquet(f"{sink}/quarantine/batch_id={batch_id}")
        batch.unpersist()
    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{sink}/checks")


def stream_source(spark: SparkSession, folder: str, schema, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None, glob: str | None = None,
                  options: dict | None = None) -> DataFrame:
    """A file stream over ``folder`` with an explicit schema; ``glob``
    restricts it to matching file names."""
    r = spark.readStream.schema(schema).format(fmt).options(**(options or {}))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(folder)

