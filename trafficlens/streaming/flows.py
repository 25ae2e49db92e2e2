"""Structured Streaming forms of the request flow (S5 stream, T1-T4).

* T1 ``match_stream``: every micro-batch is matched with the batch operator
  (``foreachBatch``), so the registry-size check and the hash-join form work
  unchanged; output is written per batch id, so a retried batch overwrites
  itself (idempotent).
* T2 ``ttl_dedup_stream``: the live entries of each key are a table per batch
  id; a micro-batch is answered from them, and its other rows go through the
  batch operator W1.  Thus a batch may hold any number of rows of a key, in any
  order.  Entries that end before the watermark are dropped.
* T3 ``traffic_kpis_stream``: watermark + tumbling window x dependency; late
  rows beyond the watermark are dropped by Spark.  In append mode
  (``write_final``) each window is written once, when it is final, with a
  quantile sketch, and ``merge_windows`` adds windows up to longer ones.
* T4 ``upsert_stream``: ``foreachBatch`` -> S4 upsert into the persisted store,
  of which a batch rewrites only the buckets of its keys.  A retried batch
  finds its own rows and writes the same again.

T2's batch reads version N-1 of its state and writes version N, so a retried
batch finds what it found before; a version that should be there and cannot
be read is an error.  Versions before N-1 are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trafficlens import schemas
from trafficlens.operators import store as S
from trafficlens.operators.match import match_requests
from trafficlens.operators.ttl import ttl_dedup
from trafficlens.session import delete, list_names, path_exists


def read_requests_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """S5 (stream): request events from parquet files, oldest first; ts as TIMESTAMP (watermarks need it).

    A trigger takes all files that are there, or at most ``max_files_per_trigger``.
    """
    reader = spark.readStream.schema(schemas.REQUESTS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def _previous(spark: SparkSession, root: str, batch_id: int) -> str | None:
    """Path of the state that batch ``batch_id`` begins with; None only if there is no state at all."""
    versions = sorted(int(n[2:]) for n in list_names(spark, root) if n.startswith("v=") and n[2:].isdigit())
    before = [v for v in versions if v < batch_id]
    if batch_id > 0 and batch_id - 1 not in before:
        raise FileNotFoundError(f"{root}/v={batch_id - 1}: the state of the batch before is missing")
    if before:
        return f"{root}/v={before[-1]}"
    return f"{root}/start" if path_exists(spark, f"{root}/start") else None


def _forget(spark: SparkSession, root: str, batch_id: int) -> None:
    delete(spark, *[f"{root}/{n}" for n in list_names(spark, root)
                    if n.startswith("v=") and n[2:].isdigit() and int(n[2:]) < batch_id - 1])


def match_stream(stream: DataFrame, routes: DataFrame, out_path: str, checkpoint: str, strategy: str = "auto"):
    """Start a query that matches each micro-batch and writes it under out_path/batch=<id>."""
    def run(batch: DataFrame, batch_id: int) -> None:
        m = match_requests(batch, routes, strategy=strategy)
        m.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def dedup_batch(batch: DataFrame, entries: DataFrame | None, key: str, ttl_seconds: float | None) -> DataFrame:
    """W1 on a micro-batch, going on from the entries (key, start, stop) of the batches before.

    An entry answers from its start to its stop: the end of its time to live,
    or the instant before the key's next entry.  A request that no entry
    answers opens one, also if it is older than others of its key; what was
    answered before stays as it is, and no request is answered by an entry
    that begins after it.  Returns request_id, key, ts, hit, entry_created_at.
    """
    rows = batch.select("request_id", key, "ts")
    if entries is None:
        return ttl_dedup(rows, key, ttl_seconds=ttl_seconds)
    t = F.unix_micros("ts")
    if ttl_seconds is None or ttl_seconds <= 0:
        by, spans = F.lit(0).cast("long"), entries.withColumn("_b", F.lit(0).cast("long"))
    else:  # an entry lies in at most two buckets of a time to live each
        ttl = F.lit(int(round(ttl_seconds * 1_000_000)))
        by = F.floor(t / ttl).cast("long")
        at = lambda c: F.floor(F.col(c) / ttl).cast("long")
        spans = entries.withColumn("_b", F.explode(F.sequence(at("start"), at("stop"))))
    spans = spans.select(F.col(key).alias("_k"), "_b", "start", "stop")
    j = rows.withColumn("_t", t).withColumn("_c", by).join(
        spans, (F.col(key) == F.col("_k")) & (F.col("_c") == F.col("_b")) & (F.col("_t") >= F.col("start"))
        & (F.col("_t") <= F.col("stop")), "left").checkpoint()
    known = j.where(F.col("start").isNotNull()).select(
        "request_id", key, "ts", F.lit(True).alias("hit"), F.timestamp_micros("start").alias("entry_created_at"))
    fresh = ttl_dedup(j.where(F.col("start").isNull()).select("request_id", key, "ts"), key, ttl_seconds=ttl_seconds)
    return known.unionByName(fresh.select(*known.columns))


def live_entries(entries: DataFrame | None, answered: DataFrame, key: str, ttl_seconds: float | None,
                 watermark_us: int | None) -> DataFrame:
    """The entries (key, start, stop) after a batch, without those that end before the watermark."""
    opened = answered.where(~F.col("hit")).select(key, F.unix_micros("entry_created_at").alias("start"))
    every = opened if entries is None else opened.unionByName(entries.select(key, "start"))
    if ttl_seconds is None or ttl_seconds <= 0:  # the first entry of a key stays for ever
        return every.groupBy(key).agg(F.min("start").alias("start")).withColumn("stop", F.lit((1 << 63) - 1))
    ends = F.col("start") + F.lit(int(round(ttl_seconds * 1_000_000)))
    if watermark_us is not None:
        every = every.where(ends >= F.lit(watermark_us))
    # a key's live entries are few: they begin within a lateness and a time to live
    after = F.lead("start").over(Window.partitionBy(key).orderBy("start"))
    return every.distinct().withColumn("stop", F.least(ends, after - 1))


def ttl_dedup_stream(stream: DataFrame, key: str, ttl_seconds: float | None, out_path: str, state_path: str,
                     checkpoint: str, lateness_seconds: float = 86400):
    """Streaming W1 (request_id, key, hit, entry_created_at under out_path/batch=<id>).

    Equal to the batch operator when batches arrive in time order, whatever
    the order within them and however many rows a key has.  The watermark is
    the latest time of the batches before, less ``lateness_seconds``: older
    rows are not answered but written under out_path/_late/batch=<id>, and
    entries that ended before it leave the state.  Rows without a key or a
    time are left out, as they have no entry.
    """
    spark = stream.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        prev = _previous(spark, state_path, batch_id)
        entries, latest = None, None
        if prev is not None:
            entries = spark.read.parquet(f"{prev}/entries")
            latest = spark.read.parquet(f"{prev}/clock").first()["latest"]
        mark = None if latest is None else latest - int(round(lateness_seconds * 1_000_000))
        batch = batch.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).persist()
        old = F.lit(False) if mark is None else F.unix_micros("ts") < F.lit(mark)
        batch.where(old).select("request_id", key, "ts").write.mode("overwrite").parquet(f"{out_path}/_late/batch={batch_id}")
        got = dedup_batch(batch.where(~old), entries, key, ttl_seconds)
        whole = f"{out_path}/batch={batch_id}"
        got.select("request_id", key, "hit", "entry_created_at").write.mode("overwrite").parquet(whole)
        newest = batch.agg(F.max(F.unix_micros("ts"))).first()[0]
        now = max((x for x in (latest, newest) if x is not None), default=None)
        after = None if now is None else now - int(round(lateness_seconds * 1_000_000))
        state = f"{state_path}/v={batch_id}"
        live_entries(entries, spark.read.schema("request_id long, " + f"{key} {dict(got.dtypes)[key]}, hit boolean, "
                     "entry_created_at timestamp").parquet(whole), key, ttl_seconds, after).write.mode("overwrite").parquet(f"{state}/entries")
        spark.createDataFrame([(now,)], "latest long").write.mode("overwrite").parquet(f"{state}/clock")
        _forget(spark, state_path, batch_id)
        batch.unpersist()

    return (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


#: Accuracy of the stored sketches (larger is finer): rank errors of about 0.2 % at this size.
KLL_K = 1000


def traffic_kpis_stream(matched_stream: DataFrame, window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Per tumbling window and dependency: requests, unmatched, max and sum of latency, p50 / p95 (sketch)."""
    return (matched_stream.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("w"), "dependency")
            .agg(F.count(F.lit(1)).alias("requests"),
                 F.count(F.when(F.col("endpoint_path").isNull(), 1)).alias("unmatched"),
                 F.max("latency_ms").alias("max_latency_ms"),
                 F.sum("latency_ms").alias("sum_latency_ms"),
                 F.percentile_approx("latency_ms", [0.5, 0.95]).alias("_p"))
            .select(F.col("w.start").alias("window_start"), "dependency", "requests", "unmatched",
                    "max_latency_ms", "sum_latency_ms", F.col("_p")[0].alias("p50_latency_ms"),
                    F.col("_p")[1].alias("p95_latency_ms")))


def final_windows(matched: DataFrame, window: str = "1 hour", watermark: str | None = "1 day") -> DataFrame:
    """T3 with mergeable percentiles: window_start, dependency, requests, unmatched, max and sum of latency, ``sketch``
    (KLL).  On a stream in append mode a window comes once, after the watermark has passed its end; on a table
    (watermark None) all windows come."""
    rows = matched if watermark is None else matched.withWatermark("ts", watermark)
    return (rows.groupBy(F.window("ts", window).alias("w"), "dependency")
            .agg(F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("endpoint_path").isNull(), 1)).alias("unmatched"),
                 F.max("latency_ms").alias("max_latency_ms"), F.sum("latency_ms").alias("sum_latency_ms"),
                 F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), KLL_K).alias("sketch"))
            .select(F.col("w.start").alias("window_start"), "dependency", "requests", "unmatched", "max_latency_ms",
                    "sum_latency_ms", "sketch"))


def merge_windows(windows: DataFrame, window: str = "1 day") -> DataFrame:
    """``final_windows`` of a short window added up to a longer one (a multiple of it), with p50 and p95."""
    merged = (windows.groupBy(F.window("window_start", window)["start"].alias("window_start"), "dependency")
              .agg(F.sum("requests").alias("requests"), F.sum("unmatched").alias("unmatched"),
                   F.max("max_latency_ms").alias("max_latency_ms"), F.sum("sum_latency_ms").alias("sum_latency_ms"),
                   F.kll_merge_agg_double("sketch", KLL_K).alias("sketch")))
    at = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(q))
    return merged.select("window_start", "dependency", "requests", "unmatched", "max_latency_ms", "sum_latency_ms",
                         at(0.5).alias("p50_latency_ms"), at(0.95).alias("p95_latency_ms"))


def write_final(df: DataFrame, out_path: str, checkpoint: str):
    """Runs an append-mode aggregation: each window is written once (a file sink with exactly-once commits)."""
    return (df.writeStream.outputMode("append").format("parquet").option("path", out_path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def write_updates(df: DataFrame, out_path: str, checkpoint: str):
    """Run an update-mode aggregation, each batch's changed rows under out_path/batch=<id>."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return (df.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_updates(spark: SparkSession, out_path: str, keys: list[str]) -> DataFrame:
    """Final value per key from update-mode batch outputs (row of the highest batch id)."""
    df = spark.read.parquet(out_path)
    cols = [c for c in df.columns if c != "batch"]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in cols if c not in keys]), "batch").alias("_r"))
            .select(*keys, "_r.*"))


def upsert_stream(new_rows: DataFrame, store_root: str, checkpoint: str, ttl_seconds: float | None = 86400,
                  buckets: int = 16):
    """T4: keep a persisted store current; a batch reads and rewrites the buckets of its keys and no others.

    A batch that is tried again writes the rows it wrote before, which win by
    the same order, so the store ends up the same.
    """
    spark = new_rows.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        if not batch.isEmpty():
            S.upsert_persisted(spark, store_root, batch, ttl_seconds, batch_id=batch_id, buckets=buckets)
        batch.unpersist()

    return (new_rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def current_store(spark: SparkSession, store_root: str) -> DataFrame:
    """The store that T4 keeps."""
    return S.read_store(spark, store_root)


def stage_in_time_order(df: DataFrame, path: str, rows_per_file: int = 250_000, least_files: int = 8) -> int:
    """Writes a table as files that hold consecutive time ranges, in one parallel job, and dates the files in
    that order (a file stream reads the oldest first).  Returns the number of files, which follows from the data."""
    spark = df.sparkSession
    n = max(least_files, -(-df.count() // rows_per_file))
    df.repartitionByRange(n, "ts").sortWithinPartitions("ts").write.mode("overwrite").parquet(path)
    names = [x for x in list_names(spark, path) if x.startswith("part-")]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for i, name in enumerate(names):
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        at.getFileSystem(conf).setTimes(at, 1_600_000_000_000 + 1000 * i, -1)
    return len(names)
