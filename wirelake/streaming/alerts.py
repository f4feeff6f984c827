"""An alert feed over the live detectors: one alert for an attack, however many windows it lasts.

A detector's rows become detections (severity, category, at, host, description). A feed folds the detections of a host,
each at most `gap` after the one before, into one alert: opened by the first, repeated by the others, closed once
the detector has found something more than `gap` after its last.

The sink is `foreachBatch` and idempotent by batch number: micro-batch n writes the folder `batch=n` with every alert
that it opened, repeated or closed or that stays open, made of its detections and the open alerts of `batch=n-1`. A
micro-batch that was killed writes the same folder again. Its detections are made once and held on disk while they are
folded: to make them again would run the detector's state a second time, beside the first. Detectors report closed
windows in order of time, so an alert does not depend on how packets fall into micro-batches.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from wirelake.functions.windows import window_micros

SCHEMA = ("severity string, category string, host string, opened_at timestamp_ntz, last_at timestamp_ntz, detections bigint, "
          "description string, status string, event string")


def as_alerts(detected: DataFrame, severity: str, category: str, at: str, host: str, description: Column) -> DataFrame:
    """Rows of a detector as detections: severity, category, at (time or window start), host, description."""
    return detected.select(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.col(at).alias("at"),
                           F.col(host).alias("host"), description.alias("description"))


def _text(*parts: str | Column) -> Column:
    return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def port_scan_alerts(scans: DataFrame) -> DataFrame:
    """Detections of `live_port_scans`."""
    return as_alerts(scans, "high", "Port Scan", "window_start", "scanner_ip", _text(F.col("unique_ports"), "ports of", F.col("target_ip")))


def host_scan_alerts(scans: DataFrame) -> DataFrame:
    """Detections of `live_host_scans`."""
    return as_alerts(scans, "high", "Host Scan", "window_start", "src_ip", _text(F.col("unique_hosts"), "hosts on port", F.col("dst_port")))


def syn_flood_alerts(floods: DataFrame) -> DataFrame:
    """Detections of `live_syn_flood`."""
    return as_alerts(floods, "critical", "SYN Flood", "window_start", "src_ip", _text(F.col("syn_count"), "SYN packets"))


def udp_flood_alerts(floods: DataFrame) -> DataFrame:
    """Detections of `live_udp_flood`."""
    return as_alerts(floods, "high", "UDP Flood", "window_start", "src_ip", _text(F.col("packet_count"), "UDP packets"))


def dns_tunneling_alerts(queries: DataFrame) -> DataFrame:
    """Detections of `live_dns_tunneling`."""
    return as_alerts(queries, "high", "DNS Tunneling", "window_start", "src_ip",
                     _text(F.col("queries"), "queries, the longest of", F.col("longest"), "characters"))


def arp_alerts(changes: DataFrame) -> DataFrame:
    """Detections of `live_arp_changes`."""
    return as_alerts(changes, "high", "ARP Spoofing", "changed_at", "ip_address", _text(F.col("old_mac"), "to", F.col("new_mac")))


def folded(before: DataFrame, detections: DataFrame, gap: int) -> DataFrame:
    """Alerts (columns of SCHEMA) of open alerts and newer detections; `gap` in microseconds."""
    old = before.where("status = 'open'").select(
        "severity", "category", "host", "opened_at", "last_at", "detections", "description", F.lit(True).alias("known"))
    new = detections.where(F.col("host").isNotNull()).select(
        "severity", "category", "host", F.col("at").alias("opened_at"), F.col("at").alias("last_at"),
        F.lit(1).cast("bigint").alias("detections"), "description", F.lit(False).alias("known"))
    micros = lambda c: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")
    order = Window.partitionBy("category", "host").orderBy("opened_at", "last_at", "description")
    before_it = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = old.unionByName(new).withColumn("fresh", F.coalesce(
        micros("opened_at") - F.max(micros("last_at")).over(before_it) > gap, F.lit(True)).cast("int"))
    alerts = rows.withColumn("number", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))) \
        .groupBy("category", "host", "number").agg(
            F.min("severity").alias("severity"), F.min("opened_at").alias("opened_at"), F.max("last_at").alias("last_at"),
            F.sum("detections").alias("detections"), F.min(F.struct("opened_at", "description")).alias("first"),
            F.bool_or("known").alias("known"), F.bool_or(~F.col("known")).alias("met"))
    newest = alerts.groupBy("category").agg(F.max("last_at").alias("newest"))
    closed = micros("newest") - micros("last_at") > gap
    event = F.when(closed, "closed").when(~F.col("known"), "opened").when(F.col("met"), "repeated").otherwise("open")
    return alerts.join(newest, "category").select(
        "severity", "category", "host", "opened_at", "last_at", "detections", F.col("first.description").alias("description"),
        F.when(closed, "closed").otherwise("open").alias("status"), event.alias("event"))


def store(batch: DataFrame, number: int, folder: str, gap: str = "10m") -> None:
    """Writes `batch=number` under `folder` from the detections of a micro-batch; the same again if it is run again."""
    spark = batch.sparkSession
    reader = spark.read.schema(SCHEMA)
    before = reader.parquet(f"{folder}/batch={number - 1}") if number else spark.createDataFrame([], SCHEMA)
    held = batch.persist(StorageLevel.DISK_ONLY)
    try:
        held.count()  # all of it, before folding reads it in two places at a time
        folded(before, held, window_micros(gap)).write.mode("overwrite").parquet(f"{folder}/batch={number}")
    finally:
        held.unpersist()


def write_feed(detections: DataFrame, folder: str, checkpoint: str, gap: str = "10m", every: str | None = None) -> StreamingQuery:
    """Starts a query that keeps the alerts of one detector under `folder`; without `every` it takes what is there and stops."""
    writer = detections.writeStream.outputMode("append").option("checkpointLocation", checkpoint) \
        .foreachBatch(lambda batch, number: store(batch, number, folder, gap))
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def events(spark: SparkSession, folder: str) -> DataFrame:
    """What happened to alerts, by micro-batch: rows of SCHEMA with `batch`, event being opened, repeated or closed."""
    return spark.read.schema(f"{SCHEMA}, batch bigint").parquet(folder).where("event <> 'open'")


def alerts(spark: SparkSession, *folders: str) -> DataFrame:
    """The alerts of feeds as they stand: severity, category, host, opened_at, last_at, detections, description, status."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")][:-1]
    key, value = ["category", "host", "opened_at"], [c for c in columns if c not in ("category", "host", "opened_at")]
    parts = [spark.read.schema(f"{SCHEMA}, batch bigint").parquet(f) for f in folders]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy(*key).agg(F.max_by(F.struct(*value), "batch").alias("x")).select(*key, "x.*").select(*columns)
