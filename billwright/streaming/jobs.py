"""Session expiry, task state and continuous hardening."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from billwright import rules
from billwright.operators.hardening import name_key, new_products
from billwright.operators.ordering import with_edges
from billwright.streaming.state import HELD, ExpiringSessions, FirstDiscovery, use_state_store

_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def session_gaps(events, gap_seconds=7200, block=None):
    """Events with their session number per key; a gap longer than the limit starts a new one.

    ``events``: session_id, ts, event_id, kind, ref. Session ids are cut by day, so no
    single task has to walk all of a busy one.
    """
    day = F.to_date("ts") if block is None else block
    us, limit = F.unix_micros("ts"), gap_seconds * 1_000_000
    order = Window.partitionBy("session_id", "_block").orderBy("ts", "event_id")
    rows = events.withColumn("_block", day)
    opened = rows.withColumn("_new", F.coalesce((us - F.lag(us).over(order) > limit).cast("int"), F.lit(0)))
    counted = opened.withColumn("_local", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # A block starts a session of its own unless its first event follows the last one before it closely enough.
    totals = counted.groupBy("session_id", "_block").agg(F.min(us).alias("_first"), F.max(us).alias("_last"), F.sum("_new").alias("_inner"))
    along = Window.partitionBy("session_id").orderBy("_block")
    opens = F.coalesce((F.col("_first") - F.lag("_last").over(along) > limit).cast("int"), F.lit(1))
    before = F.coalesce(F.sum("_inner").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.withColumn("_opens", opens).withColumn("_offset", F.sum("_opens").over(along.rowsBetween(Window.unboundedPreceding, 0)) + before)
    further = offsets.where("_offset <> 1")
    first = F.coalesce("_offset", F.lit(1))
    return with_edges(counted, ["session_id"], further, "_offset").withColumn("session_no", F.col("_local") + first).drop("_block", "_new", "_local", "_offset")


def expired_sessions(events, gap_seconds=7200, **kw):
    """One row per session: span, events, distinct files and blobs to delete (T1, batch)."""
    gap = F.expr(f"make_dt_interval(0, 0, 0, {gap_seconds})")
    kinds = lambda k: F.count_distinct(F.when(F.col("kind") == k, F.col("ref")))
    return (
        session_gaps(events, gap_seconds, **kw)
        .groupBy("session_id", "session_no")
        .agg(
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.count(F.lit(1)).alias("events"),
            kinds("file").alias("files"),
            kinds("blob").alias("blobs"),
        )
        .withColumn("expires_at", F.col("last_ts") + gap)
    )


def expired_refs(events, gap_seconds=7200, **kw):
    """What to delete, one row per session and file or blob (T1, batch)."""
    return session_gaps(events, gap_seconds, **kw).select("session_id", "session_no", "kind", "ref").distinct()


def session_stream(events, gap=rules.SESSION_GAP, watermark=None):
    """Expired sessions of a stream, emitted once the watermark passes the gap.

    State per open session is its span and a count. The files and blobs are not kept in state:
    ``refs_of`` reads them from the stored activity log once the session has expired.
    """
    return (
        events.withWatermark("ts", watermark or gap)
        .groupBy(F.session_window("ts", gap).alias("w"), "session_id")
        .agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts"))
        .select("session_id", F.col("w.start").alias("first_ts"), "last_ts", F.col("w.end").alias("expires_at"), "events")
    )


def refs_of(sessions, log):
    """Distinct files and blobs of expired sessions from the activity log."""
    span = (F.col("l.ts") >= F.col("s.first_ts")) & (F.col("l.ts") <= F.col("s.last_ts"))
    return (
        sessions.alias("s")
        .join(log.alias("l"), (F.col("s.session_id") == F.col("l.session_id")) & span)
        .select("s.session_id", "s.first_ts", "l.kind", "l.ref")
        .distinct()
    )


def latest_tasks(events):
    """Latest state of each task: the last write wins, even after a cancel (T2). Batch or update-mode stream."""
    row = F.struct("status", "progress", "stage", "ts")
    order = F.struct("ts", "event_id") if "event_id" in events.columns else F.col("ts")
    return events.groupBy("task_id").agg(F.max_by(row, order).alias("s")).select("task_id", "s.*")


def expiring_sessions(events, gap_seconds=7200, delay=rules.SESSION_GAP, held=HELD):
    """What to delete, one row per expired session and file or blob, sent as soon as the watermark passes the expiry.

    The keyed state holds the files and blobs of open sessions, so nothing is read again; ``held``: as many stay with the spans of an id. Events behind the watermark belong to
    no session; they come out as rows of their own with ``late`` set, to be counted or kept. Null session ids are an id like others.
    """
    use_state_store(events.sparkSession)
    # Without the watermarked column the engine passes late events on to the operator instead of dropping them unseen.
    rows = events.withWatermark("ts", delay).select("session_id", F.unix_micros("ts").alias("us"), "kind", "ref")
    kind = rows.schema["session_id"].dataType.simpleString()
    found = rows.groupBy("session_id").transformWithState(
        ExpiringSessions(gap_seconds, held), f"session_id {kind}, first long, last long, events long, kind string, ref string, late boolean", "append", "eventTime"
    )
    return found.select(
        "session_id", F.timestamp_micros("first").alias("first_ts"), F.timestamp_micros("last").alias("last_ts"),
        F.timestamp_micros(F.col("last") + gap_seconds * 1_000_000).alias("expires_at"), "events", "kind", "ref", "late",
    )


def _tier():
    return F.coalesce(F.nullif(F.lower("tier"), F.lit("")), F.lit("mid"))


def first_discoveries(discoveries, delay="1 hour", remember_seconds=86400):
    """Of all discoveries of a product (brand, tier, model) the one that arrived first by ``seq``, whatever the micro-batches.

    A product waits in keyed state until the watermark passes the event time of its least row; repeats within ``remember_seconds`` are dropped.
    """
    use_state_store(discoveries.sparkSession)
    key = [name_key("brand").alias("_b"), _tier().alias("_t"), name_key("model").alias("_m")]
    own = F.to_json(F.struct(*discoveries.columns), _MICROS).alias("row")
    rows = discoveries.withWatermark("ts", delay).select(*key, F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), own)
    first = rows.groupBy("_b", "_t", "_m").transformWithState(FirstDiscovery(remember_seconds), "row string", "append", "eventTime")
    return first.select(F.from_json("row", discoveries.schema, _MICROS).alias("d")).select("d.*")


def harden_batches(discoveries, catalog_path, brands=None, delay=None):
    """Continuous hardening: appends the products the catalog does not have, with all their columns.

    Of several rows of one product the least ``seq`` of its micro-batch stays; the products of earlier batches are found in the
    stored catalog, of which only the tiers that occur in the batch are read. With ``delay`` arrival
    order also holds across micro-batches (``first_discoveries``). With ``brands`` (name) products of unknown brands are left
    out. The catalog is partitioned by tier and batch; writing a batch's own partitions keeps a replayed
    batch from writing twice.
    """
    spark = discoveries.sparkSession
    arriving = discoveries if delay is None else first_discoveries(discoveries, delay)

    def append(batch, batch_id):
        batch = batch.withColumn("tier", _tier())
        tiers = [r["tier"] for r in batch.select("tier").distinct().collect()]  # a handful of names
        catalog = spark.read.parquet(catalog_path).where(F.col("tier").isin(tiers) & (F.col("batch_id") != batch_id))
        if brands is not None:
            known = brands.select(name_key("name").alias("_known")).distinct()
            batch = batch.join(known, name_key("brand") == F.col("_known"), "left_semi")
        fresh = new_products(batch, catalog.select("brand", "tier", "model"))
        out = fresh.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        (
            out.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("tier", "batch_id")
            .parquet(catalog_path)
        )

    return arriving.writeStream.foreachBatch(append)
