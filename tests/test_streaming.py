import random
import tempfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from billwright.streaming import jobs
from billwright.streaming.state import ExpiringSessions

EVENTS = [
    ("s1", "2024-01-01 00:00:00", 1, "file", "a"), ("s1", "2024-01-01 02:00:00", 2, "file", "a"), ("s1", "2024-01-01 04:00:01", 3, "blob", "b"),
    ("s2", "2024-01-01 01:00:00", 4, "file", "c"),
]
SCHEMA = "session_id string, ts timestamp, event_id long, kind string, ref string"


def events(spark, extra=()):
    rows = [*EVENTS, *extra]
    return spark.createDataFrame(rows, "session_id string, t string, event_id long, kind string, ref string").select(
        "session_id", F.col("t").cast("timestamp").alias("ts"), "event_id", "kind", "ref"
    )


def folder(df):
    path = tempfile.mkdtemp(prefix="spark-") + "/in"
    df.write.parquet(path)
    return path


def run(query):
    q = query.option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_session_stream_equals_batch(spark):
    # A closing event of another session moves the watermark past every gap.
    df = events(spark, [("end", "2024-01-02 00:00:00", 9, "file", "z"), ])
    stream = spark.readStream.schema(SCHEMA).parquet(folder(df))
    run(jobs.session_stream(stream).writeStream.format("memory").queryName("expired").outputMode("append"))
    got = {(r["session_id"], str(r["first_ts"]), r["events"]) for r in spark.table("expired").collect()}
    batch = jobs.expired_sessions(df).where("session_id <> 'end'")
    want = {(r["session_id"], str(r["first_ts"]), r["events"]) for r in batch.collect()}
    assert got == want and len(got) == 3
    refs = jobs.refs_of(spark.table("expired"), df).where("session_id = 's1'").select("kind", "ref").collect()
    assert sorted(map(tuple, refs)) == [("blob", "b"), ("file", "a")]


def in_files(spark, rows, schema, per_file):
    """A folder whose files a stream reads one by one, in this order."""
    path = tempfile.mkdtemp(prefix="spark-") + "/in"
    for i in range(0, len(rows), per_file):
        spark.createDataFrame(rows[i : i + per_file], schema).coalesce(1).write.mode("append").parquet(path)
    return path


def one_by_one(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def stream_rows(spark, frame, name):
    run(frame.writeStream.format("memory").queryName(name).outputMode("append"))
    return spark.table(name).collect()


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_eager_expiry_equals_batch(spark, partitions):
    r, rows = random.Random(3), []
    for i in range(400):
        minute = i * 5 + r.randrange(-40, 40)  # out of order by less than the delay
        rows.append((f"s{r.randrange(5)}" if r.random() < 0.9 else None, f"2024-01-01 00:00:00.{r.randrange(1000):03d}", i, r.choice(["file", "blob"]), r.choice([None, "a", "b", "c"]), minute))
    df = spark.createDataFrame(rows, "session_id string, t string, event_id long, kind string, ref string, m int").select(
        "session_id", (F.col("t").cast("timestamp") + F.make_interval(mins="m")).alias("ts"), "event_id", "kind", "ref"
    )
    end = [("end", "2024-02-01 00:00:00", 9, "file", "z")]
    parts = [*(tuple(x) for x in df.orderBy("event_id").collect())]
    path = in_files(spark, parts, SCHEMA, 90)
    spark.createDataFrame(end, "session_id string, t string, event_id long, kind string, ref string").select("session_id", F.col("t").cast("timestamp").alias("ts"), "event_id", "kind", "ref").coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = stream_rows(spark, jobs.expiring_sessions(one_by_one(spark, path, SCHEMA), 1200), f"expiring{partitions}")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = sorted(((x["session_id"], x["first_ts"], x["last_ts"], x["expires_at"], x["events"], x["kind"], x["ref"]) for x in found if not x["late"]), key=str)
    both = jobs.expired_sessions(df, 1200).alias("s").join(jobs.expired_refs(df, 1200).alias("r"), F.expr("s.session_id <=> r.session_id and s.session_no = r.session_no"))
    want = sorted(map(tuple, both.select("s.session_id", "first_ts", "last_ts", "expires_at", "events", "r.kind", "r.ref").collect()), key=str)
    assert got == want and len({x[:2] for x in got}) > 20


class _State:
    """Stands in for the state of one id and counts the calls."""

    def __init__(self):
        self.calls, self.value, self.entries, self.timers = 0, None, {}, set()

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, *schemas):
        return self

    def __getattribute__(self, name):
        if not name.startswith(("_", "calls", "value", "entries", "timers", "get")) or name == "get":
            self.calls += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def updateValue(self, key, value):
        self.entries[key] = value

    def containsKey(self, key):
        return key in self.entries

    def removeKey(self, key):
        del self.entries[key]

    def keys(self):
        return iter(list(self.entries))

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def _expired(processor, batches):
    """What the sessions of one id give when each batch of (second, ref) arrives at watermark 0 and all expire at the end, and the state."""
    state = _State()
    processor.init(state)
    for batch in batches:
        assert not list(processor.handleInputRows(("s",), iter([Row(us=1 + s * 1_000_000, kind="file", ref=x) for s, x in batch]), _At(0)))
    out = []
    while state.timers:
        at = min(state.timers)
        out += processor.handleExpiredTimer(("s",), _At(10**12), None)
        state.timers.discard(at)
    assert state.value is None and not state.entries
    return sorted((x.first, x.last, x.events, x.ref) for x in out), state.calls


def test_calls_on_the_state_do_not_grow_with_the_events():
    """A session of many files, and many sessions, cost an id a fixed number of calls."""
    for step in (10, 8000):
        few, many = (_expired(ExpiringSessions(7200), [[(1 + i * step, f"r{i}") for i in range(n)]]) for n in (10, 1000))
        assert len(few[0]) == 10 and len(many[0]) == 1000
        assert many[1] == few[1] < 20


@pytest.mark.parametrize("held", [0, 3, 4000])
def test_sessions_are_the_same_however_much_is_held(held):
    """Out of order, with sessions that a later event joins, over several micro-batches."""
    r = random.Random(held)
    rows = [(1 + r.randrange(400) * 40, f"r{r.randrange(9)}") for _ in range(300)]
    got, _ = _expired(ExpiringSessions(60, held), [rows[i : i + 70] for i in range(0, 300, 70)])
    want, sessions = [], []
    for s, x in sorted(rows):
        if not sessions or s - sessions[-1][-1][0] > 60:
            sessions.append([])
        sessions[-1].append((s, x))
    for own in sessions:
        want += [(1 + own[0][0] * 1_000_000, 1 + own[-1][0] * 1_000_000, len(own), x) for x in {x for _, x in own}]
    assert got == sorted(want) and len(sessions) > 20


def test_late_rows_come_out_on_their_own(spark):
    rows = [("a", "2024-01-01 00:00:00"), ("b", "2024-01-02 00:00:00"), ("a", "2024-01-01 00:30:00"), ("c", "2024-01-01 05:00:00"), ("d", "2024-01-03 00:00:00")]
    frame = spark.createDataFrame([(s, t, i, "file", "x") for i, (s, t) in enumerate(rows)], "session_id string, t string, event_id long, kind string, ref string").select("session_id", F.col("t").cast("timestamp").alias("ts"), "event_id", "kind", "ref")
    path = in_files(spark, [tuple(x) for x in frame.orderBy("event_id").collect()], SCHEMA, 1)
    found = stream_rows(spark, jobs.expiring_sessions(one_by_one(spark, path, SCHEMA)), "late")
    assert sorted((x["session_id"], x["events"], x["late"]) for x in found) == [("a", 1, False), ("a", 1, True), ("b", 1, False), ("c", 1, True)]


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_first_discovery_by_arrival_number(spark, partitions):
    """The least number wins although its row comes in a later micro-batch; repeats of released products stay away."""
    schema = "brand string, tier string, model string, seq int, price double, ts timestamp"
    rows = [("Arper", "high", f"M{i % 7}", 100 - i, float(i), f"2024-01-01 00:{i:02d}:00") for i in range(40)]
    rows += [("Arper", "", "M0", 1, -1.0, "2024-01-01 00:45:00"), ("arper ", "MID", "m0", 2, -2.0, "2024-01-01 00:45:00"), ("z", "high", "end", 9, 0.0, "2024-01-02 00:00:00")]
    rows += [("z", "high", "end", 10, 0.0, "2024-01-02 00:05:00")] * 24  # batches between the release and the repeat
    rows += [("Arper", "high", "M1", 0, -3.0, "2024-01-02 00:10:00"), ("z", "high", "last", 9, 0.0, "2024-01-02 10:00:00")]
    frame = spark.createDataFrame([(*x[:5], i, x[5]) for i, x in enumerate(rows)], "brand string, tier string, model string, seq int, price double, i int, t string")
    typed = frame.orderBy("i").select("brand", "tier", "model", "seq", "price", F.col("t").cast("timestamp").alias("ts")).collect()
    path = in_files(spark, [tuple(x) for x in typed], schema, 11)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = stream_rows(spark, jobs.first_discoveries(one_by_one(spark, path, schema)), f"first{partitions}")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    best = {}
    for b, t, m, seq, price, _ in rows[:-2]:
        k = (b.strip().lower(), t.lower() or "mid", m.strip().lower())
        best[k] = min(best.get(k, (seq, price)), (seq, price))
    assert {(x["brand"].strip().lower(), x["tier"].lower() or "mid", x["model"].lower()): (x["seq"], x["price"]) for x in found} == best
    assert len(found) == len(best)


def test_latest_task_batch_and_stream(spark):
    rows = [("t", "2024-01-01 00:00:00", "pending", 0), ("t", "2024-01-01 00:00:05", "cancelled", 10), ("t", "2024-01-01 00:00:09", "processing", 20)]
    df = spark.createDataFrame(rows, "task_id string, t string, status string, progress int").select(
        "task_id", "status", "progress", F.lit("").alias("stage"), F.col("t").cast("timestamp").alias("ts")
    )
    assert jobs.latest_tasks(df).first()["status"] == "processing"
    stream = spark.readStream.schema(df.schema).parquet(folder(df))
    run(jobs.latest_tasks(stream).writeStream.format("memory").queryName("tasks").outputMode("update"))
    assert [r["status"] for r in spark.table("tasks").collect()] == ["processing"]


@pytest.mark.parametrize("partitions", ["1", "4", "211"])
def test_continuous_hardening(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        check_continuous_hardening(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def check_continuous_hardening(spark):
    catalog = tempfile.mkdtemp(prefix="spark-") + "/catalog"
    spark.createDataFrame([("Arper", "high", "Sky", 1.0, -1)], "brand string, tier string, model string, price double, batch_id long").write.partitionBy("tier", "batch_id").parquet(catalog)
    found = spark.createDataFrame(
        [("arper ", "high", "SKY", 1, 2.0), ("Arper", "high", "Oak", 2, 3.0), ("Arper", "high", "Oak", 3, 4.0), ("Arper", "mid", "Sky", 4, 5.0)],
        "brand string, tier string, model string, seq int, price double",
    ).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    stream = spark.readStream.schema(found.schema).parquet(folder(found))
    run(jobs.harden_batches(stream, catalog))
    stored = spark.read.option("mergeSchema", True).parquet(catalog)
    got = sorted((r["tier"], r["model"], r["price"], r["seq"]) for r in stored.collect())
    assert got == [("high", "Oak", 3.0, 2), ("high", "Sky", 1.0, None), ("mid", "Sky", 5.0, 4)]
    known = spark.createDataFrame([("ARPER",)], "name string")
    more = found.withColumn("brand", F.when(F.col("seq") == 1, "Nobody").otherwise(F.col("brand"))).withColumn("model", F.concat("model", F.lit(" II")))
    stream = spark.readStream.schema(found.schema).parquet(folder(more))
    run(jobs.harden_batches(stream, catalog, known))
    names = {r["model"] for r in spark.read.parquet(catalog).collect()}
    assert "Oak II" in names and "SKY II" not in names
