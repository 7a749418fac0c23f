"""Page layout over document lines, and event streams read as batches."""

from pyspark.sql import functions as F

from billwright import rules
from billwright.operators import layout
from billwright.operators.ordering import number_rows
from billwright.operators.settle import settle, step_path
from billwright.queries import views as V
from billwright.queries.registry import query
from billwright.streaming import jobs

# Every word of every line is an item, and every third line sinks word by word into the lines below it; lines 2, 7, 12 …
# come as one item. Numbers in the margin mark lines 1, 6, 11 …, and every second document has a header on each page.
PER_LINE = 100_000
WORD_ITEM = "named_struct('ord', CAST(line_no AS BIGINT) * {n} + 2 + i, 'str', w, 'x', 60 + 40 * i, 'y', line_no * 20 + CASE WHEN line_no % 3 = 2 THEN i * 3 % 60 ELSE i % 2 * 4 END)".format(n=PER_LINE)


def text_items(spark, sf):
    lines = V.lined_documents(spark, sf)
    words = F.expr(f"CASE WHEN line_no % 5 = 2 THEN array(named_struct('ord', CAST(line_no AS BIGINT) * {PER_LINE} + 2, 'str', str, 'x', 60, 'y', line_no * 20)) "
                   f"ELSE transform(split(str, ' '), (w, i) -> {WORD_ITEM}) END")
    margin = F.expr(f"CASE WHEN line_no % 5 = 1 THEN array(named_struct('ord', CAST(line_no AS BIGINT) * {PER_LINE}, 'str', CAST(line_no AS STRING) || '.', 'x', 20, 'y', line_no * 20 + 2)) "
                    f"WHEN line_no = 0 AND doc_id % 2 = 0 THEN array(named_struct('ord', CAST(0 AS BIGINT), 'str', 'Item Description Qty', 'x', 130, 'y', 1)) ELSE array() END")
    return lines.select("doc_id", "page", F.explode(F.concat(margin, words)).alias("t")).select("doc_id", "page", "t.*", F.lit(50).alias("w"), F.lit(12).alias("h"))


ITEMS_SQL = f"""{V.DOC_LINES_SQL}, items AS (
  SELECT doc_id, page, line_no::BIGINT * {PER_LINE} + 2 + i - 1 AS ord, ws[i] AS str, 60 + 40 * (i - 1) AS x, line_no * 20 + CASE WHEN line_no % 3 = 2 THEN (i - 1) * 3 % 60 ELSE (i - 1) % 2 * 4 END AS y, 50 AS w, 12 AS h
  FROM (SELECT doc_id, page, line_no, string_split(str, ' ') AS ws FROM doc_lines WHERE line_no % 5 <> 2), LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)
  UNION ALL SELECT doc_id, page, line_no::BIGINT * {PER_LINE} + 2, str, 60, line_no * 20, 50, 12 FROM doc_lines WHERE line_no % 5 = 2
  UNION ALL SELECT doc_id, page, line_no::BIGINT * {PER_LINE}, CAST(line_no AS VARCHAR) || '.', 20, line_no * 20 + 2, 50, 12 FROM doc_lines WHERE line_no % 5 = 1
  UNION ALL SELECT doc_id, page, 0, 'Item Description Qty', 130, 1, 50, 12 FROM doc_lines WHERE line_no = 0 AND doc_id % 2 = 0)"""


def page_images(spark, sf):
    """Every third document has a picture on each line, the others on every fourth; some are icons."""
    return V.lined_documents(spark, sf).where("doc_id % 3 = 0 OR line_no % 4 = 1").select(
        "doc_id", "page", F.col("line_no").alias("ord"), F.lit(300).alias("x"), (F.col("line_no") * 20 + 3).alias("y"),
        F.expr("CASE WHEN line_no % 12 = 1 AND doc_id % 3 <> 0 THEN 18 ELSE 60 END").alias("w"), F.lit(40).alias("h"),
        F.expr("'img-' || CAST(doc_id AS STRING) || '-' || CAST(page AS STRING) || '-' || CAST(line_no AS STRING)").alias("path"),
    )


IMAGES_SQL = """images AS (SELECT doc_id, page, line_no AS ord, 300 AS x, line_no * 20 + 3 AS y, CASE WHEN line_no % 12 = 1 AND doc_id % 3 <> 0 THEN 18 ELSE 60 END AS w, 40 AS h,
  'img-' || CAST(doc_id AS VARCHAR) || '-' || CAST(page AS VARCHAR) || '-' || CAST(line_no AS VARCHAR) AS path FROM doc_lines WHERE doc_id % 3 = 0 OR line_no % 4 = 1)"""


def page_rows(spark, sf):
    """Every line is an extracted row, numbered like it; every fifth number is missing."""
    return V.lined_documents(spark, sf).select(
        "doc_id", "page", F.col("line_no").alias("row_idx"), F.expr("CASE WHEN line_no % 5 = 2 THEN '' ELSE CAST(line_no AS STRING) END").alias("sn"),
        F.col("str").alias("description"), F.expr("line_no % 2 = 0").alias("has_image"),
    )


ROWS_SQL = """page_rows AS (SELECT doc_id, page, line_no AS row_idx, CASE WHEN line_no % 5 = 2 THEN '' ELSE CAST(line_no AS VARCHAR) END AS sn, str AS description, line_no % 2 = 0 AS has_image FROM doc_lines)"""

# The fold in order over the first items of every distinct y; a start keeps [y, ord] of its first item.
CLUSTERS_SQL = f"""{ITEMS_SQL}, tops AS (SELECT doc_id, page, y, min(ord) AS f FROM items GROUP BY ALL),
starts AS (SELECT doc_id, page, list_reduce(list_concat([[]::BIGINT[][]], list([[y, f]] ORDER BY f)),
  lambda a, b: CASE WHEN len(list_filter(a, lambda s: abs(s[1] - b[1][1]) <= 10)) > 0 THEN a ELSE list_concat(a, b) END) AS s FROM tops GROUP BY ALL),
c AS (SELECT i.*, (list_min(list_transform(list_filter(s, lambda v: abs(v[1] - y) <= 10 AND v[2] <= ord), lambda v: v[1]))) AS line FROM items i JOIN starts USING (doc_id, page)),
clusters AS (SELECT doc_id, page, CAST(line AS INTEGER) AS y, trim(string_agg(str, ' ' ORDER BY x, ord), ' ') AS text FROM c GROUP BY doc_id, page, line HAVING trim(string_agg(str, ' ' ORDER BY x, ord), ' ') <> '')"""


@query("line_clusters", f"WITH {CLUSTERS_SQL} SELECT doc_id, page, y, text FROM clusters")
def line_clusters(spark, sf):
    return layout.text_lines(text_items(spark, sf), words=False).select("doc_id", "page", "y", "text")


def _hits(words):
    return " + ".join(f"CASE WHEN contains(lower(str), '{w}') THEN 1 ELSE 0 END" for w in words)


@query(
    "header_by_votes",
    f"""WITH {ITEMS_SQL}, h AS (SELECT doc_id, page, ord, y, {_hits(rules.PAGE_HEADER_WORDS)} AS n FROM items),
v AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id, page ORDER BY y RANGE BETWEEN 14 PRECEDING AND 14 FOLLOWING) AS INTEGER) AS hits FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY hits DESC, ord) AS rn FROM v WHERE hits > 0) SELECT doc_id, page, y AS header_y, hits FROM r WHERE rn = 1""",
)
def header_by_votes(spark, sf):
    return layout.header_by_votes(text_items(spark, sf)).select("doc_id", "page", "header_y", "hits")


@query(
    "header_by_item",
    f"""WITH {ITEMS_SQL} SELECT doc_id, page, coalesce(min(CASE WHEN {' OR '.join(f"contains(lower(str), '{w}')" for w in rules.PAGE_ITEM_WORDS)} THEN y END), -1) AS header_y FROM items GROUP BY doc_id, page""",
)
def header_by_item(spark, sf):
    return layout.header_by_item(text_items(spark, sf))


@query(
    "header_by_line",
    f"""WITH {CLUSTERS_SQL} SELECT doc_id, page, coalesce(min(CASE WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in rules.PAGE_LINE_WORDS)} THEN y END), 9999) AS header_y FROM clusters GROUP BY doc_id, page""",
)
def header_by_line(spark, sf):
    return layout.header_by_line(layout.text_lines(text_items(spark, sf), words=False))


ANCHORS_SQL = f"""{ITEMS_SQL}, anchors AS (SELECT doc_id, page, ord, CAST(CAST(regexp_extract(str, '^\\s*([0-9]+)[.\\s-]*$', 1) AS BIGINT) AS VARCHAR) AS sn, y + h / 2.0 AS y, y AS top FROM items
  WHERE x < 120 AND regexp_matches(str, '^\\s*([0-9]+)[.\\s-]*$'))"""


@query("sn_anchors", f"WITH {ANCHORS_SQL} SELECT doc_id, page, sn, CAST(y AS DOUBLE) AS y FROM anchors")
def sn_anchors(spark, sf):
    return layout.serial_anchors(text_items(spark, sf)).select("doc_id", "page", "sn", F.col("y").cast("double").alias("y"))


START_SQL = f"""{ANCHORS_SQL}, heads AS (SELECT doc_id, page, min(CASE WHEN {' OR '.join(f"contains(lower(str), '{w}')" for w in rules.PAGE_ITEM_WORDS)} THEN y END) AS hy FROM items GROUP BY doc_id, page),
starts AS (SELECT i.doc_id, i.page, coalesce((SELECT min(top) FROM anchors a WHERE a.doc_id = i.doc_id AND a.page = i.page), hy, -1) AS start_y FROM heads i)"""


def _images(spark, sf):
    return layout.product_images(page_images(spark, sf), layout.page_starts(text_items(spark, sf)), "start_y")


@query(
    "image_filter",
    f"WITH {START_SQL}, {IMAGES_SQL} SELECT doc_id, page, ord, path FROM images JOIN starts USING (doc_id, page) WHERE w >= 30 AND h >= 30 AND (start_y = -1 OR y >= start_y - 10)",
)
def image_filter(spark, sf):
    return _images(spark, sf).select("doc_id", "page", "ord", "path")


@query(
    "image_pairs_rank",
    f"""WITH {V.DOC_LINES_SQL}, {IMAGES_SQL}, {ROWS_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y, x, ord) AS k, count(*) OVER (PARTITION BY doc_id, page) AS n FROM images),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY row_idx) AS k, count(*) OVER (PARTITION BY doc_id, page) AS n FROM page_rows)
SELECT r.doc_id, r.page, r.row_idx, i.ord AS image_ord, i.path FROM r JOIN i ON i.doc_id = r.doc_id AND i.page = r.page AND i.k = r.k AND i.n = r.n""",
)
def image_pairs_rank(spark, sf):
    return layout.pair_by_rank(page_rows(spark, sf), page_images(spark, sf))


SQUEEZE = "lower(regexp_replace(coalesce({}, ''), '[^A-Za-z0-9]', '', 'g'))"
ROW_ANCHORS_SQL = f"""{ROWS_SQL}, keyed AS (SELECT doc_id, page, ord, y, {SQUEEZE.format('str')} AS k FROM items WHERE {SQUEEZE.format('str')} <> ''),
stems AS (SELECT *, substr({SQUEEZE.format("substr(description, 1, 20)")}, 1, 10) AS stem FROM page_rows),
by_sn AS (SELECT r.doc_id, r.page, row_idx, arg_min(y, ord) AS y FROM stems r JOIN keyed k ON k.doc_id = r.doc_id AND k.page = r.page AND k.k = r.sn GROUP BY ALL),
by_text AS (SELECT r.doc_id, r.page, row_idx, arg_min(y, ord) AS y FROM stems r JOIN keyed k ON k.doc_id = r.doc_id AND k.page = r.page AND contains(k.k, stem) WHERE length(stem) > 3 GROUP BY ALL),
anchored AS (SELECT r.*, coalesce(s.y, t.y) AS anchor_y FROM page_rows r LEFT JOIN by_sn s USING (doc_id, page, row_idx) LEFT JOIN by_text t USING (doc_id, page, row_idx))"""


@query(
    "image_pairs",
    f"""WITH RECURSIVE {START_SQL}, {IMAGES_SQL}, {ROW_ANCHORS_SQL},
shown AS (SELECT doc_id, page, list({{'y': y, 'x': x, 'ord': ord, 'mid': y + h / 2, 'path': path}} ORDER BY y, x, ord) AS im FROM images JOIN starts USING (doc_id, page)
  WHERE w >= 30 AND h >= 30 AND (start_y = -1 OR y >= start_y - 10) GROUP BY doc_id, page),
todo AS (SELECT doc_id, page, im, list({{'row_idx': row_idx, 'a': anchor_y}} ORDER BY row_idx) AS rw FROM shown JOIN anchored USING (doc_id, page) GROUP BY ALL),
fold(doc_id, page, im, rw, k, used, pick) AS (
  SELECT doc_id, page, im, rw, 0, []::BIGINT[], -1::BIGINT FROM todo
  UNION ALL
  SELECT doc_id, page, im, rw, k + 1, CASE WHEN p >= 0 THEN list_append(used, p) ELSE used END, p FROM (
    SELECT *, CASE WHEN len(im) = len(rw) THEN k WHEN best[1] < 300 THEN CAST(best[2] AS BIGINT) WHEN k < len(im) AND NOT list_contains(used, k) THEN k ELSE -1 END AS p FROM (
      SELECT *, list_min(list_transform(list_filter(range(0, len(im)), lambda n: NOT list_contains(used, n)),
        lambda n: [CASE WHEN rw[k + 1].a IS NULL THEN CAST(abs(n - k) * 200 AS DOUBLE) ELSE abs(im[n + 1].mid - rw[k + 1].a) END, CAST(n AS DOUBLE)])) AS best FROM fold WHERE k < len(rw))))
SELECT doc_id, page, rw[k].row_idx AS row_idx, im[pick + 1].ord AS image_ord, im[pick + 1].path AS path FROM fold WHERE k > 0 AND pick >= 0""",
)
def image_pairs(spark, sf):
    items, rows = settle(text_items(spark, sf), "items"), settle(page_rows(spark, sf), "rows")
    shown = layout.product_images(page_images(spark, sf), layout.page_starts(items), "start_y")
    return layout.pair_images(rows, items, shown)


@query(
    "image_nearest",
    f"""WITH {ANCHORS_SQL}, {IMAGES_SQL}, d AS (SELECT i.doc_id, i.page, i.ord AS image_ord, i.path, a.sn, abs(a.y - (i.y + i.h / 2.0)) AS distance,
   row_number() OVER (PARTITION BY i.doc_id, i.page, i.ord ORDER BY abs(a.y - (i.y + i.h / 2.0)), a.ord) AS rn FROM images i JOIN anchors a ON a.doc_id = i.doc_id AND a.page = i.page AND abs(a.y - (i.y + i.h / 2.0)) < 120),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, sn ORDER BY image_ord DESC) AS rl FROM d WHERE rn = 1) SELECT doc_id, page, sn, image_ord, path, CAST(distance AS DOUBLE) AS distance FROM l WHERE rl = 1""",
)
def image_nearest(spark, sf):
    found = layout.nearest_anchor(page_images(spark, sf), layout.serial_anchors(text_items(spark, sf)))
    return found.select("doc_id", "page", "sn", "image_ord", "path", F.col("distance").cast("double").alias("distance"))


@query(
    "image_cursor",
    f"""WITH {V.DOC_LINES_SQL}, {IMAGES_SQL}, {ROWS_SQL}, s AS (SELECT doc_id, path, row_number() OVER (PARTITION BY doc_id ORDER BY page, ord) AS k FROM images),
w AS (SELECT doc_id, page * 100 + row_idx AS idx, row_number() OVER (PARTITION BY doc_id ORDER BY page * 100 + row_idx) AS k FROM page_rows WHERE has_image AND row_idx % 3 <> 0)
SELECT w.doc_id, w.idx AS row_idx, CAST(w.k AS BIGINT) AS cursor, s.path FROM w JOIN s USING (doc_id, k)""",
)
def image_cursor(spark, sf):
    rows = settle(page_rows(spark, sf).select("doc_id", (F.col("page") * 100 + F.col("row_idx")).alias("row_idx"), "has_image", (F.col("row_idx") % 3).alias("third")), "rows")
    matched = rows.where("third = 0")
    images = number_rows(page_images(spark, sf), ["doc_id"], ["page", "ord"], "seq", F.floor(F.col("page") / 1000))
    return layout.image_cursor(rows, images, matched, F.floor(F.col("row_idx") / 100000)).select("doc_id", "row_idx", "cursor", "path")


@query(
    "image_by_line",
    f"""WITH {CLUSTERS_SQL}, {IMAGES_SQL}, {ROWS_SQL}, keyed AS (SELECT doc_id, page, line, {SQUEEZE.format('str')} AS k FROM c WHERE {SQUEEZE.format('str')} <> ''),
lined AS (SELECT doc_id, page, row_idx, max(line) AS line_y FROM page_rows JOIN keyed USING (doc_id, page) WHERE sn <> '' AND starts_with(sn, k) GROUP BY ALL),
near AS (SELECT l.doc_id, l.page, row_idx, min(i.ord) AS near_ord FROM lined l JOIN images i ON i.doc_id = l.doc_id AND i.page = l.page AND abs(i.y - line_y) < 40 GROUP BY ALL)
SELECT r.doc_id, r.page, r.row_idx, coalesce(near_ord, a.ord, b.ord) AS image_ord FROM page_rows r LEFT JOIN near USING (doc_id, page, row_idx)
LEFT JOIN images a ON a.doc_id = r.doc_id AND a.page = r.page AND a.ord = r.row_idx // 2 LEFT JOIN images b ON b.doc_id = r.doc_id AND b.page = r.page AND b.ord = r.row_idx""",
)
def image_by_line(spark, sf):
    rows = page_rows(spark, sf).withColumn("image_ref", F.expr("row_idx div 2").cast("int"))
    return layout.image_by_line(rows, layout.text_lines(text_items(spark, sf)), page_images(spark, sf))


@query(
    "crop_bands",
    f"""WITH {ITEMS_SQL}, {ROW_ANCHORS_SQL},
o AS (SELECT a.*, s.y AS sn_y, row_number() OVER (PARTITION BY a.doc_id, a.page ORDER BY a.row_idx) - 1 AS i, lead(s.y) OVER (PARTITION BY a.doc_id, a.page ORDER BY a.row_idx) AS nx
  FROM anchored a LEFT JOIN by_sn s USING (doc_id, page, row_idx))
SELECT doc_id, page, row_idx, CAST(coalesce(anchor_y, 400 + i * 160) AS DOUBLE) AS top, CAST(CASE WHEN nx > coalesce(anchor_y, 400 + i * 160) THEN least(300, nx - coalesce(anchor_y, 400 + i * 160) + 30) ELSE 160 END AS DOUBLE) AS height FROM o""",
)
def crop_bands(spark, sf):
    return layout.crop_bands(layout.row_anchors(page_rows(spark, sf), text_items(spark, sf)))


# ------------------------------------------------------------------ events
def _stamp(c):
    """Time as text, so that the result does not depend on the client's time zone."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


def _stamp_sql(x):
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


SESSIONS_SQL = f"""{V.ACTIVITY_SQL}, g AS (SELECT *, lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS before FROM activity),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 2 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS n FROM g)"""


@query(
    "session_expiry",
    f"""WITH {SESSIONS_SQL} SELECT session_id, CAST(n AS BIGINT) AS session_no, {_stamp_sql('min(ts)')} AS first_ts, {_stamp_sql('max(ts)')} AS last_ts, CAST(count(*) AS BIGINT) AS events,
  CAST(count(DISTINCT CASE WHEN kind = 'file' THEN ref END) AS BIGINT) AS files, CAST(count(DISTINCT CASE WHEN kind = 'blob' THEN ref END) AS BIGINT) AS blobs, {_stamp_sql('max(ts) + INTERVAL 2 HOURS')} AS expires_at FROM s GROUP BY session_id, n""",
)
def session_expiry(spark, sf):
    found = jobs.expired_sessions(V.activity(spark, sf))
    stamps = ("first_ts", "last_ts", "expires_at")
    return found.select(*[_stamp(c) if c in stamps else F.col(c) for c in found.columns])


@query("session_refs", f"WITH {SESSIONS_SQL} SELECT DISTINCT session_id, CAST(n AS BIGINT) AS session_no, kind, ref FROM s")
def session_refs(spark, sf):
    return jobs.expired_refs(V.activity(spark, sf))


TASK_STATUS = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END"


@query(
    "task_latest",
    f"""WITH t AS (SELECT CAST(user_id AS VARCHAR) AS task_id, {TASK_STATUS} AS status, CAST(event_id % 101 AS INTEGER) AS progress, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT task_id, status, progress, {_stamp_sql('ts')} AS ts FROM t WHERE rn = 1""",
)
def task_latest(spark, sf):
    events = V.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("task_id"), F.expr(TASK_STATUS).alias("status"), (F.col("event_id") % 101).cast("int").alias("progress"),
        F.lit("").alias("stage"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
    )
    return jobs.latest_tasks(events).select("task_id", "status", "progress", _stamp("ts"))


def _stream(spark, sf):
    """The events as a stream of one micro-batch per start. A stream reads folders or patterns, and the table may be one file."""
    return spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parque[t]")


def _drained(spark, stream, name):
    """All that a stream gives until its input ends, from its Parquet sink."""
    path = step_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", step_path(spark, "checkpoint")).outputMode("append")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query(
    "session_expiry_stream",
    f"""WITH {SESSIONS_SQL}, e AS (SELECT session_id, n, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM s GROUP BY ALL
  HAVING max(ts) + INTERVAL 2 HOURS <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOURS FROM events))
SELECT DISTINCT session_id, {_stamp_sql('first_ts')} AS first_ts, {_stamp_sql('last_ts')} AS last_ts, CAST(events AS BIGINT) AS events, kind, ref FROM e JOIN s USING (session_id, n)""",
)
def session_expiry_stream(spark, sf):
    """Sessions that the stream has expired by its end, with their files and blobs from the state."""
    found = _drained(spark, jobs.expiring_sessions(V.activity_of(_stream(spark, sf))), "expired")
    return found.where("not late").select("session_id", _stamp("first_ts"), _stamp("last_ts"), "events", "kind", "ref")


DISCOVERY = {"brand": "CASE WHEN event_id % 2 = 0 THEN ' ' || upper(event_type) ELSE event_type END", "tier": "CASE user_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN '' ELSE 'MID' END", "model": "'Model ' || CAST(user_id % 40 AS STRING)"}


@query(
    "first_discoveries_stream",
    V.sql_text(f"""WITH d AS (SELECT {', '.join(f"{x} AS {c}" for c, x in DISCOVERY.items())}, 1000003 * event_id % 999983 AS seq, event_id, ts FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(brand)), CASE WHEN tier = '' THEN 'mid' ELSE lower(tier) END, model ORDER BY seq, ts) AS rn FROM d)
SELECT brand, tier, model, CAST(seq AS BIGINT) AS seq, event_id FROM r WHERE rn = 1 AND ts <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)"""),
)
def first_discoveries_stream(spark, sf):
    """Of all discoveries of a product the one with the least arrival number, as far as the watermark has come."""
    found = _stream(spark, sf).select(
        *[F.expr(x).alias(c) for c, x in DISCOVERY.items()], F.expr("1000003 * event_id % 999983").alias("seq"), "event_id", F.col("ts").cast("timestamp").alias("ts")
    )
    return _drained(spark, jobs.first_discoveries(found), "discovered").select("brand", "tier", "model", "seq", "event_id")
