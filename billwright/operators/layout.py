"""Page layout: text lines, table header, anchors and image pairing.

Everything is grouped by (doc_id, page). A page is a physical sheet of paper, so windows over
one page are bounded; nothing here groups by document alone except the image cursor, which uses
the blocked running sum. ``text_items``: doc_id, page, ord, str, x, y, w, h. ``page_images``:
doc_id, page, ord, x, y, w, h, path. ``rows``: doc_id, page, row_idx, sn, description.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from billwright import rules
from billwright.functions.text import contains_any, count_words
from billwright.operators.ordering import running_sum

PAGE = ["doc_id", "page"]
ANY_ROW = (Window.unboundedPreceding, Window.unboundedFollowing)


def squeeze(x):
    """Only letters and digits, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")), "[^A-Za-z0-9]", ""))


def _gathered(tolerance, words):
    """Lines of whole pages. The rows come page by page in their order; pages of any number of rows are put together from the batches."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def near(starts, y):
        # A strip of tolerance + 1 units holds at most one start, so three strips hold all that are near: two at most.
        strips = range((y - tolerance) // (tolerance + 1), (y + tolerance) // (tolerance + 1) + 1)
        return sorted(starts[k] for k in strips if k in starts and abs(starts[k][0] - y) <= tolerance)

    def turns(batch):
        """Where a row begins another page than the row before it."""
        changes = [pc.not_equal(batch.column(c).slice(1), batch.column(c).slice(0, batch.num_rows - 1)) for c in PAGE]
        return np.flatnonzero(pc.or_(*changes).to_numpy(zero_copy_only=False)) + 1

    def whole_pages(batches):
        held, page = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts, first = turns(batch), [batch.column(c)[0].as_py() for c in PAGE]
            cut = int(cuts[-1]) if len(cuts) else 0
            if held and (cut or first != page):
                yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
                held = []
            elif cut:
                yield batch.slice(0, cut)
            held.append(batch.slice(cut))
            page = [batch.column(c)[batch.num_rows - 1].as_py() for c in PAGE]
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def placed(ys):
        """The line of every item of a page. Only the first item of every distinct y can start one, so the fold runs over those."""
        kinds, first, kind = np.unique(ys, return_index=True, return_inverse=True)
        heights, starts = kinds.tolist(), {}
        for k in np.argsort(first).tolist():
            if not near(starts, heights[k]):
                starts[heights[k] // (tolerance + 1)] = (heights[k], int(first[k]))
        lines = [near(starts, y) for y in heights]
        low, opened, high = (np.array(v)[kind] for v in ([x[0][0] for x in lines], [x[0][1] for x in lines], [x[-1][0] for x in lines]))
        return np.where(opened <= np.arange(len(ys)), low, high)

    def fold(batches):
        for rows in whole_pages(batches):
            cuts, ys = turns(rows), rows.column("y").to_numpy()
            page = np.zeros(len(ys), int)
            page[cuts] = 1
            line = np.concatenate([placed(part) for part in np.split(ys, cuts)])
            x = pc.fill_null(rows.column("x").cast(pa.float64()), -np.inf).to_numpy()
            order = np.lexsort((x, line, np.cumsum(page)))
            rows, line, page = rows.take(pa.array(order)), line[order], np.cumsum(page)[order]
            begins = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (page[1:] != page[:-1])])
            ends = np.r_[begins, len(line)]
            told = rows.column("str").is_valid().to_numpy(zero_copy_only=False)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(told)][ends], pa.int32()), rows.column("str").drop_null().cast(pa.string())), " ")
            heads = rows.take(pa.array(begins))
            out = {**{c: heads.column(c) for c in PAGE}, "y": pa.array(line[begins], pa.int32()), "text": pc.utf8_trim(joined, " ")}
            if words:
                out["words"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows.column("str"))
            yield pa.RecordBatch.from_pydict(out)

    return fold


def text_lines(items, tolerance=10, words=True):
    """Text items gathered to lines (B20): y, text and, unless they are not asked for, the words from left to right.

    Items are taken in their given order. Each joins the lowest-y line whose first item lies within the tolerance,
    or starts a line; lines may drift into each other. The items travel once, by page, and every page is one fold in order.
    """
    y = F.round("y", 0).cast("int")
    rounded = items.select(*PAGE, F.col("ord").cast("long").alias("ord"), y.alias("y"), "x", "str").dropna(subset=[*PAGE, "y"])
    kind = lambda c: items.schema[c].dataType.simpleString()
    schema = ", ".join([*[f"{c} {kind(c)}" for c in PAGE], "y int", "text string", *(["words array<string>"] if words else [])])
    in_order = rounded.repartition(*PAGE).sortWithinPartitions(*PAGE, "ord", "str", "y")
    return in_order.mapInArrow(_gathered(tolerance, words), schema).where("text <> ''")


def header_by_votes(items, reach=15, words=rules.PAGE_HEADER_WORDS):
    """Line with most header words within the reach, first on ties; x of its image column."""
    text = F.lower("str")
    hits = items.select(
        *PAGE,
        "ord",
        "y",
        (F.col("y") * 1000).cast("bigint").alias("_y"),
        count_words(text, words).alias("_hits"),
        F.when(text.contains("image"), F.struct("ord", "x")).alias("_image"),
    )
    near = Window.partitionBy(*PAGE).orderBy("_y").rangeBetween(1 - reach * 1000, reach * 1000 - 1)
    voted = hits.withColumn("hits", F.sum("_hits").over(near)).withColumn("_image", F.max("_image").over(near))
    return (
        voted.where("hits > 0")
        .groupBy(*PAGE)
        .agg(F.max_by(F.struct("y", "hits", F.col("_image.x").alias("image_x")), F.struct("hits", -F.col("ord"))).alias("h"))
        .select(*PAGE, F.col("h.y").alias("header_y"), F.col("h.hits").cast("int").alias("hits"), "h.image_x")
    )


def header_by_line(lines, y_grows_down=True, words=rules.PAGE_LINE_WORDS):
    """First line from the top with any header word; 9999 when there is none."""
    hit = contains_any(F.lower("text"), words)
    first = F.min if y_grows_down else F.max
    return lines.groupBy(*PAGE).agg(F.coalesce(first(F.when(hit, F.col("y"))), F.lit(9999)).alias("header_y"))


def header_by_item(items, words=rules.PAGE_ITEM_WORDS):
    """Smallest y of an item with a header word; -1 when there is none."""
    hit = contains_any(F.lower("str"), words)
    return items.groupBy(*PAGE).agg(F.coalesce(F.min(F.when(hit, F.col("y"))), F.lit(-1)).alias("header_y"))


def serial_anchors(items, left_of=120):
    """Serial numbers in the left margin with the middle of their line."""
    number = F.regexp_extract("str", r"^\s*(\d+)[.\s-]*$", 1)
    return (
        items.where(F.col("x") < left_of)
        .withColumn("_n", number)
        .where("_n <> ''")
        .select(
            *PAGE,
            "ord",
            F.regexp_replace("_n", r"^0+(?=\d)", "").alias("sn"),
            (F.col("y") + F.col("h") / 2.0).alias("y"),
            F.col("y").alias("top"),
        )
    )


def page_starts(items, default=-1, left_of=120, words=rules.PAGE_ITEM_WORDS):
    """Top of the first serial number of each page, else of its first header word, else the default, in one pass."""
    number = (F.col("x") < left_of) & F.col("str").rlike(r"^\s*(\d+)[.\s-]*$")
    header = contains_any(F.lower("str"), words)
    top = lambda hit: F.min(F.when(hit, F.col("y")))
    return items.groupBy(*PAGE).agg(F.coalesce(top(number), top(header), F.lit(default)).alias("start_y"))


def table_start(pages, anchors, headers, default=150):
    """Top of the first serial number, else the header, else a default."""
    tops = anchors.groupBy(*PAGE).agg(F.min("top").alias("_top"))
    return (
        pages.select(*PAGE).distinct()
        .join(tops, PAGE, "left")
        .join(headers.select(*PAGE, "header_y"), PAGE, "left")
        .select(*PAGE, F.coalesce("_top", "header_y", F.lit(default)).alias("start_y"))
    )


def product_images(images, starts, start_col, least=30, slack=10):
    """Images large enough and not above the table; a start of -1 means unknown."""
    joined = images.join(starts.select(*PAGE, start_col), PAGE, "left")
    start = F.coalesce(F.col(start_col), F.lit(-1))
    return joined.where(
        (F.col("w") >= least) & (F.col("h") >= least) & ((start == -1) | (F.col("y") >= start - slack))
    ).drop(start_col)


def pair_by_rank(rows, images):
    """On pages with as many images as rows, the n-th image belongs to the n-th row."""
    r = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy("row_idx")))
    i = images.withColumn("_rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y", "x", "ord")))
    same = (
        rows.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("_r"))
        .join(images.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("_i")), PAGE)
        .where("_r = _i")
        .select(*PAGE)
    )
    return (
        r.join(same, PAGE, "left_semi")
        .join(i.select(*PAGE, "_rank", F.col("ord").alias("image_ord"), "path"), [*PAGE, "_rank"])
        .select(*PAGE, "row_idx", "image_ord", "path")
    )


def _found_on_pages(batches):
    """y of the first text of the page in which each search of its rows ends; rows of one number share the first that any of them finds."""
    import pyarrow as pa

    for batch in batches:
        kept, numbers, places = [], [], ([], [])
        ys = batch.column("_ys")
        texts, rows, offsets = batch.column("_page").to_pylist(), batch.column("_asked").to_pylist(), ys.offsets.to_pylist()
        for i, (text, asked) in enumerate(zip(texts, rows, strict=True)):
            least = {}
            for row in asked:
                best = least.setdefault(row["row_idx"], [None, None])
                for k, sought in enumerate((row["_sn"], row["_start"])):
                    at = -1 if sought is None else text.find(sought)
                    if at >= 0 and (best[k] is None or at < best[k]):
                        best[k] = at
            for number, best in least.items():
                kept.append(i)
                numbers.append(number)
                for place, at in zip(places, best, strict=True):
                    place.append(None if at is None else offsets[i] + text.count("\n", 0, at + 1) - 1)
        pages = batch.take(pa.array(kept, pa.int64()))
        row_idx = pa.array(numbers, batch.schema.field("_asked").type.value_type.field("row_idx").type)
        found = [ys.values.take(pa.array(place, pa.int64())) for place in places]
        yield pa.RecordBatch.from_arrays([*[pages.column(c) for c in PAGE], row_idx, *found], [*PAGE, "row_idx", "sn_y", "text_y"])


def row_anchors(rows, items, prefix=10, stem=20):
    """anchor_y of the text that belongs to a row, and sn_y of its number alone: exact serial number, else the start of the description inside a text.

    The texts of a page become one, in order, each on a line of its own, so a row asks with two plain searches for the first text
    that equals its number or holds its start: linear in the page for each of its rows, however long a text is.
    """
    start = F.substring(squeeze(F.substring(F.coalesce("description", F.lit("")), 1, stem)), 1, prefix)
    wanted = rows.select(*PAGE, "row_idx", squeeze("sn").alias("_sn"), start.alias("_start"))
    wanted = wanted.select(*PAGE, "row_idx", F.when(F.col("_sn") != "", F.concat(F.lit("\n"), "_sn", F.lit("\n"))).alias("_sn"), F.when(F.length("_start") > 3, F.col("_start")).alias("_start"))
    keyed = items.where(F.col("str").rlike("[A-Za-z0-9]") & F.col("ord").isNotNull()).select(*PAGE, F.struct("ord", "y", squeeze("str").alias("k")).alias("_t"))
    pages = keyed.groupBy(*PAGE).agg(F.array_sort(F.collect_list("_t")).alias("_t")).select(
        *PAGE, F.concat(F.lit("\n"), F.array_join("_t.k", "\n"), F.lit("\n")).alias("_page"), F.col("_t.y").alias("_ys")
    )

    asked = wanted.where("_sn is not null or _start is not null").groupBy(*PAGE).agg(F.collect_list(F.struct("row_idx", "_sn", "_start")).alias("_asked"))
    kind = lambda frame, c: frame.schema[c].dataType.simpleString()
    schema = ", ".join([*[f"{c} {kind(rows, c)}" for c in (*PAGE, "row_idx")], *[f"{c} {kind(items, 'y')}" for c in ("sn_y", "text_y")]])
    found = asked.join(pages, PAGE).mapInArrow(_found_on_pages, schema)
    return rows.join(found, [*PAGE, "row_idx"], "left").withColumn("anchor_y", F.coalesce("sn_y", "text_y")).drop("text_y")


def _by_page(frame, columns, out):
    return frame.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(out))


def _claims(reach=300, rank_step=200):
    """Image number per row, in row order; -1 for none. Each row takes its nearest free image, the first on ties."""
    numbers = F.sequence(F.lit(0), F.size("images") - 1)

    def claim(held, row):
        rank = F.size(held["taken"])
        free = F.filter(numbers, lambda n: ~F.array_contains(held["used"], n))
        gap = lambda n: F.when(
            row["anchor_y"].isNull(), (F.abs(n - rank) * rank_step).cast("double")
        ).otherwise(F.abs(F.get("images", n)["middle"] - row["anchor_y"]))
        best = F.array_min(F.transform(free, lambda n: F.struct(gap(n).alias("gap"), n.alias("n"))))
        same = (rank < F.size("images")) & ~F.array_contains(held["used"], rank)
        image = F.when(best["gap"] < reach, best["n"]).when(same, rank).otherwise(F.lit(-1))
        used = F.when(image >= 0, F.concat(held["used"], F.array(image))).otherwise(held["used"])
        return F.struct(F.concat(held["taken"], F.array(image)).alias("taken"), used.alias("used"))

    none = F.array().cast("array<int>")
    return F.aggregate("rows", F.struct(none.alias("taken"), none.alias("used")), claim, lambda held: held["taken"])


def _paired(rows, images, taken):
    """Pairs of pages from an expression over ``rows`` and ``images`` that numbers the image of each row."""
    row = _by_page(rows, ["row_idx", F.col("anchor_y").cast("double").alias("anchor_y")], "rows")
    middle = (F.col("y") + F.col("h") / 2).cast("double").alias("middle")
    image = _by_page(images, ["y", "x", "ord", middle, "path"], "images")
    pages = row.join(image, PAGE).withColumn("taken", taken)
    pair = pages.select(*PAGE, "images", F.explode(F.arrays_zip("rows", "taken")).alias("z")).where("z.taken >= 0")
    one = F.get("images", F.col("z.taken"))
    return pair.select(*PAGE, F.col("z.rows.row_idx").alias("row_idx"), one["ord"].alias("image_ord"), one["path"].alias("path"))


def pair_by_distance(anchored_rows, images):
    """Nearest free image per row, in row order; each image is used once (B25). One ordered fold per page over its sorted images."""
    return _paired(anchored_rows, images, _claims())


def pair_images(rows, items, images):
    """Pages with equal counts pair by rank, the others by distance."""
    same = F.size("rows") == F.size("images")
    taken = F.when(same, F.sequence(F.lit(0), F.size("rows") - 1)).otherwise(_claims())
    return _paired(row_anchors(rows, items), images, taken)


def nearest_anchor(images, anchors, reach=120):
    """Closest serial number within the reach; of several images the last one stays.

    Bands as high as the reach keep the join to neighbouring rows of a page.
    """
    band = lambda y: F.floor(y / reach)
    middle = F.col("y") + F.col("h") / 2.0
    left = images.select(*PAGE, F.col("ord").alias("image_ord"), "path", middle.alias("image_y")).withColumn(
        "_band", F.explode(F.array(band(F.col("image_y")) - 1, band(F.col("image_y")), band(F.col("image_y")) + 1))
    )
    right = anchors.select(*PAGE, "sn", F.col("ord").alias("anchor_ord"), F.col("y").alias("anchor_y")).withColumn(
        "_band", band(F.col("anchor_y"))
    )
    gap = F.abs(F.col("anchor_y") - F.col("image_y"))
    closest = (
        left.join(right, [*PAGE, "_band"])
        .withColumn("distance", gap)
        .where(F.col("distance") < reach)
        .groupBy(*PAGE, "image_ord")
        .agg(F.min_by(F.struct("sn", "path", "distance"), F.struct("distance", "anchor_ord")).alias("m"))
    )
    return closest.groupBy(*PAGE, "m.sn").agg(
        F.max_by(F.struct("image_ord", "m.path", "m.distance"), "image_ord").alias("i")
    ).select(*PAGE, "sn", "i.image_ord", "i.path", "i.distance")


def image_by_line(rows, lines, images, reach=40):
    """Row image near the line that carries its number; else the given reference, else the index."""
    texts = lines.select(*PAGE, F.col("y").alias("line_y"), F.explode("words").alias("str")).where(F.col("str").rlike("[A-Za-z0-9]"))
    # Of equal texts of a page only the last line can count, so most words stay behind before the exchange.
    keyed = texts.groupBy(*PAGE, squeeze("str").alias("_k")).agg(F.max("line_y").alias("line_y"))
    target = rows.select(*PAGE, "row_idx", squeeze("sn").alias("_sn")).where("_sn <> ''")
    starts = target.withColumn(
        "_k", F.explode(F.transform(F.sequence(F.lit(1), F.length("_sn")), lambda n: F.col("_sn").substr(F.lit(1), n)))
    )
    lined = starts.join(keyed, [*PAGE, "_k"]).groupBy(*PAGE, "row_idx").agg(F.max("line_y").alias("line_y"))
    band = lambda y: F.floor(y / reach)
    near = (
        lined.withColumn("_band", F.explode(F.array(*[band(F.col("line_y")) + d for d in (-1, 0, 1)])))
        .join(
            images.select(*PAGE, F.col("ord").alias("image_ord"), F.col("y").alias("image_y"), band(F.col("y")).alias("_band")),
            [*PAGE, "_band"],
        )
        .where(F.abs(F.col("image_y") - F.col("line_y")) < reach)
        .groupBy(*PAGE, "row_idx")
        .agg(F.min("image_ord").alias("near_ord"))
    )
    known = images.select(*PAGE, F.col("ord").alias("image_ord"))
    return (
        rows.join(near, [*PAGE, "row_idx"], "left")
        .join(known.select(*PAGE, F.col("image_ord").alias("image_ref"), F.col("image_ord").alias("ref_ord")), [*PAGE, "image_ref"], "left")
        .join(known.select(*PAGE, F.col("image_ord").alias("row_idx"), F.col("image_ord").alias("idx_ord")), [*PAGE, "row_idx"], "left")
        .select(*PAGE, "row_idx", F.coalesce("near_ord", "ref_ord", "idx_ord").alias("image_ord"))
    )


def image_cursor(rows, images, matched, block):
    """Unmatched rows that ask for an image take the images in sequence.

    ``rows``: doc_id, row_idx, has_image; ``matched``: doc_id, row_idx. The running count over a
    document is cut into blocks for very large documents.
    """
    waiting = rows.join(matched.select("doc_id", "row_idx"), ["doc_id", "row_idx"], "left_anti").where("has_image")
    ranked = running_sum(waiting, ["doc_id"], ["row_idx"], F.lit(1), "cursor", block)
    return ranked.join(images.select("doc_id", F.col("seq").alias("cursor"), "path"), ["doc_id", "cursor"]).select(
        "doc_id", "row_idx", "cursor", "path"
    )


def crop_bands(anchored_rows, next_gap=30, least=160, most=300, first=400, step=160):
    """Top and height of the strip that holds a row's picture.

    ``anchored_rows``: doc_id, page, row_idx, anchor_y (null when unknown), sn_y (of the number alone).
    """
    order = Window.partitionBy(*PAGE).orderBy("row_idx")
    ranked = anchored_rows.withColumn("_i", F.row_number().over(order) - 1).withColumn(
        "_next", F.lead("sn_y").over(order)
    )
    top = F.coalesce(F.col("anchor_y").cast("double"), (first + F.col("_i") * step).cast("double"))
    height = F.when(
        F.col("_next") > F.col("top"), F.least(F.lit(float(most)), F.col("_next") - F.col("top") + next_gap)
    ).otherwise(F.lit(float(least)))
    return ranked.withColumn("top", top).withColumn("height", height).select(*PAGE, "row_idx", "top", "height")
