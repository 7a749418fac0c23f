"""Products, links, categories and brand facts from stored pages."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from billwright import rules
from billwright.functions.numbers import or_else
from billwright.functions.text import contains_any, slug, tidy, variant_model
from billwright.functions.urls import absolute, followable, host, is_product_url, origin, path
from billwright.operators.bloom import bloom_filter, may_hold
from billwright.operators.ordering import first_row
from billwright.operators.settle import settle


def attr(name):
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def _selects(rule):
    """Condition of one selector rule (name, tag, class token, class fragment, attribute)."""
    _, tag, token, fragment, attribute = rule
    cond = F.lit(True)
    if tag:
        cond = cond & (F.col("tag") == tag)
    if token:
        cond = cond & F.array_contains("classes", token)
    if fragment:
        cond = cond & attr("class").contains(fragment)
    if attribute:
        name, _, value = attribute.partition("=")
        cond = cond & (F.try_element_at("attrs", F.lit(name)).isNotNull() if not value else attr(name) == value)
    return cond


def _matches(selectors):
    """Array of (rank, selector) that an element fits."""
    return F.array_compact(
        F.array(
            *[
                F.when(_selects(r), F.struct(F.lit(i).alias("rank"), F.lit(r[0]).alias("selector")))
                for i, r in enumerate(selectors)
            ]
        )
    )


def image_address():
    """Address of an image element: src, lazy-load attributes, the last of srcset when present."""
    plain = or_else(attr("src"), attr("data-src"), attr("data-lazy-src"), attr("data-original"))
    best = F.element_at(F.transform(F.split(attr("srcset"), ","), lambda s: F.split(F.trim(s), " ")[0]), -1)
    return F.coalesce(F.when(attr("srcset") != "", F.nullif(best, F.lit(""))), plain)


def containers(elements, selectors=rules.CONTAINERS):
    """(page, container, selector) for every element that fits a container selector."""
    return elements.select(
        "page_id", "url", "node", "text_len", F.explode(_matches(selectors)).alias("m")
    ).select("page_id", "url", "node", "text_len", "m.rank", "m.selector")


def _inside(elements):
    """Elements once per ancestor: the container they may belong to."""
    return elements.withColumn("container", F.explode("ancestors"))


def _has_href():
    return (F.col("tag") == "a") & F.try_element_at("attrs", F.lit("href")).isNotNull()


def _first_inside(elements, boxes, wanted, keep=()):
    """Boxes with the first wanted element inside each, null where there is none.

    ``boxes``: a column that is not null for a box; ``wanted``: {name: (condition, value)}. Inside means the
    next such element in page order, if it is not behind the last element of the box, so one
    window over the page answers all boxes, however deep they nest.
    """
    node = F.col("node")
    marks = {name: F.when(cond, F.struct(node.alias("n"), value.alias("v"))) for name, (cond, value) in wanted.items()}
    rows = elements.select("page_id", "url", "node", "last", *keep, boxes.alias("box"), *[m.alias(f"_{n}") for n, m in marks.items()])
    seen = F.col("box").isNotNull()
    for name in marks:
        seen = seen | F.col(f"_{name}").isNotNull()
    later = Window.partitionBy("page_id").orderBy(F.desc("node")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.where(seen).withColumns({f"_{n}": F.last(f"_{n}", ignorenulls=True).over(later) for n in marks}).where("box is not null")
    return ahead.withColumns({n: F.when(F.col(f"_{n}")["n"] <= F.col("last"), F.col(f"_{n}")["v"]) for n in marks}).drop(*[f"_{n}" for n in marks])


def _scored(elements, selectors, wanted=None):
    """One row per box and selector it fits, with what is first inside and the score of the selector on its page."""
    titled = F.col("tag").isin("h2", "h3", "h4") | contains_any(attr("class"), ["title", "name"])
    facts = {
        "has_title": (titled, F.length(F.trim(F.coalesce("text", F.lit("")))) > 3),
        "has_image": (F.col("tag") == "img", (attr("src") != "") | (attr("data-src") != "")),
        "has_link": (_has_href(), F.lit(True)),
    }
    fitting = _matches(selectors)
    boxes = _first_inside(elements, F.when(F.size(fitting) > 0, fitting), facts | (wanted or {}))
    rows = boxes.withColumn("m", F.explode("box")).withColumns({"rank": F.col("m.rank"), "selector": F.col("m.selector")}).drop("box", "m")
    every = Window.partitionBy("page_id", "rank")
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")).over(every)
    score = F.round(share("has_title") * 30 + share("has_image") * 40 + share("has_link") * 30, 6)
    return rows.withColumns({"elements": F.count(F.lit(1)).over(every), "score": score}).where("elements >= 2 and score > 50")


def container_scores(elements, selectors=rules.CONTAINERS, keep=None):
    """Selectors whose elements look like product cards, with their place on the page; all or the best ``keep``."""
    scored = _scored(elements, selectors).groupBy("page_id", "rank", "selector").agg(F.first("elements").alias("elements"), F.first("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "rank"))
    placed = scored.withColumn("place", place)
    return placed if keep is None else placed.where(F.col("place") <= keep)


def _within(length, bounds):
    """Whether a length lies within (least, most); always without bounds."""
    return F.lit(True) if bounds is None else (length >= bounds[0]) & (length <= bounds[1])


def page_cards(elements, selectors=rules.CONTAINERS, titles=rules.CARD_TITLES, title_length=None):
    """Products from the cards of the best selector of each page.

    ``title_length`` (least, most) leaves out titles of other lengths; the next title rule is then tried.
    """
    node = F.col("node")
    source = F.split(F.trim(F.split(attr("srcset"), ",")[0]), " ")[0]
    text = F.trim(or_else(F.trim(F.coalesce("text", F.lit(""))), attr("title")))
    wanted = {f"title{i}": (_selects(rule), text) for i, rule in enumerate(titles)}
    wanted |= {
        "img": (F.col("tag") == "img", F.struct(image_address().alias("src"))),
        "source": (F.col("tag") == "source", source),
        "product_url": (_has_href(), attr("href")),
    }
    scored = _scored(elements, selectors, wanted)
    best = F.max(F.struct("score", -F.col("rank"))).over(Window.partitionBy("page_id"))
    rows = scored.withColumn("_best", best).where(F.struct("score", -F.col("rank")) == F.col("_best"))
    named = F.coalesce(*[F.when(_within(F.length(f"title{i}"), title_length), F.col(f"title{i}")) for i in range(len(titles))])
    cards = (
        rows.select("page_id", "url", node.alias("container"), named.alias("title"), or_else("img.src", "source").alias("image_url"), "product_url")
        .where(F.col("title").isNotNull() & F.col("image_url").isNotNull() & ~contains_any(F.lower("image_url"), rules.CARD_UI_IMAGE_WORDS))
        .withColumn("_k", F.lower("title"))
    )
    return _as_products(first_row(cards, ["page_id", "_k"], ["container"]), "container")


def _as_products(found, order):
    return found.select(
        "page_id",
        F.col(order).alias("pos"),
        F.lit("Products").alias("main_category"),
        F.lit("General").alias("sub_category"),
        F.col("title").alias("model"),
        F.col("title").alias("description"),
        absolute("image_url", "url").alias("image_url"),
        F.when(F.coalesce("product_url", F.lit("")) != "", absolute("product_url", "url")).otherwise(F.lit("")).alias("product_url"),
        F.lit(0).cast("decimal(18,4)").alias("price"),
    )


def page_blocks(elements, cards=None, least=None, title_least=0):
    """Generic blocks with image, link and heading.

    With ``cards`` and ``least`` only pages with fewer cards are read; titles shorter than ``title_least`` are left out.
    """
    pages = elements
    if cards is not None and least is not None:
        counts = cards.groupBy("page_id").agg(F.count(F.lit(1)).alias("_n"))
        pages = elements.join(counts.where(F.col("_n") >= least).select("page_id"), "page_id", "left_anti")
    heading = F.col("tag").isin("h1", "h2", "h3", "h4", "h5") | F.array_contains("classes", "title") | F.array_contains("classes", "name")
    text = F.trim(F.coalesce("text", F.lit("")))
    image = or_else(attr("src"), attr("data-src"), F.split(attr("srcset"), " ")[0])
    box = F.when(F.col("tag").isin("div", "li", "article", "section") & (F.col("text_len") <= 2000), F.lit(True))
    facts = _first_inside(pages, box, {
        "heading": (heading, text),
        "link": (_has_href(), F.struct(text.alias("text"), attr("href").alias("href"))),
        "image": (F.col("tag") == "img", F.struct(image.alias("src"))),
    })
    found = (
        facts.where("image is not null and link is not null")
        .where(F.col("heading").isNotNull() | (F.length("link.text") > 5))
        .select(
            "page_id", "url", F.col("node").alias("container"), F.coalesce("heading", "link.text").alias("title"),
            F.col("image.src").alias("image_url"), F.col("link.href").alias("product_url"),
        )
        .where((F.length("title") >= title_least) & F.col("image_url").isNotNull())
        .where(~contains_any(F.lower("image_url"), rules.BLOCK_UI_IMAGE_WORDS))
    )
    return _as_products(first_row(found, ["page_id", "title"], ["container"]), "container")


# --------------------------------------------------------------------------- C4


def _json_list(text):
    """Items of a JSON array, each as JSON text."""
    return F.from_json(text, "array<string>")


def _json_image(item):
    raw = F.get_json_object(item, "$.image")
    return (
        F.when(raw.startswith("["), F.get(_json_list(raw), F.lit(0)))
        .when(raw.startswith("{"), F.get_json_object(raw, "$.url"))
        .otherwise(raw)
    )


def structured_products(pages):
    """Products declared in JSON-LD: Product, ItemList, @graph; broken blocks are skipped (C4)."""
    block = r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
    scripts = pages.select(
        "page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(block), F.lit(1))).alias("script_no", "body")
    ).withColumn("body", F.trim("body")).where(F.try_parse_json("body").isNotNull())
    graph = F.get_json_object("body", "$['@graph']")
    items = (
        F.when(F.col("body").startswith("["), _json_list(F.col("body")))
        .when(graph.isNotNull(), _json_list(graph))
        .otherwise(F.array("body"))
    )
    item = scripts.select("page_id", "url", "script_no", F.posexplode(items).alias("item_no", "item"))
    raw_type = F.get_json_object("item", "$['@type']")
    kind = F.when(raw_type.startswith("["), F.get(_json_list(raw_type), F.lit(0))).otherwise(raw_type)
    item = item.withColumn("kind", kind)
    single = item.where("kind = 'Product'").select(
        "page_id", "url", "script_no", "item_no", F.lit(0).alias("entry_no"), "item", F.lit(False).alias("listed")
    )
    listed = (
        item.where("kind = 'ItemList'")
        .select("page_id", "url", "script_no", "item_no", F.posexplode(_json_list(F.get_json_object("item", "$.itemListElement"))).alias("entry_no", "entry"))
        .select("page_id", "url", "script_no", "item_no", "entry_no", F.get_json_object("entry", "$.item").alias("item"), F.lit(True).alias("listed"))
        .where(F.col("item").startswith("{"))
    )
    own = F.get_json_object("item", "$.url")
    found = single.unionByName(listed).select(
        "page_id",
        "url",
        "script_no",
        "item_no",
        "entry_no",
        "listed",
        F.get_json_object("item", "$.name").alias("name"),
        F.when(F.col("listed"), or_else(own, F.get_json_object("item", "$['@id']"))).otherwise(or_else(own, "url")).alias("link"),
        _json_image("item").alias("image"),
    )
    usable = found.where(
        (F.coalesce("name", F.lit("")) != "")
        & F.when(F.col("listed"), F.col("link").isNotNull()).otherwise(F.coalesce("image", F.lit("")) != "")
    ).select(
        "page_id",
        "script_no",
        "item_no",
        "entry_no",
        F.col("name").alias("model"),
        absolute("link", "url").alias("product_url"),
        F.when(F.coalesce("image", F.lit("")) != "", absolute("image", "url")).otherwise(F.lit("")).alias("image_url"),
    )
    return first_row(usable, ["page_id", "product_url"], ["script_no", "item_no", "entry_no"])


# --------------------------------------------------------------------------- C5, C6


def _first_text(elements, tag):
    hit = F.when(F.col("tag") == tag, F.col("node"))
    return F.min_by(F.trim(F.coalesce("text", F.lit(""))), hit)


def brand_info(elements):
    """Brand name of each page: cleaned heading, else title before a separator, else host."""
    facts = elements.groupBy("page_id", "url").agg(
        _first_text(elements, "title").alias("title"), _first_text(elements, "h1").alias("h1")
    )
    return facts.select("page_id", "url", *brand_names("title", "h1", "url"))


def brand_names(title, heading, url):
    """The three name candidates and the choice."""
    from_title = F.trim(F.split(F.coalesce(F.col(title), F.lit("")), r"[|–\-:]")[0])
    cleaned = F.coalesce(F.col(heading), F.lit(""))
    for phrase in ("(?i)Collections by", "(?i)Products by", "(?i)Collections", "(?i)Products"):
        cleaned = F.regexp_replace(cleaned, phrase, "")
    cleaned = F.trim(cleaned)
    from_host = F.split(F.regexp_replace(host(url), "^www\\.", ""), r"\.")[0]
    name = F.when(F.length(cleaned) >= 2, cleaned).otherwise(or_else(from_title, from_host, F.lit("Unknown")))
    return [from_title.alias("title_name"), cleaned.alias("heading_name"), from_host.alias("host_name"), name.alias("name")]


def logo_of(elements, brands):
    """Best-scored logo image of each page; none without a positive score."""
    src = or_else(attr("src"), attr("data-src"))
    images = elements.where("tag = 'img'").select(
        "page_id", "url", "node", src.alias("src"), F.lower(attr("alt")).alias("alt")
    ).where(F.length("src") >= 5)
    named = images.join(brands.select("page_id", F.lower("name").alias("_name")), "page_id", "left")
    score = F.when(F.col("alt").contains(F.col("_name")), rules.LOGO_BRAND_IN_ALT).otherwise(0)
    for word, points in rules.LOGO_SRC_SCORES:
        score = score + F.when(F.lower("src").contains(word), points).otherwise(0)
    return (
        named.withColumn("score", score)
        .where("score > 0")
        .groupBy("page_id")
        .agg(F.max_by(F.struct(absolute("src", "url").alias("logo"), "score"), F.struct("score", -F.col("node"))).alias("b"))
        .select("page_id", "b.logo", "b.score")
    )


# --------------------------------------------------------------------------- C7 to C11


def links(elements):
    """Links with their absolute address, text and place."""
    href = F.trim(attr("href"))
    return (
        elements.where((F.col("tag") == "a") & followable(href))
        .select(
            "page_id",
            F.col("url").alias("page_url"),
            "node",
            href.alias("href"),
            F.trim(F.coalesce("text", F.lit(""))).alias("text"),
            attr("class").alias("class"),
            attr("rel").alias("rel"),
            "in_nav",
            "in_pager",
            "in_submenu",
        )
        .withColumn("link", absolute("href", "page_url"))
        .withColumn("same_site", origin("link") == origin("page_url"))
    )


def is_pagination():
    return (
        F.col("in_pager")
        | F.col("class").contains("page")
        | F.col("href").contains("page=")
        | F.array_contains(F.split("class", " "), "next")
        | (F.col("rel") == "next")
    )


def link_kind():
    """Excluded, pagination, product, category or other."""
    address, text = F.lower("link"), F.lower("text")
    return (
        F.when(contains_any(address, rules.SITE_EXCLUDE) | contains_any(text, rules.SITE_EXCLUDE), "excluded")
        .when(is_pagination(), "pagination")
        .when(contains_any(address, rules.DETAIL_URL_PARTS) | is_product_url("link"), "product")
        .when(
            contains_any(address, rules.SITE_CATEGORY_WORDS + rules.SITE_PRODUCT_WORDS)
            | contains_any(text, rules.SITE_CATEGORY_WORDS + rules.SITE_PRODUCT_WORDS),
            "category",
        )
        .otherwise("other")
    )


def typed_links(elements):
    """One row per page and address, first occurrence, with its kind."""
    typed = links(elements).withColumn("kind", link_kind())
    return first_row(typed, ["page_id", "link"], ["node"])


def menu_links(all_links):
    """Navigation links to product pages of a general site."""
    href, text = F.lower("href"), F.lower("text")
    hit = contains_any(href, rules.PRODUCT_URL_PARTS) | contains_any(href, rules.NAV_CATEGORY_WORDS) | contains_any(text, rules.NAV_CATEGORY_WORDS)
    found = first_row(all_links.where(F.col("in_nav") & hit), ["page_id", "href"], ["node"])
    return found.where(~contains_any(F.lower("link"), rules.NAV_EXCLUDE)).select(
        "page_id", "node", "link", or_else("text", F.lit("Products")).alias("label")
    )


def hierarchy_links(all_links, label_length=None):
    """Category-like links inside the same site, all or those with labels of these lengths."""
    address, text = F.lower("link"), F.lower("text")
    words = rules.SITE_PRODUCT_WORDS + rules.SITE_CATEGORY_WORDS
    excluded = contains_any(address, rules.SITE_EXCLUDE) | contains_any(text, rules.SITE_EXCLUDE)
    hit = F.col("in_nav") | contains_any(address, words) | contains_any(text, words)
    kept = all_links.where(
        F.col("same_site") & ~excluded & hit & _within(F.length("text"), label_length)
    )
    return first_row(kept, ["page_id", "link"], ["node"]).select("page_id", "node", "link", F.col("text").alias("label"))


def catalog_links(all_links, site):
    """Collection and product pages of a catalog site."""
    on_site = all_links.where(F.col("link").contains(site))
    collection = contains_any(F.col("link"), rules.COLLECTION_URL_PARTS) & ~F.col("link").rlike("/(collections|products)$")
    product = contains_any(F.col("link"), rules.DETAIL_URL_PARTS)
    kinds = F.array_compact(F.array(F.when(collection, F.lit("collection")), F.when(product, F.lit("product"))))
    return first_row(
        on_site.select("page_id", "node", "link", F.explode(kinds).alias("kind")), ["page_id", "kind", "link"], ["node"]
    )


def counted_categories(all_links):
    """Categories written 'Name (12)', and shop categories named by their address."""
    clean = tidy("text")
    pattern = r"^(.+?)\s*\(\s*(\d+)\s*\)$"
    step = F.element_at(F.filter(F.split(path("link"), "/"), lambda s: s != ""), -1)
    by_address = (
        F.col("link").contains("/product-category/")
        & (step != "page") & ~step.rlike(r"^\d+$") & ~F.col("link").contains("uncategorized")
    )
    found = all_links.select(
        "page_id",
        "node",
        "link",
        F.nullif(F.trim(F.regexp_extract(clean, pattern, 1)), F.lit("")).alias("counted"),
        F.regexp_extract(clean, pattern, 2).try_cast("bigint").alias("products"),
        F.when(by_address, F.upper(F.regexp_replace(step, "-", " "))).alias("named"),
    ).where("counted is not null or named is not null")
    one = first_row(found, ["page_id", "link"], ["node"]).withColumn("name", F.coalesce("counted", "named"))
    first_use = one.groupBy("page_id", "name").agg(F.min("node").alias("_first"))
    return (
        one.join(first_use, ["page_id", "name"])
        .where(F.col("counted").isNotNull() | (F.col("node") == F.col("_first")))
        .select("page_id", "node", "name", "products", "link")
    )


def cap_links(typed, caps=None):
    """Links of each page: of the kinds in ``caps`` the first so many, of all other kinds every one."""
    if not caps:
        return typed
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col("kind")]
    rank = F.row_number().over(Window.partitionBy("page_id", "kind").orderBy("node"))
    return typed.withColumn("_rank", rank).where(cap.isNull() | (F.col("_rank") <= cap)).drop("_rank")


def menu_tree(elements, exclude=tuple(rules.MENU_EXCLUDE)):
    """Menu items with their sub items as main and sub category."""
    menus = {"elementor-nav-menu", "menu", "nav-menu", "primary-menu", "main-menu", "navigation"}
    lists = elements.where("tag = 'ul'").select(
        "page_id",
        F.col("node").alias("list"),
        F.col("parent").alias("list_parent"),
        (F.arrays_overlap("classes", F.array(*[F.lit(m) for m in sorted(menus)])) | (attr("id") == "primary-menu")).alias("is_menu"),
    )
    navs = elements.where("tag = 'nav'").select("page_id", F.col("node").alias("list_parent"), F.lit(True).alias("in_bar"))
    tops = lists.join(navs, ["page_id", "list_parent"], "left").where("is_menu or in_bar")
    items = elements.where("tag = 'li'").select("page_id", F.col("node").alias("item"), F.col("parent").alias("list")).join(
        tops.select("page_id", "list"), ["page_id", "list"]
    )
    anchors = links(elements).join(
        elements.where("tag = 'a'").select("page_id", "node", F.explode("ancestors").alias("item")), ["page_id", "node"]
    )
    inside = items.join(anchors, ["page_id", "item"])
    mains = inside.groupBy("page_id", "item").agg(
        F.min_by(F.struct("text", "link"), "node").alias("main"), F.max("in_submenu").alias("has_sub")
    ).where((F.length("main.text") >= 2) & ~contains_any(F.lower("main.text"), exclude))
    subs = (
        inside.where("in_submenu").join(mains, ["page_id", "item"])
        .where((F.col("text") != "") & ~contains_any(F.lower("text"), exclude))
        .select("page_id", "page_url", "node", "link", F.col("main.text").alias("main_category"), F.col("text").alias("sub_category"))
    )
    flat = inside.join(mains.where("not has_sub"), ["page_id", "item"]).groupBy("page_id", "page_url", "item").agg(
        F.min("node").alias("node"), F.min_by("main", "node").alias("main")
    ).select(
        "page_id", "page_url", "node", F.col("main.link").alias("link"),
        F.col("main.text").alias("main_category"), F.col("main.text").alias("sub_category"),
    )
    found = subs.unionByName(flat).where(F.col("link") != F.col("page_url"))
    return first_row(found, ["page_id", "link"], ["node"]).drop("page_url")


def frontier(found, visited):
    """Addresses discovered and not visited yet (C11).

    A Bloom filter of the visited addresses passes what is surely new. The rest is compared exactly, with those visited
    addresses only that a filter of the rest lets through: neither side moves whole.
    """
    links = found.select("link").distinct()
    seen = visited.select(F.col("url").alias("link")).where("link is not null")
    tested = settle(may_hold(links, bloom_filter(seen, "link"), "link"), "tested-links")
    doubtful = tested.where("_maybe").select("link")
    close = may_hold(seen, bloom_filter(doubtful, "link"), "link").where("_maybe").select("link")
    return tested.where("not _maybe").select("link").unionByName(doubtful.join(close, "link", "left_anti"))


# --------------------------------------------------------------------------- C14 to C16


def page_details(elements, site="", collection="Products"):
    """Product facts of detail pages; pages without a name or an image are dropped (C14)."""
    src = attr("src")
    on_site = F.lit(True) if not site else src.contains(site)
    not_family = ~src.contains("/family/")
    strategies = [
        (F.array_contains("classes", "opacity-100") | F.array_contains("classes", "active")) & on_site & not_family,
        src.contains("/product/") & on_site,
        ((attr("itemprop") == "image") | contains_any(attr("class"), ["product-image", "main-image"])) & src.startswith("http") & not_family,
        on_site & ~F.lower(src).contains("logo"),
    ]
    image_rank = F.lit(None).cast("int")
    for i, cond in reversed(list(enumerate(strategies))):
        image_rank = F.when(cond, F.lit(i)).otherwise(image_rank)
    is_image = (F.col("tag") == "img") & (src != "") & image_rank.isNotNull()
    text = F.trim(F.coalesce("text", F.lit("")))
    content = F.array_contains("classes", "product-description") | (attr("id") == "description") | F.array_contains("classes", "details-content")
    facts = elements.groupBy("page_id", "url").agg(
        F.min_by(text, F.when(F.col("tag") == "h1", F.col("node"))).alias("name"),
        F.min_by(src, F.when(is_image, F.struct(image_rank.alias("r"), "node"))).alias("image_url"),
        F.min_by(attr("content"), F.when((F.col("tag") == "meta") & (attr("name") == "description"), F.col("node"))).alias("meta"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when((F.col("tag") == "div") & attr("class").contains("Attribute") & (text != ""), F.struct("node", text.alias("t"))))),
                lambda a: a["t"],
            ),
            " | ",
        ).alias("attributes"),
        F.min_by(text, F.when(content & (F.length(text) > 30), F.col("node"))).alias("content"),
    )
    meta = F.coalesce("meta", F.lit(""))
    step1 = F.when((F.length(meta) < 50) & (F.col("attributes") != ""), F.col("attributes")).otherwise(meta)
    step2 = F.when((F.length(step1) < 50) & F.col("content").isNotNull(), F.col("content")).otherwise(step1)
    return facts.where((F.coalesce("name", F.lit("")) != "") & F.col("image_url").isNotNull()).select(
        "page_id",
        F.lit("Furniture").alias("main_category"),
        F.lit(collection).alias("sub_category"),
        variant_model("name", "url").alias("model"),
        or_else(step2, "name").alias("description"),
        absolute("image_url", "url").alias("image_url"),
        F.col("url").alias("product_url"),
    )


def page_texts(elements):
    """Candidate descriptions of each page in order of preference, and the meta description."""
    items = (
        _inside(elements.where("tag = 'li'"))
        .groupBy("page_id", F.col("container").alias("node"))
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("node", F.trim(F.coalesce("text", F.lit(""))).alias("t")))), lambda i: i["t"]),
                ". ",
            ).alias("listed")
        )
    )
    named = elements.select("page_id", "node", "text", F.explode(_matches(rules.DESCRIPTIONS)).alias("m")).select(
        "page_id", "node", "text", "m.rank"
    )
    first = first_row(named, ["page_id", "rank"], ["node"]).join(items, ["page_id", "node"], "left").select(
        "page_id", "rank", tidy(F.coalesce("listed", "text")).alias("text")
    )
    frames = rules.DESCRIPTION_PARAGRAPHS
    holder = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.col("tag") == tag) if tag else F.array_contains("classes", token),
                    F.struct(F.lit(len(rules.DESCRIPTIONS) + i).alias("rank"), F.lit(first_only).alias("first_only")),
                )
                for i, (_, tag, token, first_only) in enumerate(frames)
            ]
        )
    )
    boxes = elements.select("page_id", F.col("node").alias("container"), F.explode(holder).alias("m")).select("page_id", "container", "m.*")
    siblings = elements.groupBy("page_id", "parent").agg(F.min("node").alias("first_child"))
    paragraphs = (
        _inside(elements.where("tag = 'p'").join(siblings, ["page_id", "parent"]).withColumn("leads", F.col("node") == F.col("first_child")))
        .join(boxes, ["page_id", "container"])
        .where("leads or not first_only")
    )
    under = first_row(paragraphs.select("page_id", "rank", "node", "text"), ["page_id", "rank"], ["node"]).select(
        "page_id", "rank", tidy("text").alias("text")
    )
    meta = (
        elements.where((F.col("tag") == "meta") & (attr("name") == "description"))
        .groupBy("page_id")
        .agg(F.min_by(tidy(attr("content")), "node").alias("text"))
        .select("page_id", F.lit(999).alias("rank"), "text")
    )
    return first.unionByName(under).unionByName(meta)


def enrich_descriptions(products, texts, pages, text_length=None, meta_length=None):
    """Better description from the product's own page; counts follow from ``enriched``.

    Texts and meta descriptions outside (least, most) characters are passed over; empty ones always. Products whose page is not stored are ``failed``.
    """
    by_page = pages.select("page_id", F.col("url").alias("product_url"))
    usable = texts.where("text <> ''").where(F.when(F.col("rank") == 999, _within(F.length("text"), meta_length)).otherwise(_within(F.length("text"), text_length)))
    wanted = products.select("product_id", "model", "description", "product_url")
    options = wanted.join(by_page, "product_url").join(usable, "page_id")
    own_text = F.coalesce("description", F.lit(""))
    open_text = (own_text == "") | (own_text == F.col("model"))
    fits = F.when(F.col("rank") == 999, open_text).otherwise(F.col("text") != F.col("model"))
    best = options.where(fits).groupBy("product_id").agg(F.min_by("text", "rank").alias("_text"))
    stored = wanted.join(by_page.select("product_url").distinct(), "product_url", "left_semi").select("product_id", F.lit(True).alias("_stored"))
    return (
        products.join(best, "product_id", "left")
        .join(stored, "product_id", "left")
        .withColumn("enriched", F.col("_text").isNotNull())
        .withColumn("failed", F.col("_stored").isNull() & (F.coalesce("product_url", F.lit("")) != ""))
        .withColumn("description", F.coalesce("_text", "description"))
        .drop("_text", "_stored")
    )


def brand_records(products, brands, stamped_at, default_tier="mid"):
    """Brand header per harvest: slug id, tier, product count, time.

    Products stay flat beside the headers, keyed by the same id; writing partitions them.
    """
    counts = products.groupBy("brand").agg(F.count(F.lit(1)).alias("product_count"))
    header = brands.groupBy("brand").agg(F.first("logo", ignorenulls=True).alias("logo"), F.max("tier").alias("tier"))
    return counts.join(header, "brand", "left").select(
        slug("brand", "-").alias("brand_id"),
        F.col("brand").alias("name"),
        F.coalesce("logo", F.lit("")).alias("logo"),
        or_else("tier", F.lit(default_tier)).alias("tier"),
        "product_count",
        F.lit(stamped_at).cast("timestamp").alias("created_at"),
    )


