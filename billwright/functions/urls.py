"""Web addresses and image links."""

from pyspark.sql import functions as F

from billwright import rules
from billwright.functions.numbers import blank, or_else
from billwright.functions.text import contains_any, title_case


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def origin(url):
    """Scheme and host."""
    return F.regexp_extract(_c(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def host(url):
    return F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url):
    return F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _drop_dots(p):
    """Resolve '.' and '..' steps of an absolute path."""
    steps = F.split(p, "/")
    kept = F.aggregate(
        F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(p.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), tail)


def absolute(href, base):
    """Resolve a link against the page it stands on."""
    href, base = F.trim(_c(href)), _c(base)
    folder = F.regexp_replace(F.when(path(base) == "", F.lit("/")).otherwise(path(base)), r"[^/]*$", "")
    own_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    rooted = F.when(href.startswith("/"), own_path).otherwise(F.concat(folder, own_path))
    clean = F.when(rooted.rlike(r"/\.{1,2}(/|$)"), _drop_dots(rooted)).otherwise(rooted)
    page = F.concat(origin(base), F.when(path(base) == "", F.lit("/")).otherwise(path(base)))
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href == "", F.concat(page, query))
        .when(href.startswith("#"), F.concat(page, query, href))
        .when(href.startswith("?"), F.concat(page, href))
        .otherwise(F.concat(origin(base), clean, rest))
    )


def followable(href):
    """Links that lead to a page: not empty, not '#', not script."""
    href = _c(href)
    return ~blank(href) & (href != "#") & ~F.lower(href).startswith("javascript")


def is_good_image(url):
    """Secure, public and with an image suffix."""
    url = F.coalesce(_c(url), F.lit(""))
    return url.startswith("https://") & ~url.contains("localhost") & url.rlike(rules.IMAGE_SUFFIX)


def image_or_logo(url, logo):
    """The image when it is good, else the brand logo, else '' (N15)."""
    return F.when(is_good_image(url), _c(url)).otherwise(F.coalesce(_c(logo), F.lit("")))


def is_trusted_image(url, brand, domains=rules.TRUSTED_IMAGE_DOMAINS):
    """Image file on a known domain or one that carries the brand name."""
    url = F.coalesce(_c(url), F.lit(""))
    lower, brand = F.lower(url), F.lower(F.coalesce(_c(brand), F.lit("")))
    file_name = F.regexp_extract(url, r"^([^?]*)", 1)
    known = contains_any(lower, domains) | ((brand != "") & lower.contains(brand))
    return url.startswith("http") & (url != "FAILED") & file_name.rlike(rules.IMAGE_FILE) & known


def is_product_image(url, words=rules.NOT_PRODUCT_IMAGE):
    """At least ten characters and none of the page-furniture words."""
    url = F.coalesce(_c(url), F.lit(""))
    return (F.length(url) >= 10) & ~contains_any(F.lower(url), words)


def is_product_url(url):
    """Address that looks like a product page."""
    url = F.coalesce(_c(url), F.lit(""))
    hit = contains_any(F.lower(url), rules.PRODUCT_URL_PARTS)
    for pattern in rules.PRODUCT_URL_PATTERNS:
        hit = hit | url.rlike(pattern)
    return hit & (url != "")


def shop_categories(url):
    """Main and sub category from a shop address: first and last step, title case."""
    steps = F.filter(F.split(path(url), "/"), lambda s: (s != "") & (s != "product-category"))
    first, last = title_case(F.get(steps, F.lit(0))), title_case(F.get(steps, F.size(steps) - 1))
    found = ((F.size(steps) >= 2) & (first != last)) | (F.size(steps) == 1)
    return F.struct(F.when(found, first).alias("main"), F.when(found, last).alias("sub"))


def catalog_categories(url, default_sub, default_family):
    """Sub category and family from a catalog address: first and second step before the name."""
    steps = F.filter(
        F.split(path(url), "/"), lambda s: (s != "") & (s != "product-category") & (s != "product")
    )
    groups = F.filter(
        F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0))), lambda s: s != "products"
    )

    def label(i):
        return F.regexp_replace(F.upper(F.get(groups, F.lit(i))), "-", " ")

    return F.struct(
        F.coalesce(label(0), _c(default_sub)).alias("sub"),
        F.coalesce(label(1), _c(default_family)).alias("family"),
    )


def logo_domain(name, website):
    """Host of the brand site, else a guess from the name; null for blank names."""
    clean = F.trim(F.coalesce(_c(name), F.lit("")))
    site = F.split(F.regexp_replace(F.coalesce(_c(website), F.lit("")), r"^https?://", ""), "/")[0]
    guess = F.concat(F.regexp_replace(F.lower(clean), r"[^a-z0-9]", ""), F.lit(".com"))
    usable = (clean != "") & (clean != "-") & (F.lower(clean) != "n/a")
    return F.when(usable, F.when(site.contains("."), site).otherwise(guess))


def option_value(product_url, image_url, fallback):
    """Stable value of a catalog choice: page, image, else a made-up id."""
    return F.coalesce(or_else(product_url, image_url), _c(fallback))
