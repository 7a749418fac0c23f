"""Text clean-up and keys."""

from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def model_key(x, collapse=True):
    """Comparison key of a model name: lower case, ids dropped, only letters, digits and spaces."""
    key = F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"#\d+", "")
    key = F.regexp_replace(key, r"[^a-z0-9]", " ")
    if collapse:
        key = F.regexp_replace(key, r"\s+", " ")
    return F.trim(key)


def name_key(x):
    """Names compare without case and outer blanks."""
    return F.lower(F.trim(F.coalesce(_c(x), F.lit(""))))


def strip_variant(x):
    """Drop a trailing ' #digits' (N9)."""
    return F.when(_c(x).rlike(r"\s#\d+$"), F.trim(F.regexp_replace(_c(x), r"\s#\d+$", ""))).otherwise(_c(x))


def brand_name(x):
    """Collapsed blanks; a default when nothing is left."""
    clean = F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"\s+", " "))
    return F.when(clean == "", F.lit("Unnamed Brand")).otherwise(clean)


def slug(x, sep="_"):
    """Lower case with every other character replaced."""
    return F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9]", sep)


def enriched_description(description, qty, unit):
    """'description | Qty: q, Unit: u' without the empty parts."""
    def part(label, value):
        value = F.coalesce(_c(value).cast("string"), F.lit(""))
        return F.when(value != "", F.concat(F.lit(label), value))

    context = F.concat_ws(", ", part("Qty: ", qty), part("Unit: ", unit))
    return F.when(context != "", F.concat_ws(" | ", _c(description), context)).otherwise(_c(description))


def title_words(x):
    """Dashes to blanks and the first letter of every word in upper case, the rest untouched."""
    runs = F.regexp_extract_all(F.regexp_replace(_c(x), "-", " "), F.lit(r"(\w+|\W+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda w: F.concat(F.upper(w.substr(1, 1)), w.substr(F.lit(2), F.length(w)))), ""
    )


def title_case(x):
    """Dashes to blanks, every run of letters capitalised and the rest in lower case."""
    runs = F.regexp_extract_all(F.regexp_replace(_c(x), "-", " "), F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(
        F.transform(
            runs, lambda w: F.concat(F.upper(w.substr(1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))
        ),
        "",
    )


def variant_model(name, url):
    """Model name with the number that ends the page address."""
    tail = F.regexp_extract(F.regexp_replace(_c(url), r"/+$", ""), r"-(\d+)$", 1)
    return F.when(tail != "", F.concat(_c(name), F.lit(" #"), tail)).otherwise(_c(name))


def tidy(x):
    """Line breaks and runs of blanks to one blank."""
    return F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"\s+", " "))


def tidy_list(items):
    """List items joined with '. ' (N24)."""
    return tidy(F.array_join(F.transform(_c(items), lambda i: F.trim(i)), ". "))


def strip_room(x, every=False):
    """Drop one leading '[…]' or all of them."""
    pattern = r"^(\[.*?\]\s*)+" if every else r"^\[.*?\]\s*"
    return F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), pattern, ""))


def contains_any(x, words):
    """True when the text holds one of a short list of words."""
    hit = F.lit(False)
    for word in words:
        hit = hit | _c(x).contains(word)
    return F.coalesce(hit, F.lit(False))


def count_words(x, words):
    """How many of the words the text holds."""
    total = F.lit(0)
    for word in words:
        total = total + F.coalesce(_c(x).contains(word), F.lit(False)).cast("int")
    return total
