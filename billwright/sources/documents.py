"""Brand documents as a Spark data source: one row per product, filters on the header pushed to the scan.

    spark.dataSource.register(BrandDocuments)
    spark.read.format("brand_documents").option("paths", "/shared/remote;/shared/local").load()

A document is one JSON object with a ``products`` list of any length. The planner packs small files into partitions of about
``PARTITION_BYTES``; a reader walks a document product by product, so its memory is one product and not the document.
Documents that are not JSON or have no id give no rows, and of several documents with one id only the first one counts: the
folder named first, then the file name. A document without products gives one row without a position. Filters ``tier = x``,
``brand_id = x`` and ``brand = x`` are answered from the header, and products of other documents are never decoded into rows.

Files are opened by path, so the folders must be mounted on all executors; ``brands.read_brand_documents`` reads
whole documents through Spark's own readers from anywhere.
"""

import json
import os
import re

from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

PARTITION_BYTES = 32 << 20
_PIECE = 1 << 16
_SPACE = re.compile(r"[ \t\r\n]*")
HEADER = {"id": "brand_id", "name": "brand", "budgetTier": "tier", "logo": "logo", "origin": "origin"}
PRODUCT = {
    "mainCategory": "main_category", "subCategory": "sub_category", "family": "family", "model": "model", "description": "description",
    "imageUrl": "image_url", "productUrl": "product_url", "price": "price",
}
COLUMNS = ["path_rank", "file", *HEADER.values(), "pos", *PRODUCT.values()]


class _Document:
    """Walks over one JSON object in a file without holding its lists."""

    def __init__(self, handle):
        self.handle, self.text, self.at, self.decode = handle, "", 0, json.JSONDecoder().raw_decode

    def _more(self):
        piece = self.handle.read(max(_PIECE, len(self.text) - self.at))  # grows with an unfinished value
        self.text, self.at = self.text[self.at :] + piece, 0
        return bool(piece)

    def _sign(self):
        """The next character that is no white space; not taken."""
        while True:
            self.at = _SPACE.match(self.text, self.at).end()
            if self.at < len(self.text):
                return self.text[self.at]
            if not self._more():
                raise ValueError("the document ends early")

    def _take(self, *signs):
        sign = self._sign()
        if sign not in signs:
            raise ValueError(f"{sign!r} is not expected")
        self.at += 1
        return sign

    def _value(self):
        self._sign()
        while True:
            try:
                value, end = self.decode(self.text, self.at)
                if end < len(self.text):  # a number at the end of a piece may go on
                    self.at = end
                    return value
            except json.JSONDecodeError:
                value = None
            if not self._more():
                raise ValueError("a value is not JSON")

    def walk(self, key="products"):
        """("products", element) for every element of that list, (name, value) for all other fields; a ``products`` that is no list has no name."""
        self._take("{")
        if self._sign() == "}":
            return
        while True:
            name = self._value()
            self._take(":")
            if name == key and self._sign() == "[":
                self._take("[")
                if self._sign() == "]":
                    self._take("]")
                else:
                    while True:
                        yield key, self._value()
                        if self._take(",", "]") == "]":
                            break
            else:
                yield ("" if name == key else name), self._value()
            if self._take(",", "}") == "}":
                return


def header_of(path):
    """The header fields of a document and its number of products; None if it is malformed or has no id."""
    found, products = {}, 0
    try:
        with open(path, encoding="utf-8") as handle:
            for name, value in _Document(handle).walk():
                if name == "products":
                    products += 1
                elif name in HEADER:
                    found[name] = value
    except (ValueError, RecursionError):
        return None
    if found.get("id") in (None, ""):
        return None
    return {HEADER[k]: _text(v) for k, v in found.items()}, products


def _text(value):
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


class _Files(InputPartition):
    def __init__(self, files):
        super().__init__(0)
        self.files = files


class BrandReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(";") if p]
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))
        self.suffix = options.get("suffix", ".json")
        self.only = []

    def pushFilters(self, filters):
        """Header filters choose the documents; all filters stay with the engine too, which then finds little to do."""
        for one in filters:
            if isinstance(one, EqualTo) and one.attribute[0] in HEADER.values():
                self.only.append((one.attribute[0], one.value))
            yield one

    def partitions(self):
        """Files in the order of their folders and names, packed by size."""
        packs, held, size = [], [], 0
        for rank, folder in enumerate(self.paths):
            folder = folder.removeprefix("file://").removeprefix("file:")
            names = [os.path.join(at, name) for at, _, names in os.walk(folder) for name in names if name.endswith(self.suffix)]
            for path in sorted(names):
                held.append((rank, os.path.relpath(path, folder), path))
                size += os.path.getsize(path)
                if size >= self.size:
                    packs.append(_Files(held))
                    held, size = [], 0
        return packs + ([_Files(held)] if held else []) or [_Files([])]

    def read(self, partition):
        for rank, name, path in partition.files:
            found = header_of(path)
            if found is None or any(found[0].get(column) != value for column, value in self.only):
                continue
            head = (rank, name, *(found[0].get(column) for column in HEADER.values()))
            if not found[1]:
                yield (*head, None, *[None] * len(PRODUCT))
                continue
            with open(path, encoding="utf-8") as handle:
                pos = 0
                for field, value in _Document(handle).walk():
                    if field == "products":
                        product = value if isinstance(value, dict) else {}
                        yield (*head, pos, *(_text(product.get(key)) for key in PRODUCT))
                        pos += 1


class BrandDocuments(DataSource):
    @classmethod
    def name(cls):
        return "brand_documents"

    def schema(self):
        kinds = {"path_rank": "int", "pos": "int"}
        return ", ".join(f"{c} {kinds.get(c, 'string')}" for c in COLUMNS)

    def reader(self, schema):
        return BrandReader(self.options)


def scan_brands(spark, paths, **options):
    """Product rows of the documents in the folders; the first document of an id wins."""
    spark.dataSource.register(BrandDocuments)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = spark.read.format("brand_documents").option("paths", ";".join(paths)).options(**options)
    place = F.struct("path_rank", "file")
    first = source.load().groupBy("brand_id").agg(F.min(place).alias("_first"))  # a scan of its own: filters are pushed to the other
    own = source.load().join(first, "brand_id").where(place == F.col("_first"))
    return own.drop("path_rank", "file", "_first")
