"""Small helpers around Arrow batches inside tasks."""

import pyarrow as pa
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between the JVM and a Python worker, about.
BATCH_BYTES = 4 << 20


def bounded_batches(spark):
    """From now on batches of this session are cut by bytes too. By rows alone (10,000) a batch of texts takes many times that, in the JVM and in each worker, which keeps it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def replaced(batch, **columns):
    """The batch with these columns exchanged; each keeps its place and type."""
    arrays = list(batch.columns)
    for name, values in columns.items():
        i = batch.schema.get_field_index(name)
        arrays[i] = values if isinstance(values, pa.Array) else pa.array(values, type=batch.schema.field(i).type)
    return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)


def pieces(batches, text_col, rows=2000, size=16 << 20):
    """Cut batches so that one piece holds a bounded number of rows and, a single long text aside, of text bytes."""
    for batch in batches:
        lengths = [len(t) if t is not None else 0 for t in batch.column(text_col).to_pylist()]
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and (i - start >= rows or held + n > size):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)


def packed(docs, text_col):
    """(row, text): all other columns in one struct, so that working columns can't clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), F.col(f"`{text_col}`").alias("text"))


def unpacked(frame, docs, text_col, **more):
    """The columns of docs back in their order, the text from ``text``; columns named in ``more`` replace namesakes or follow."""
    own = [more.pop(c).alias(c) if c in more else F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return frame.select(*own, *[c.alias(n) for n, c in more.items()])
