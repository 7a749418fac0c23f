"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates.

The features are n-grams of words and of word shapes, and shares of repetition, from the text alone. Defined cases:
null and empty texts get the score of a text without words; repeated rows get equal scores; rows
without an id are scored and never train; without labelled rows every score is one half.
"""

from pyspark.sql import functions as F

from billwright.llm.arrow import packed, unpacked
from billwright.llm.ftrl import labelled_sample, score, style_features, train

GOOD = 0.7
OPTIONS = {"alpha": 0.3, "lasso": 0.2, "ridge": 0.5}


def held_out(id_col="doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(docs, labels, **sample):
    """Weights from the labelled rows that aren't held out."""
    return train(labelled_sample(docs, labels, ["quality"], keep=~held_out(), **sample), "quality", style_features, **OPTIONS)


def quality_scores(docs, labels, threshold=GOOD):
    """doc_id, held_out, score, predicted for every document row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rated = score(own, fit_quality(docs, labels), style_features)
    return rated.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs, labels, threshold=GOOD):
    """The documents that the classifier doesn't reject, with their columns."""
    rated = score(packed(docs, "text"), fit_quality(docs, labels), style_features)
    return unpacked(rated.where(F.col("score") >= threshold), docs, "text")
