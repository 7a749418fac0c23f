"""Corpus pipeline: quality, near duplicates, test passages, personal data, mixture.

Each stage reads what its predecessor kept, written as Parquet, and its decision takes effect: rejected, repeated
and contaminated documents go, personal data is masked, and the last stage adds the rate at which
a document is drawn. All stages but the last return the columns of documents.
"""

from billwright.llm import decontamination, jaccard, mixing, pii, quality
from billwright.llm.queries import labelled_domains
from billwright.operators.settle import settle


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_documents(spark, docs, sf_dir):
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def distinct_documents(spark, docs, sf_dir):
    """One document of each group of near duplicates."""
    return jaccard.deduplicate(docs)


def clean_of_tests(spark, docs, sf_dir):
    """Documents without a passage of a test item."""
    return decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"), remove="documents")


def without_personal_data(spark, docs, sf_dir):
    """Documents with personal data masked."""
    return pii.mask(docs, settle=settle)


def mixed_to_targets(spark, docs, sf_dir):
    """Documents with the rates that give every language the same number of tokens."""
    return mixing.mixed(docs, labelled_domains(docs, _table(spark, sf_dir, "labels")), settle=settle)


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", distinct_documents),
    ("benchmark decontamination", clean_of_tests),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixed_to_targets),
]
#: The classifier and the signatures can't be put as SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
