"""A corpus pipeline of five operators: language ID, exact and near dedup, repeats, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from loomspark.llm import exact_dedup, langid, packing, simhash, suffix_dedup
from loomspark.llm.common import free_shuffles, materialize, release, table


def language_id(spark, docs, sf_dir):
    """Fit on the labelled documents; those whose text has no letter go, also where no row has a language."""
    return langid.keep_identified(docs, langid.train(docs))


def exact(spark, docs, sf_dir):
    """Of equal texts (white space aside) the least doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark, docs, sf_dir):
    """Of each group of near copies the least doc_id stays."""
    return simhash.drop_near_copies(docs)


def repeats(spark, docs, sf_dir):
    """Passages of 100 bytes and more that occur earlier are cut out; emptied documents go."""
    return suffix_dedup.drop_repeats(docs)


def packed(spark, docs, sf_dir):
    """Sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("suffix_dedup", repeats), ("packing", packed)]

#: Several stages are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; the pieces of the packed sequences."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        out = materialize(stage(spark, docs, sf_dir), "stage")
        release(docs)
        free_shuffles(spark)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
