"""A training corpus from raw documents: filter, de-duplicate, mix and pack.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of
``documents``; the last returns the layout of the packed sequences.  ``run`` writes each stage's result as
Parquet to the shared folder and reads it back, so a lost executor costs one stage's part at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlake.llm import jaccard, mixing, packing, suffixes, toxicity
from cohortlake.llm.common import released, stored, table


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1,024 tokens: one row per piece of a document; repeated rows are documents of their own."""
    import public_tokenizers

    return packing.packed_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity.without_toxic),
    ("ngram_jaccard", jaccard.one_of_groups),
    ("suffix_dedup", suffixes.without_repeats),
    ("temperature_mix", mixing.remixed),
    ("best_two_fit", packed),
]

#: The classifier, the suffix work and the packing can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        if last is not None:
            released(last)
        last = docs
    return docs
