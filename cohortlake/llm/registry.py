"""Queries of the corpus operators and of the pipeline, next to their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline
from cohortlake.llm import fingerprints, graphs, jaccard, language, mixing, packing, periodic, sharding, spelling, suffixes, token_files, toxicity, warc

MODULES = (sharding, jaccard, packing, warc, toxicity, graphs, language, suffixes, fingerprints, mixing, spelling, token_files, periodic)

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
