"""Batch scoring: a user model over slab or feature rows, keyed so that no positional join is needed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.scoring import softmax


def score(
    rows: DataFrame, keys: list[str], features: str, load_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    batch: int = 256, threshold: float = 0.5,
) -> DataFrame:
    """keys, logits, probs and pred.  ``load_model`` runs once per task and returns features -> logits."""
    kinds = dict(rows.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                piece = pdf.iloc[at : at + batch]
                logits = model(np.stack(piece[features].to_numpy()))
                yield piece[keys].assign(logits=list(np.asarray(logits, dtype=float)))

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", logits array<double>"
    scored = rows.select(*keys, features).mapInPandas(run, schema).withColumn("probs", softmax(F.col("logits")))
    return scored.withColumn("pred", F.when(F.col("probs")[1] >= threshold, 1).otherwise(0))
