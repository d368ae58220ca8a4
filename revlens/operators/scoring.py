"""Running a supplied text classifier over a review column in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.labels import normalize_label
from revlens.schema import NOT_PROCESSED

Scorer = Callable[[list[str]], Sequence[tuple[str, float]]]


def softmax_scorer(logits: Callable[[list[str]], np.ndarray], labels: Sequence[str]) -> Scorer:
    """Turn a function that returns class logits into a scorer: best label, probability."""

    def score(texts: list[str]) -> list[tuple[str, float]]:
        z = np.asarray(logits(texts), dtype=float)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        p = z / z.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [(labels[j], float(p[i, j])) for i, j in enumerate(best)]

    return score


def score_batches(
    df: DataFrame,
    make_scorer: Callable[[], Scorer],
    text: str = "content_clean",
    batch_size: int = 32,
    prefix: str = "roberta",
) -> DataFrame:
    """Add ``<prefix>_sentiment`` and ``<prefix>_confidence``.

    ``make_scorer`` runs once per task, so a model is loaded once and not per batch.
    Only the text column goes to Python, whole. A batch that fails is neutral with
    confidence 0.5; rows without text stay unprocessed. Results come back as columns of
    the same row: no join on the key is needed.
    """

    @F.pandas_udf("label string, confidence double")
    def run(chunks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for chunk in chunks:
            texts = chunk.tolist()
            out: list[tuple[str | None, float]] = [(None, 0.0)] * len(texts)
            filled = [i for i, t in enumerate(texts) if t]
            for start in range(0, len(filled), batch_size):
                rows = filled[start : start + batch_size]
                try:
                    results = list(scorer([texts[i] for i in rows]))
                    if len(results) != len(rows):
                        raise ValueError("scorer returned a wrong number of results")
                except Exception:
                    results = [("neutral", 0.5)] * len(rows)
                for i, result in zip(rows, results):
                    out[i] = result
            yield pd.DataFrame(out, columns=["label", "confidence"])

    scored = df.withColumn("__scored", run(F.col(text)))
    label = F.col("__scored.label")
    return scored.withColumns(
        {
            f"{prefix}_sentiment": F.when(label.isNull(), NOT_PROCESSED).otherwise(normalize_label(label)),
            f"{prefix}_confidence": F.coalesce(F.col("__scored.confidence"), F.lit(0.0)),
        }
    ).drop("__scored")
