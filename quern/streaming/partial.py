"""Learning from streams: each micro-batch is one partial_fit of an estimator that the driver keeps."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def learner(estimator, path: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for estimators with partial_fit (SGDClassifier, SGDRegressor, MiniBatchKMeans).

    Batches that a restart hands over again are skipped by their number; with a path the estimator is saved after each.
    """
    seen = {"last": -1}

    def each(batch: DataFrame, number: int) -> None:
        if number <= seen["last"] or batch.isEmpty():
            return
        estimator.partial_fit(batch)
        seen["last"] = number
        if path:
            estimator.save(f"{path}.new")
            os.replace(f"{path}.new", path)

    return each


def learn(stream: DataFrame, estimator, checkpoint: str, path: str | None = None) -> DataStreamWriter:
    """The writer of a stream (id, features, label or target) into an estimator; start it with a trigger of choice."""
    return stream.writeStream.foreachBatch(learner(estimator, path)).option("checkpointLocation", checkpoint)
