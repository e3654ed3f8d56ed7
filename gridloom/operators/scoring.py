"""Models on tables: scoring tiles in batches, and fitting a classifier on pixel features."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.scratch import stored


def score_tiles(tiles: DataFrame, model: Callable[[np.ndarray], np.ndarray], id_col: str = "vec_id", data_col: str = "embedding") -> DataFrame:
    """id and prob for every tile: the model gets a batch of tiles (rows) and returns a probability for each."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({id_col: p[id_col], "prob": model(np.stack(p[data_col].to_numpy()).astype(np.float64))})

    return tiles.select(id_col, data_col).mapInPandas(run, f"{id_col} {tiles.schema[id_col].dataType.simpleString()}, prob double")


def fit_classifier(pixels: DataFrame, features: Sequence[str], target: str) -> PipelineModel:
    """A logistic model of the target, with classes weighted to count alike. The features are written once, as the fit reads them in every round."""
    pixels = stored(pixels.select(*features, target), "features")
    share = pixels.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0
    weight = F.when(F.col(target) > 0, 0.5 / max(share, 1e-6)).otherwise(0.5 / max(1 - share, 1e-6))
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features"), LogisticRegression(labelCol=target, weightCol="__w", maxIter=20)]
    return Pipeline(stages=stages).fit(pixels.withColumn("__w", weight))
