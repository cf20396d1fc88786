"""Scoring rows with trained models."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def predict(df: DataFrame, model: Transformer, output: str = "prediction") -> DataFrame:
    """Predictions of a pyspark.ml model beside the rows."""
    return model.transform(df).withColumnRenamed(output, "prediction")


def decision_values(df: DataFrame, model: Transformer, raw: str = "rawPrediction") -> DataFrame:
    """Decision function of a binary pyspark.ml classifier: the raw score of its positive class."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df)
    return scored.withColumn("decision_function_values", vector_to_array(F.col(raw))[1])


def score_batches(
    df: DataFrame,
    model: object,
    features: list[str],
    method: str = "predict",
    output: str | None = None,
    call: Callable[[object, pd.DataFrame], object] | None = None,
) -> DataFrame:
    """Score with any Python model that has ``predict`` or ``decision_function``.

    The model is sent to the executors once; rows stream through in Arrow batches.
    """
    column = output or ("decision_function_values" if method == "decision_function" else "prediction")
    # Packed by value, so that the class of the model need not be installed on the executors.
    shared = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    schema = T.StructType([*df.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = pickle.loads(shared.value)  # noqa: S301
        for batch in batches:
            inputs = batch[features]
            scores = call(scorer, inputs) if call else getattr(scorer, method)(inputs)
            yield batch.assign(**{column: scores})

    return df.mapInPandas(run, schema)
