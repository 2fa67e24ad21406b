"""Win probabilities from feature rows with a fitted ML pipeline."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREDICTION_COLUMNS = ["session_key", "round_num", "event_timestamp", "prob_ct_win"]


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def with_probability(features: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``prob_ct_win``, the second entry of the probability vector; the ML columns are dropped."""
    return (
        model.transform(features)
        .withColumn("prob_ct_win", vector_to_array(F.col("probability"), "float64")[1])
        .select(*features.columns, "prob_ct_win")
    )


def score(features: DataFrame, model: PipelineModel) -> DataFrame:
    return with_probability(features, model).select(*PREDICTION_COLUMNS)


def encode_predictions(predictions: DataFrame) -> DataFrame:
    """Key and JSON value per prediction; seconds become milliseconds."""
    return predictions.select(
        F.col("session_key").alias("key"),
        F.to_json(
            F.struct(
                F.col("session_key").alias("sessionKey"),
                F.col("round_num").alias("round"),
                F.col("prob_ct_win").alias("probCtWin"),
                (F.col("event_timestamp") * 1000).alias("timestamp"),
            )
        ).alias("value"),
    )
