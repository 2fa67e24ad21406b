"""A model with known weights for the registered queries and tests, whose data comes without one."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import StandardScalerModel, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import SparkSession

from matchpulse import schemas

# Weights of the example model, for data whose real model is not at hand.
EXAMPLE_MEAN = [2.5, 2.5, 250.0, 250.0, 0.5, 57.5, 5.0, 300.0, 5.0, 300.0]
EXAMPLE_STD = [1.5, 1.5, 150.0, 150.0, 0.5, 33.0, 4.0, 200.0, 4.0, 200.0]
EXAMPLE_WEIGHTS = [0.9, -0.9, 0.6, -0.6, -0.5, 0.1, 0.3, 0.2, -0.3, -0.2]
EXAMPLE_INTERCEPT = 0.05


def model_from_weights(
    spark: SparkSession, mean: list[float], std: list[float], weights: list[float], intercept: float
) -> PipelineModel:
    """Assembler, scaler and logistic regression with given parameters instead of fitted ones.

    PySpark has no public constructor for a model with chosen weights, hence the JVM calls.
    """
    ml = spark.sparkContext._jvm.org.apache.spark.ml
    vector = lambda values: _py2java(spark.sparkContext, Vectors.dense(values))
    assembler = VectorAssembler(inputCols=list(schemas.FEATURES), outputCol="features")
    scaler = StandardScalerModel(ml.feature.StandardScalerModel("scaler", vector(std), vector(mean)))
    scaler.setInputCol("features").setOutputCol("scaled_features")
    scaler.set(scaler.withMean, True)
    regression = LogisticRegressionModel(
        ml.classification.LogisticRegressionModel("regression", vector(weights), float(intercept))
    ).setFeaturesCol("scaled_features")
    return PipelineModel([assembler, scaler, regression])


def example_model(spark: SparkSession) -> PipelineModel:
    return model_from_weights(spark, EXAMPLE_MEAN, EXAMPLE_STD, EXAMPLE_WEIGHTS, EXAMPLE_INTERCEPT)
