"""Model inference over frames: a scorer runs on Arrow batches; a steady stand-in serves where no model is at hand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DETECTIONS = "array<struct<class_name:string,confidence:double,bbox:struct<x1:int,y1:int,x2:int,y2:int>>>"
CLASSES = ("Pothole", "Crack", "Sign", "Barrier", "Light", "Marking")


def infer(frames: DataFrame, scorer: Callable[[pd.DataFrame], list], batch_cols: list[str]) -> DataFrame:
    """``frames`` with ``detections``: ``scorer`` gets batches of ``batch_cols`` and gives a list for each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(detections=scorer(b[batch_cols]))

    schema = ", ".join([f"`{c}` {t}" for c, t in frames.dtypes] + [f"detections {DETECTIONS}"])
    return frames.mapInPandas(run, schema)


def stand_in(frames: DataFrame, key: str) -> DataFrame:
    """One to four detections that depend on the key alone, without Python."""
    h = lambda i, salt: F.pmod(F.xxhash64(F.col(key), i, F.lit(salt)), F.lit(1000))
    names = F.array(*[F.lit(c) for c in CLASSES])

    def one(i):
        x, y = (h(i, "x") % 500).cast("int"), (h(i, "y") % 300).cast("int")
        box = F.struct(x.alias("x1"), y.alias("y1"), (x + 100).alias("x2"), (y + 80).alias("y2"))
        return F.struct(F.get(names, (h(i, "c") % len(CLASSES)).cast("int")).alias("class_name"), (0.25 + h(i, "p") / 1000 * 0.75).alias("confidence"), box.alias("bbox"))

    return frames.withColumn("detections", F.transform(F.sequence(F.lit(1), (1 + h(F.lit(0), "n") % 4).cast("int")), one))


def fan_out(frames: DataFrame, models: list[str]) -> DataFrame:
    """Every frame for every model, by an array of the models, without a join."""
    return frames.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def with_probabilities(frames: DataFrame, features: list[str], weights: list[list[float]], bias: list[float], batch: int = 4096, out: str = "probabilities") -> DataFrame:
    """``frames`` with the probability of each class by a linear model, ``weights`` having a row of features a class.

    Weights are broadcast once; each Python worker builds the model once and gets the features as matrices of ``batch``
    rows.  A row with a missing feature has no probabilities (null).
    """
    import numpy as np
    from pyspark.ml.functions import predict_batch_udf

    sent = frames.sparkSession.sparkContext.broadcast((np.array(weights, float), np.array(bias, float)))

    def build():
        w, b = sent.value

        def predict(rows: np.ndarray) -> np.ndarray:
            return 1 / (1 + np.exp(-(rows.reshape(len(rows), -1) @ w.T + b)))

        return predict

    run = predict_batch_udf(build, return_type=T.ArrayType(T.DoubleType()), batch_size=batch, input_tensor_shapes=[[len(features)]])
    given = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    whole = F.lit(True)
    for c in features:
        whole = whole & F.col(c).isNotNull()
    return frames.withColumn(out, F.when(whole, run(given)))


def detected(frames: DataFrame, classes: list[str], least: float = 0.25, probabilities: str = "probabilities") -> DataFrame:
    """``frames`` with ``detections`` (class_name, confidence) of the classes whose probability is ``least`` or more, by class."""
    names = F.array(*[F.lit(c) for c in classes])
    pairs = F.transform(F.coalesce(F.col(probabilities), F.array().cast("array<double>")), lambda p, i: F.struct(F.get(names, i).alias("class_name"), p.alias("confidence")))
    return frames.withColumn("detections", F.filter(pairs, lambda d: d["confidence"] >= least))
