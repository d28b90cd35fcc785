"""Array expressions over class logits: softmax, decisions, scored-prediction records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row.

    A lambda works out anew, for every element, all that its body names: a figure of the whole array inside it
    would cost the square of the array's length.  An array of one element hands it over as a variable.
    """
    return F.transform(F.array(value), use)[0]


def log_sum_exp(logits: Column) -> Column:
    return once(F.array_max(logits), lambda top: top + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))))


def log_softmax(logits: Column) -> Column:
    """log-probabilities, shifted by the maximum so that large logits stay finite."""
    return once(log_sum_exp(logits), lambda lse: F.transform(logits, lambda v: v - lse))


def softmax(logits: Column) -> Column:
    return F.transform(log_softmax(logits), F.exp)


def argmax(values: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def threshold_decision(prob: Column, threshold: float = 0.5) -> Column:
    return F.when(prob >= threshold, 1).otherwise(0)


def single_logit(logit: Column) -> tuple[Column, Column]:
    """(probability, decision) of a one-output model: sigmoid, and logit > 0."""
    return 1.0 / (1.0 + F.exp(-logit)), F.when(logit > 0, 1).otherwise(0)


def class_probabilities(names: list[str], probs: Column) -> Column:
    """array<struct<class_name, probability>> in class order."""
    labels = F.array(*[F.lit(n) for n in names])
    return F.zip_with(labels, probs, lambda n, p: F.struct(n.alias("class_name"), p.alias("probability")))


def prediction_record(patient: Column, model: str, names: list[str], logits: Column) -> Column:
    """Nested record of one scored scan, from raw logits; made once a row, whichever of its fields are read."""
    return once(softmax(logits), lambda probs: F.struct(
        patient.alias("patient_id"),
        F.lit(model).alias("model_name"),
        class_probabilities(names, probs).alias("probabilities"),
        F.lit(None).cast("string").alias("segmentation_path"),
        F.create_map(F.lit("confidence"), F.array_max(probs)).alias("metrics"),
    ))
