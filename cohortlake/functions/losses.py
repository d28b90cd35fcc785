"""Per-row classification losses over ``array<double>`` logits, and their batch reductions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlake.functions.scoring import log_softmax, log_sum_exp, once


def _floats(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def cross_entropy(logits: Column, y: Column) -> Column:
    return -(F.element_at(logits, y + 1) - log_sum_exp(logits))


def class_weight(weights: Sequence[float], y: Column) -> Column:
    return F.element_at(_floats(weights), y + 1)


def weighted_cross_entropy(logits: Column, y: Column, weights: Sequence[float] | None) -> Column:
    """Aggregate: sum(w_y * ce) / sum(w_y), so heavier classes also weigh in the denominator."""
    if weights is None:
        raise ValueError("weighted cross-entropy needs class weights")
    w = class_weight(weights, y)
    return F.sum(w * cross_entropy(logits, y)) / F.sum(w)


def smoothed_cross_entropy(logits: Column, y: Column, eps: float) -> Column:
    """(1 - eps) * ce + eps / K * sum_k(-log p_k)."""
    return once(log_softmax(logits), lambda logp: (1.0 - eps) * -F.element_at(logp, y + 1) - F.lit(eps) / F.size(logits) * _total(logp))


def focal_alpha(alpha: float) -> list[float]:
    """Class weights [alpha, 1 - alpha] of the binary focal loss."""
    return [alpha, 1.0 - alpha]


def focal(
    logits: Column, y: Column, alpha: Sequence[float] | None = None, gamma: float = 2.0, smoothing: float = 0.0
) -> Column:
    """Sum over classes of alpha_k * (1 - p_k)^gamma * (-target_k * log p_k).

    With ``smoothing`` the target spreads over all classes, so every class term counts.
    """
    k = F.size(logits)
    terms = F.transform(
        log_softmax(logits),
        lambda lp, i: F.pow(1.0 - F.exp(lp), F.lit(float(gamma)))
        * -lp
        * (F.when(i == y, 1.0).otherwise(0.0) * (1.0 - smoothing) + F.lit(float(smoothing)) / k),
    )
    if alpha is not None:
        terms = F.zip_with(terms, _floats(alpha), lambda t, a: t * a)
    return _total(terms)


def reduced(loss: Column, reduction: str) -> Column:
    """Batch reduction of a per-row loss: ``mean`` or ``sum``."""
    if reduction not in ("mean", "sum"):
        raise ValueError(f"unknown reduction {reduction}; leave the rows as they are for none")
    return F.avg(loss) if reduction == "mean" else F.sum(loss)


# fixed values: accepted loss names, without hyphens and underscores
LOSSES = {
    "ce": lambda z, y, o: F.avg(cross_entropy(z, y)),
    "weightedce": lambda z, y, o: weighted_cross_entropy(z, y, o["alpha"]),
    "cels": lambda z, y, o: F.avg(smoothed_cross_entropy(z, y, o["smoothing"])),
    "focal": lambda z, y, o: F.avg(focal(z, y, o["alpha"], o["gamma"])),
    "focalls": lambda z, y, o: F.avg(focal(z, y, o["alpha"], o["gamma"], o["smoothing"])),
}


def batch_loss(name: str, logits: Column, y: Column, alpha=None, gamma: float = 2.0, smoothing: float = 0.0) -> Column:
    """Aggregate column for a loss by its name, in any case and with any hyphens or underscores."""
    spelled = "".join(c for c in name if c.isalnum()).casefold()
    try:
        made = LOSSES[spelled]
    except KeyError:
        raise ValueError(f"unknown loss {name}, not one of {', '.join(LOSSES)}") from None
    return made(logits, y, {"alpha": alpha, "gamma": gamma, "smoothing": smoothing})
