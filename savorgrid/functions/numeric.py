"""Smooth curves and small arithmetic used by features and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def sigmoid(x: Column, center: float = 0.0, steepness: float = 1.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-float(steepness)) * (x - F.lit(float(center)))))


def bell(x: Column, center: float, width: float) -> Column:
    d = x - F.lit(float(center))
    return F.exp(-(d * d) / F.lit(2.0 * width * width))


def confidence(reviews: Column, min_reviews: int = 10, half: float = 50.0) -> Column:
    """Trust in a rating by sample size: linear below ``min_reviews``, then 1 - 1/sqrt(1 + n/half)."""
    n = reviews.cast("double")
    return F.when(n < min_reviews, F.lit(0.3) * (n / F.lit(float(min_reviews)))).otherwise(
        F.lit(1.0) - F.lit(1.0) / F.sqrt(F.lit(1.0) + n / F.lit(float(half)))
    )


def soft_threshold(value: Column, threshold: float, transition: float = 0.2) -> Column:
    return sigmoid(value, threshold, 4.0 / (threshold * transition))


def normalised_weights(weights: Column) -> Column:
    """Scale the positive entries of a weight map so that they sum to one."""
    total = F.aggregate(
        F.map_values(weights),
        F.lit(0.0),
        lambda acc, w: acc + F.when(w > 0, w).otherwise(F.lit(0.0)),
    )
    scaled = F.transform_values(weights, lambda _, w: F.when(w > 0, w / F.nullif(total, F.lit(0.0))).otherwise(w))
    return F.when(total == 0, weights).otherwise(scaled)


def log_reviews(reviews: Column) -> Column:
    return F.log1p(F.coalesce(reviews, F.lit(0)).cast("double"))


def rating_to_logit(rating: Column) -> Column:
    p = (clamp(rating, 1.01, 4.99) - F.lit(1.0)) / F.lit(4.0)
    return F.log(p / (F.lit(1.0) - p))


def logit_to_rating(z: Column) -> Column:
    return F.lit(4.0) / (F.lit(1.0) + F.exp(-z)) + F.lit(1.0)


def half_even(x: Column, places: int) -> Column:
    """Round half to even; noise in the last bits of a mean must not decide a tie."""
    return F.bround(F.round(x, 9), places)
