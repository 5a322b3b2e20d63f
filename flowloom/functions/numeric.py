"""Numeric column rules."""

from pyspark.sql import functions as F


def finite(col):
    """NaN and both infinities become NULL."""
    return F.when(~F.isnan(col) & (F.abs(col) != F.lit(float("inf"))), col)


def signed_log(col):
    return F.signum(col) * F.log1p(F.abs(col))


def ratio(top, bottom):
    """Quotient that is 0 where the divisor is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def confidence(prob):
    return F.abs(prob - 0.5) * 2


def entropy(probs):
    """Uncertainty of a list of class probabilities, higher is less sure."""
    total = F.lit(0.0)
    for p in probs:
        total = total - p * F.log(p + F.lit(1e-10))
    return total


def margin(probs):
    """Negative gap between the two largest class probabilities."""
    ranked = F.sort_array(F.array(*probs), asc=False)
    return ranked[1] - ranked[0]


def softmax(logits):
    """Class probabilities, shifted by the largest logit so exp cannot overflow."""
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    powers = [F.exp(x - top) for x in logits]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def log_softmax(logits):
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    powers = [F.exp(x - top) for x in logits]
    total = sum(powers[1:], powers[0])
    return [x - top - F.log(total) for x in logits]
