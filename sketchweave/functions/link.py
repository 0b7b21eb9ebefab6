"""Links, losses and gradients as columns.  Class vectors are arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The smallest logit that the arg-max takes for larger than none.
FLOOR = 1.17549435e-38
CLAMP, LOG_SHIFT = 1e-15, 1e-10


def binary_label(label: Column) -> Column:
    """-1 and +1 to 0 and 1."""
    return ((label + 1) / 2).cast("int")


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def log_likelihood(y: Column, p: Column) -> Column:
    """ln p if y is 1, ln(1 - p) if it is 0; the probability is clamped, in the loss only."""
    q = F.least(F.greatest(p, F.lit(CLAMP)), F.lit(1 - CLAMP))
    return F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it (a lambda repeats what stands in it)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax(z: Column) -> Column:
    """Linear in the number of classes: the largest logit, the exponentials and their sum are computed once."""
    share = lambda e: bind(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda s: F.transform(e, lambda x: x / s))
    return bind(F.array_max(z), lambda top: bind(F.transform(z, lambda x: F.exp(x - top)), share))


def argmax_floor(z: Column) -> Column:
    """First index of the largest logit; 0 if none is over the smallest positive float."""
    top = F.array_max(z)
    return F.when(top > F.lit(FLOOR), (F.array_position(z, top) - 1).cast("int")).otherwise(F.lit(0))


def max_floor(z: Column) -> Column:
    return F.greatest(F.array_max(z), F.lit(FLOOR))


def cross_entropy(p: Column, label: Column) -> Column:
    return F.log(F.element_at(p, label + 1) + LOG_SHIFT)


def softmax_gradient(p: Column, label: Column) -> Column:
    return F.transform(p, lambda x, c: x - F.when(c == label, 1.0).otherwise(0.0))


def hard_threshold(w: Column, minimum: Column, digits: int | None = None) -> Column:
    """w where its size reaches the minimum, else 0; compared at ``digits`` decimals, so that the
    last bits of a sum, which depend on its order, decide nothing."""
    size = F.abs(w) if digits is None else F.round(F.abs(w), digits)
    least = minimum if digits is None else F.round(minimum, digits)
    return F.when(size >= least, w).otherwise(F.lit(0.0))


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def median_of(values: list[Column]) -> Column:
    """Median of a fixed number of columns: the middle, or the mean of the two middles."""
    n = len(values)
    if n == 1:
        return values[0]
    if n == 3:
        return median3(*values)
    s = F.array_sort(F.array(*values))
    return F.element_at(s, n // 2 + 1) if n % 2 else (F.element_at(s, n // 2) + F.element_at(s, n // 2 + 1)) / 2
