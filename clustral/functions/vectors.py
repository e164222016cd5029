"""Vector columns: arithmetic, quantisation and distances on ARRAY<BIGINT>, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scale of the entropy, Jaccard and Dice distances, and the least share of a bit (both of SCALE); fixed values.
SCALE, LEAST = 1_000_000, 1_000
#: The range that text input is quantised to by default; fixed value.
MAXVAL = 214_748_364


def _sum(values: Column, kind: str = "bigint") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda s, x: s + x.cast(kind))


def half_up(numerator: Column, denominator: Column) -> Column:
    """The quotient of integers, rounded to the nearest, halves up, without floating point."""
    return F.floor((F.lit(2) * numerator + denominator).cast("decimal(38,0)") / (F.lit(2) * denominator)).cast("bigint")


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def total(v: Column) -> Column:
    return _sum(v)


def mean(v: Column) -> Column:
    """A vector's mean element, halves up."""
    return F.floor(_sum(v) / F.size(v) + 0.5).cast("bigint")


def midpoint(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.floor((x + y) / 2).cast("bigint"))


def squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance (BIGINT)."""
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclid(a: Column, b: Column) -> Column:
    """Euclidean distance, cut to an integer."""
    return F.floor(F.sqrt(squared(a, b).cast("double"))).cast("bigint")


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def _binary(a: Column, b: Column, weight: int) -> Column:
    differ = _sum(F.zip_with(a, b, lambda x, y: (x != y).cast("bigint")))
    both = _sum(F.zip_with(a, b, lambda x, y: ((x != 0) & (x == y)).cast("bigint")))
    below = differ + F.lit(weight) * both
    return F.when(below == 0, F.lit(0).cast("bigint")).otherwise(F.floor(F.lit(SCALE) * differ / below + 0.5).cast("bigint"))


def jaccard(a: Column, b: Column) -> Column:
    """Differing bits over bits set in either, times SCALE; 0 between two zero vectors."""
    return _binary(a, b, 1)


def dice(a: Column, b: Column) -> Column:
    return _binary(a, b, 2)


def entropy(bits: Column, shares: Column) -> Column:
    """-sum log2 of the share (out of SCALE) that a class gives to each bit of a vector, times SCALE, halves up.

    Shares are kept LEAST away from 0 and SCALE.
    """
    clipped = lambda s: F.least(F.greatest(s, F.lit(LEAST)), F.lit(SCALE - LEAST)) / F.lit(float(SCALE))
    each = F.zip_with(bits, shares, lambda x, s: -F.log2(F.when(x != 0, clipped(s)).otherwise(F.lit(1.0) - clipped(s))))
    return F.floor(_sum(each, "double") * SCALE + 0.5).cast("bigint")


#: Metrics by name, and the metric of each error function.
METRICS = {"mse": squared, "jaccard": jaccard, "dice": dice, "sc": entropy, "dbi": squared}


def merge_cost(n1: Column, n2: Column, d2: Column) -> Column:
    """Growth of the squared error when two clusters become one, halves up; 0 if either is empty."""
    cost = n1 * n2 * d2.cast("decimal(38,0)") / (n1 + n2)
    return F.when((n1 == 0) | (n2 == 0), F.lit(0).cast("decimal(38,0)")).otherwise(F.floor(cost + F.lit(0.5).cast("decimal(2,1)")).cast("decimal(38,0)"))


def quantise(raw: Column, lo: Column, hi: Column, maxval: int = MAXVAL) -> Column:
    """Each element scaled from [lo, hi] to [0, maxval], halves up; 0 where the range is empty."""
    scale = F.when(hi - lo < 1.1920929e-07, F.lit(0.0)).otherwise(F.lit(float(maxval)) / (hi - lo))
    return F.transform(raw, lambda x: F.floor((x.cast("double") - lo) * scale + 0.5).cast("bigint"))


def dequantise(v: Column, lo: Column, hi: Column, maxval: int = MAXVAL) -> Column:
    return F.transform(v, lambda x: lo + x * (hi - lo) / F.lit(float(maxval)))


def log2_factorial(n: Column) -> Column:
    """log2(n!) by Stirling's series at n + 9, brought down by the product of what lies between."""
    x = n.cast("double") + 9.0
    series = 1.0 / (12 * x) - 1.0 / (360 * F.pow(x, 3)) + 1.0 / (1260 * F.pow(x, 5)) - 1.0 / (1680 * F.pow(x, 7))
    between = sum((F.log(n.cast("double") + k) for k in range(2, 9)), F.log(n.cast("double") + 1.0))
    return ((x - 0.5) * F.log(x) - x + 0.5 * F.log(2 * F.pi()) + series - between) / F.log(F.lit(2.0))


def metric(error: str):
    """The distance of an error function: mse and dbi by squares, sc by entropy, jaccard, dice."""
    if error not in METRICS:
        raise ValueError(f"no error function {error!r}")
    return METRICS[error]


def partial_squared(a: Column, b: Column, limit: Column) -> Column:
    """The squared distance, or null once it is over `limit`: what a search by partial distances may stop at."""
    d2 = squared(a, b)
    return F.when(d2 <= limit, d2)


# vectors of doubles


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def filled(size: int, value: float) -> Column:
    return F.array_repeat(F.lit(float(value)), size)


def length(a: Column) -> Column:
    """Manhattan length."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of vectors of doubles."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def normalised(a: Column) -> Column:
    """The vector over its Manhattan length; a zero vector stays."""
    n = length(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / n))


def ordered(a: Column, descending: bool = False) -> Column:
    return F.sort_array(a, not descending)


def grouped_digits(n: Column) -> Column:
    """An integer with a comma between thousands."""
    return F.format_number(n, 0)


def remainder(a: Column, b: Column) -> Column:
    """a modulo b for doubles, from 0 up to b."""
    return F.pmod(a, b)
