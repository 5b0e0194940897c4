"""Features from physicochemical properties of neighbouring dinucleotides: ids 3 to 6.

``props`` maps dinucleotides to equally many numbers.  Dinucleotides that it
lacks are left out before lags are taken.  The arithmetic stays in the row, in
array functions over one array of numbers per property.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import checks
from helixframe.functions.alphabet import DINUCLEOTIDES
from helixframe.functions.sequence import count_word, per_window, windows
from helixframe.operators.composition import cleaned, shaped

Properties = Mapping[str, Iterable[float]]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _with_tracks(seqs: DataFrame, table: Mapping[str, tuple[float, ...]]) -> DataFrame:
    """Columns v0, v1, ...: each property along the sequence; and n, their common length."""
    keys = F.array(*[F.lit(d) for d in table])
    rows = cleaned(seqs).withColumn("steps", F.filter(windows("seq", 2), lambda d: F.array_contains(keys, d)))
    width = len(next(iter(table.values())))
    by = [F.create_map(*[x for d, v in table.items() for x in (F.lit(d), F.lit(v[m]))]) for m in range(width)]
    track = lambda table_column: F.transform("steps", lambda d: F.element_at(table_column, d))
    return rows.withColumns({f"v{m}": track(by[m]) for m in range(width)}).withColumn("n", F.size("steps")).drop("steps")


def _products(x: str, y: str, lag: int) -> Column:
    """Sum of x[i] * y[i + lag]."""
    left, right = F.slice(x, F.lit(1), F.col("n") - lag), F.slice(y, F.lit(lag + 1), F.col("n") - lag)
    return _sum(F.zip_with(left, right, lambda a, b: a * b))


def pse_dnc(seqs: DataFrame, props: Properties, lam: int, w: float = 0.5, return_format: str = "dataframe") -> DataFrame:
    """Id 3: dinucleotide shares and ``lam`` correlations theta, together scaled by 1 + w * sum of theta.

    theta_l is the mean dot product of the property vectors l steps apart.  A
    sequence of fewer than two letters gives zeros; a scale of zero is an error.
    """
    checks.at_least("lam", lam, 1)
    checks.share("w", w)
    table = checks.properties(props)
    width = len(next(iter(table.values())))
    rows = _with_tracks(seqs, table)
    theta = lambda lag: F.when(F.col("n") > lag, sum((_products(f"v{m}", f"v{m}", lag) for m in range(width)), F.lit(0.0)) / (F.col("n") - lag)).otherwise(0.0)
    rows = rows.select("sample_id", "seq", *[theta(lag).alias(f"t{lag}") for lag in range(1, lam + 1)])
    scale = 1 + F.lit(float(w)) * sum((F.col(f"t{lag}") for lag in range(1, lam + 1)), F.lit(0.0))
    rows = rows.withColumn("scale", scale)
    some, total = F.length("seq") >= 2, F.length("seq") - 1
    share = lambda d: per_window(count_word("seq", d), total, True)
    features = [(d, F.when(some, share(d) / F.col("scale")).otherwise(0.0)) for d in DINUCLEOTIDES]
    features += [(f"theta_{lag}", F.when(some, F.lit(float(w)) * F.col(f"t{lag}") / F.col("scale")).otherwise(0.0)) for lag in range(1, lam + 1)]
    return shaped(rows, features, return_format)


def _covariance(x: str, y: str, lag: int, exact_sums: bool) -> Column:
    """Mean over i < n - lag of (x[i] - mean x) * (y[i + lag] - mean y), the means over all n.

    The default subtracts the means first, which keeps precision for properties
    far from zero.  ``exact_sums`` expands the product: with properties that
    are multiples of a power of two every sum is then exact, in any order.
    """
    n, k = F.col("n"), F.col("n") - lag
    mean_x, mean_y = F.col(f"mean_{x}"), F.col(f"mean_{y}")
    left, right = F.slice(x, F.lit(1), k), F.slice(y, F.lit(lag + 1), k)
    if exact_sums:
        total = _products(x, y, lag) - mean_y * _sum(left) - mean_x * _sum(right) + k * mean_x * mean_y
    else:
        total = _sum(F.zip_with(left, right, lambda a, b: (a - mean_x) * (b - mean_y)))
    return F.when(n > lag, total / k).otherwise(0.0)


def _covariances(seqs: DataFrame, props: Properties, L: int, auto: bool, cross: bool, return_format: str, exact_sums: bool) -> DataFrame:
    checks.at_least("L", L, 1)
    table = checks.properties(props)
    width = len(next(iter(table.values())))
    rows = _with_tracks(seqs, table)
    rows = rows.withColumns({f"mean_v{m}": F.when(F.col("n") > 0, _sum(F.col(f"v{m}")) / F.col("n")) for m in range(width)})
    features = []
    if auto:
        features += [(f"AUTO_p{m}_lag{lag}", _covariance(f"v{m}", f"v{m}", lag, exact_sums)) for m in range(width) for lag in range(1, L + 1)]
    if cross:
        pairs = [(a, b) for a in range(width) for b in range(width) if a != b]
        features += [(f"CROSS_p{a}_p{b}_lag{lag}", _covariance(f"v{a}", f"v{b}", lag, exact_sums)) for a, b in pairs for lag in range(1, L + 1)]
    return shaped(rows, features, return_format)


def auto_covariance(seqs: DataFrame, props: Properties, L: int, return_format: str = "dataframe", exact_sums: bool = False) -> DataFrame:
    """Id 4: covariance of each property with itself at lags 1 to ``L``."""
    return _covariances(seqs, props, L, True, False, return_format, exact_sums)


def cross_covariance(seqs: DataFrame, props: Properties, L: int, return_format: str = "dataframe", exact_sums: bool = False) -> DataFrame:
    """Id 5: covariance of each ordered pair of different properties at lags 1 to ``L``."""
    return _covariances(seqs, props, L, False, True, return_format, exact_sums)


def auto_cross_covariance(seqs: DataFrame, props: Properties, L: int, return_format: str = "dataframe", exact_sums: bool = False) -> DataFrame:
    """Id 6: the columns of id 4, then those of id 5."""
    return _covariances(seqs, props, L, True, True, return_format, exact_sums)
