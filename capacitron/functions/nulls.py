"""NULL / NaN / ANSI guards shared by every operator.

Spark 4 runs with ANSI mode on: a division by zero raises and ``corr`` on a
constant column raises.  pandas (the reference's arithmetic) yields NaN or a
guarded 0 instead.  The helpers below keep all of that inside JVM-side
expressions so whole-stage codegen is preserved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """N1: fold NaN to NULL so Spark aggregates skip it like pandas does."""
    c = col_(c)
    return F.when(~F.isnan(c), c)


def fold_nan(df, columns):
    """N1 for whole columns: NaN becomes NULL in every floating column named."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: nan_to_null(c) for c in columns if kinds.get(c) in ("double", "float")})


def safe_div(num, den) -> Column:
    """N6: NULL instead of a DIVIDE_BY_ZERO error."""
    return F.try_divide(col_(num), col_(den))


def ratio_if_positive(num, den, otherwise=0.0) -> Column:
    """``num/den if den > 0 else otherwise`` — the reference's guarded ratios."""
    den = col_(den)
    return F.when(den > 0, F.try_divide(col_(num), den)).otherwise(F.lit(otherwise))


def share(pred: Column) -> Column:
    """Fraction of non-NULL rows where ``pred`` holds (``(s < 20).mean()``)."""
    return F.avg(pred.cast("double"))


def skew_unbiased(c) -> Column:
    """N3/N4: bias-corrected sample skewness (pandas ``Series.skew``).

    G1 = sqrt(n(n-1))/(n-2) * g1, with Spark's population skewness g1.
    n < 3 -> NULL; a constant series -> 0 (pandas) where Spark yields NULL.
    """
    c = col_(c)
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    corrected = F.sqrt(n * (n - 1)) / (n - 2) * g1
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(F.var_pop(c) == 0, F.lit(0.0))
            .otherwise(corrected))


def kurt_unbiased(c) -> Column:
    """N3/N4: bias-corrected excess kurtosis (pandas ``Series.kurtosis``).

    G2 = (n-1)/((n-2)(n-3)) * ((n+1) g2 + 6); n < 4 -> NULL; constant -> 0.
    """
    c = col_(c)
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return (F.when(n < 4, F.lit(None).cast("double"))
            .when(F.var_pop(c) == 0, F.lit(0.0))
            .otherwise(corrected))


def guarded_corr(x, y) -> Column:
    """N7: Pearson correlation on pair-complete rows, NULL when undefined.

    ``F.corr`` raises DIVIDE_BY_ZERO under ANSI for a constant input, so the
    correlation is rebuilt from covariance and standard deviations with try_divide.
    """
    x, y = col_(x), col_(y)
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))


def finite_or_zero(c) -> Column:
    """NULL, NaN and +/-inf become 0 (scoring-path imputation in the reference)."""
    c = col_(c)
    bad = c.isNull() | F.isnan(c) | (c == float("inf")) | (c == float("-inf"))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def r4(c, digits: int = 4) -> Column:
    """Round for order-insensitive comparison with the SQL oracle."""
    return F.round(col_(c), digits)
