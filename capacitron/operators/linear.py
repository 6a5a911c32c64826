"""Ridge models from moments: one aggregate of the data gives fits, scores and attributions.

For every target, split side and fold the sums of all products of (1, features, label) are
aggregated (120 sums for 13 features).  They are all a linear model needs: the fit of any union
of folds is solved from added sums, so grouped cross-validation costs no further pass, and the
moments are bounded by the number of features, targets and folds, whatever the rows.

The model is the reference's: nulls become the feature's median, features are scaled by mean and
standard deviation of the training clients, ridge with ``ALPHA`` and an intercept.  Coefficients
are published with 8 significant digits (means with 10), so that every consumer computes the
same numbers from them.

Attribution is additive: ``base`` is the prediction at the training mean, the contribution of a
feature is coefficient times its distance from that mean, and base and contributions add up to
the prediction.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ml as ML
from . import series as S
from .joins import grown
from .ranking import ranked

ALPHA = 1.0
#: Sums are taken in so many buckets of rows and added exactly, which keeps rounding small.
BUCKETS = 64


@dataclass
class Fit:
    """A fitted target in the units of the features."""

    target: str
    n: int
    base: float                      # prediction at the training mean
    mean: list[float]
    coef: list[float]


def medians(df: DataFrame, features) -> list[float]:
    """Exact median of every feature (0 where it has no value): a row per feature."""
    # the features have different types; one long column takes them as doubles
    long = ML.unpivot(df, [], features)
    got = dict(S.exact_percentiles(long, {"x": [50]}, key="feature").select("feature", "__q_x_p50").collect())
    return [float(got.get(f) or 0.0) for f in features]


def sides(df: DataFrame, targets, group: str = "client_name", cv_folds: int = 5, test_size: float = 0.2) -> DataFrame:
    """``target, <group>, is_test, fold`` of the groups with a label, for every target."""
    long = ML.unpivot(df, [group], targets, "target", "y").where("y IS NOT NULL").select("target", group)
    both = ML.group_split(long.distinct(), group, test_size, by="target")
    return grown(both, ML.group_folds(long, group, cv_folds, by="target", rows=False), ["target", group])


def by_client(sides_: DataFrame, group: str = "client_name") -> DataFrame:
    """:func:`sides` as a row per group: ``_sides``, a map from target to ``(is_test, fold)``."""
    return sides_.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("target", F.struct("is_test", "fold")))).alias("_sides"))


def labelled(df: DataFrame, features, targets, middle, row="config_id", group="client_name", keep=()) -> DataFrame:
    """A row per configuration and target: label, and features as distances from their medians."""
    shifted = df.select(row, group, *keep, *targets, *[
        (F.coalesce(F.col(f).cast("double"), F.lit(m)) - F.lit(m)).alias(f"_u{i}") for i, (f, m) in enumerate(zip(features, middle))])
    return ML.unpivot(shifted, [row, group, *keep, *[f"_u{i}" for i in range(len(features))]], targets, "target", "y")


def moments(rows: DataFrame, n_features: int, row="config_id") -> dict:
    """``{(target, is_test, fold): matrix}``: sums of products of (1, features, label)."""
    z = [F.lit(1.0), *[F.col(f"_u{i}") for i in range(n_features)], F.col("y")]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    sums = rows.where("y IS NOT NULL").withColumn("_b", F.pmod(F.xxhash64(row), F.lit(BUCKETS))).groupBy(
        "target", "is_test", "fold", "_b").agg(F.array(*[F.sum(z[i] * z[j]) for i, j in pairs]).alias("m"))
    parts = defaultdict(list)
    for r in sums.collect():                                   # targets x 2 x folds x BUCKETS rows
        parts[r["target"], r["is_test"], r["fold"]].append(r["m"])
    out = {}
    for key, rows_ in parts.items():
        m = np.zeros((len(z), len(z)))
        for (i, j), values in zip(pairs, zip(*rows_)):
            m[i, j] = m[j, i] = math.fsum(values)
        out[key] = m
    return out


def spread(m: np.ndarray) -> np.ndarray:
    """Standard deviations (ddof 0) of the features; 1 for constant ones."""
    n = m[0, 0]
    var = np.diag(m)[1:-1] / n - (m[0, 1:-1] / n) ** 2
    return np.where(var > 1e-12 * np.diag(m)[1:-1] / n, np.sqrt(np.maximum(var, 0)), 1.0)


def solve(m: np.ndarray, scale: np.ndarray, alpha: float = ALPHA) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean label, mean features and coefficients (in feature units) of a ridge fit."""
    n, sx, sy = m[0, 0], m[0, 1:-1], m[0, -1]
    cov = (m[1:-1, 1:-1] - np.outer(sx, sx) / n) / np.outer(scale, scale)
    beta = np.linalg.solve(cov + alpha * np.eye(len(sx)), (m[1:-1, -1] - sx * sy / n) / scale)
    return sy / n, sx / n, beta / scale


def digits(x: float, n: int) -> float:
    """A number with n significant digits."""
    return float(f"{x:.{n - 1}e}")


def fit(parts: dict, targets, alpha: float = ALPHA) -> tuple[list[Fit], dict[str, np.ndarray]]:
    """The fit of every target on its training side, and the scales of its features."""
    fits, scales = [], {}
    for t in targets:
        train = [m for (target, test, _), m in parts.items() if target == t and not test]
        if not train or sum(m[0, 0] for m in train) < 10:
            raise ValueError(f"Not enough samples for {t}: {int(sum(m[0, 0] for m in train)) if train else 0}")
        m = sum(train)
        scales[t] = spread(m)
        base, mean, coef = solve(m, scales[t], alpha)
        fits.append(Fit(t, int(m[0, 0]), digits(base, 10), [digits(x, 10) for x in mean], [digits(x, 8) for x in coef]))
    return fits, scales


def cross_validated(parts: dict, scales: dict, alpha: float = ALPHA) -> list[tuple]:
    """``(target, fold, n, r2)`` of every fold, fitted on the others: total minus fold."""
    out = []
    for t, scale in scales.items():
        folds = defaultdict(lambda: 0)
        for (target, _, f), m in parts.items():
            if target == t:
                folds[f] = folds[f] + m
        total = sum(folds.values())
        for f, m in sorted(folds.items()):
            n, sx, sy = m[0, 0], m[0, 1:-1], m[0, -1]
            base, mean, coef = solve(total - m, scale, alpha)
            a = base - coef @ mean
            left = m[-1, -1] - 2 * a * sy - 2 * coef @ m[1:-1, -1] + n * a * a + 2 * a * (coef @ sx) + coef @ m[1:-1, 1:-1] @ coef
            whole = m[-1, -1] - sy * sy / n
            out.append((t, f, int(n), float(1 - left / whole) if whole > 0 else None))
    return out


def predictions(rows: DataFrame, fits: list[Fit], name: str = "prediction") -> DataFrame:
    """``rows`` of :func:`labelled` with the prediction of their target."""
    value = F.lit(None).cast("double")
    for f in fits:
        terms = [F.lit(c) * (F.col(f"_u{i}") - F.lit(m)) for i, (c, m) in enumerate(zip(f.coef, f.mean))]
        value = F.when(F.col("target") == f.target, F.lit(f.base) + reduce(lambda a, b: a + b, terms)).otherwise(value)
    return rows.withColumn(name, value)


def contributions(rows: DataFrame, fits: list[Fit], features, middle, wide: bool = False, only=None) -> DataFrame:
    """A row per configuration, target and feature: ``x`` (median where null), ``contribution``,
    and the ``base_value`` they are added to.  With ``wide`` a row per configuration and target,
    its features (those in ``only``, if given) as an array of ``(feature, x, contribution)``."""
    if wide:
        value = F.lit(None).cast("array<struct<feature:string,x:double,contribution:double>>")
        base = F.lit(None).cast("double")
        for fit_ in fits:
            own = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f"_u{i}") + F.lit(m)).alias("x"),
                                     (F.lit(c) * (F.col(f"_u{i}") - F.lit(mean))).alias("contribution"))
                            for i, (f, m, c, mean) in enumerate(zip(features, middle, fit_.coef, fit_.mean)) if only is None or f in only])
            value = F.when(F.col("target") == fit_.target, own).otherwise(value)
            base = F.when(F.col("target") == fit_.target, F.lit(fit_.base)).otherwise(base)
        return rows.select("config_id", "client_name", "target", "y", base.alias("base_value"), value.alias("contribs"))
    each = [F.struct(F.lit(f).alias("feature"), (F.col(f"_u{i}") + F.lit(m)).alias("x"), F.lit(i).alias("i"))
            for i, (f, m) in enumerate(zip(features, middle))]
    models = {f.target: f for f in fits}

    def of(pick):
        return F.create_map(*[x for t, f in models.items() for x in (F.lit(t), pick(f))])
    table = F.get(of(lambda f: F.array(*map(F.lit, f.coef)))[F.col("target")], F.col("s.i"))
    mean = F.get(of(lambda f: F.array(*map(F.lit, f.mean)))[F.col("target")], F.col("s.i"))
    u = F.get(F.array(*[F.col(f"_u{i}") for i in range(len(features))]), F.col("s.i"))
    return rows.select("*", F.explode(F.array(*each)).alias("s")).select(
        "config_id", "client_name", "target", "y", F.col("s.feature").alias("feature"), F.col("s.x").alias("x"),
        (table * (u - mean)).alias("contribution"), of(lambda f: F.lit(f.base))[F.col("target")].alias("base_value"))


def permutation_importance(rows: DataFrame, fits: list[Fit], features, row="config_id") -> DataFrame:
    """ml_permutation: ``target, feature, base_rmse, permuted_rmse, delta_rmse``.

    Rows are numbered by id and by a hash of the id; the row with a number in the one order takes
    its donor from the other, all features in one equi-join.  Every row is scored with each
    feature exchanged in turn, in one pass."""
    n = len(features)
    known = predictions(rows.where("y IS NOT NULL"), fits).select(row, "target", "y", "prediction", F.array(*[F.col(f"_u{i}") for i in range(n)]).alias("u"))
    numbered = ranked(ranked(known, [row], "_r", ["target"]), [F.md5(F.col(row).cast("string")), row], "_q", ["target"])
    donors = numbered.select("target", F.col("_q").alias("_r"), F.col("u").alias("_other"))
    coef = F.create_map(*[x for f in fits for x in (F.lit(f.target), F.array(*map(F.lit, f.coef)))])[F.col("target")]
    each = grown(numbered, donors, ["target", "_r"]).withColumn("_c", coef).select(
        "target", "y", "prediction", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(
            F.get(F.array(*map(F.lit, features)), k).alias("feature"),
            (F.get("_c", k) * (F.get("_other", k) - F.get("u", k))).alias("shift")))).alias("v"))
    miss, moved = F.col("y") - F.col("prediction"), F.col("y") - F.col("prediction") - F.col("v.shift")
    return each.groupBy("target", F.col("v.feature").alias("feature")).agg(
        F.sqrt(F.avg(miss * miss)).alias("base_rmse"), F.sqrt(F.avg(moved * moved)).alias("permuted_rmse")) \
        .withColumn("delta_rmse", F.col("permuted_rmse") - F.col("base_rmse"))


# --- models as they are stored and used -------------------------------------------------------

def as_dict(fit: Fit, features, middle) -> dict:
    """A fit as the registry stores it: everything that scoring needs."""
    return {"target": fit.target, "n": fit.n, "base": fit.base, "mean": fit.mean, "coef": fit.coef,
            "features": list(features), "median": list(middle)}


def scored(model: dict, columns) -> F.Column:
    """Prediction of a stored fit from feature columns by name; a missing or null feature takes the
    stored median."""
    have = set(columns)
    value = F.lit(model["base"])
    for f, c, mean, mid in zip(model["features"], model["coef"], model["mean"], model["median"]):
        x = F.col(f).cast("double") if f in have else F.lit(None).cast("double")
        value = value + F.lit(c) * (F.coalesce(F.when(~F.isnan(x), x), F.lit(mid)) - F.lit(mid) - F.lit(mean))
    return value
