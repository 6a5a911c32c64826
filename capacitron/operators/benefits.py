"""Benefit calculator: every configuration's KPIs against its run's baseline.

Set-based replacement of the reference's per-run / per-config look-up loop
(SURVEY §2.7 win_baseline_pick, §2.4 jn_baseline_self, §2.10 bn_*):

1. ``pick_baselines``  one baseline per run as a *partial* aggregate
   ``min(struct(priority, config_id))`` — map-side combine, so a run holding a third of
   all configurations never lands whole in one task.
2. ``kpi_wide``        long KPI rows -> one row per configuration (conditional
   aggregates; again a partial aggregate, no pivot discovery job).
3. ``benefits``        configs ⋈ baseline (run_id) ⋈ wide KPIs of both sides.
   The joins are equi-joins on keys whose sides grow with the data, so none is
   broadcast (:mod:`.joins`); AQE splits skewed partitions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_baseline_name
from .joins import grown


# ---------------------------------------------------------------------------
# The three benefit definitions of the reference.
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Benefit:
    name: str
    kpis: tuple                       # one KPI = simple benefit, several = composite
    calculation: str = "baseline - battery"
    unit: str = "EUR/year"
    description: str = ""


DEFAULT_BENEFITS = (
    Benefit("peak_shaving_benefit", ("annual_total_grid_fee_cost_ic",),
            description="Grid fees saved per year by cutting load peaks"),
    Benefit("energy_procurement_optimization", ("annual_total_energy_trade_cost_da",),
            description="Purchase costs saved per year on the day-ahead market"),
    Benefit("trading_revenue", ("annual_total_energy_trade_cost_ia",
                                "annual_total_energy_trade_cost_ic"),
            description="Yearly gain of intraday auction and continuous trades"),
)


@dataclass
class BenefitBook:
    """Registry of benefit definitions (bn_custom adds to it)."""
    items: list = field(default_factory=lambda: list(DEFAULT_BENEFITS))

    def add(self, name, baseline_kpi=None, component_kpis=None,
            calculation="baseline - battery", description="", unit="EUR/year"):
        kpis = tuple(component_kpis) if component_kpis else (baseline_kpi,)
        if not kpis or kpis[0] is None:
            raise ValueError("need baseline_kpi or component_kpis")
        if calculation not in ("baseline - battery", "battery - baseline"):
            raise ValueError(f"unknown calculation {calculation!r}")
        self.items = [b for b in self.items if b.name != name]
        self.items.append(Benefit(name, kpis, calculation, unit, description))
        return self

    @property
    def names(self):
        return [b.name for b in self.items]

    @property
    def kpis(self):
        out = []
        for b in self.items:
            out += [k for k in b.kpis if k not in out]
        return out


def baseline_priority(strict_reference_order: bool = False):
    """Priority of a configuration as its run's baseline; NULL = not a candidate.

    0 flagged baseline; then the fallback (D4): capacity 0, capacity NULL, name rule.
    With ``strict_reference_order`` NULL capacity ranks ahead of 0 (NULLS FIRST).
    """
    cap = F.col("battery_capacity_kwh")
    zero, null = (2, 1) if strict_reference_order else (1, 2)
    return (F.when(F.col("is_baseline"), F.lit(0))
            .when(cap == 0, F.lit(zero))
            .when(cap.isNull(), F.lit(null))
            .when(is_baseline_name(F.col("config_name")), F.lit(3)))


def _first_of(prio) -> F.Column:
    """The smallest candidate id of the best priority.

    One long minimum per priority (0..3), so any long is a valid id, negative hash keys
    included, and the whole stays a HashAggregate."""
    return F.coalesce(*[F.min(F.when(prio == p, F.col("config_id"))) for p in range(4)])


def pick_baselines(configs: DataFrame, strict_reference_order: bool = False) -> DataFrame:
    """(run_id, baseline_config_id): one baseline per run, runs without one omitted."""
    cand = (configs.select("run_id", "config_id",
                           baseline_priority(strict_reference_order).alias("prio"))
            .filter(F.col("prio").isNotNull()))
    return cand.groupBy("run_id").agg(_first_of(F.col("prio")).alias("baseline_config_id"))


def kpi_wide(kpis: DataFrame, names) -> DataFrame:
    """(config_id, <kpi>...) — one conditional aggregate per KPI name, last write wins
    is not needed because (config_id, kpi_name) is unique in the store."""
    names = list(names)
    return (kpis.filter(F.col("kpi_name").isin(names))
            .groupBy("config_id")
            .agg(*[F.max(F.when(F.col("kpi_name") == n, F.col("kpi_value"))).alias(n)
                   for n in names]))


def _benefit_expr(b: Benefit) -> F.Column:
    diffs = []
    for k in b.kpis:
        base, bat = F.col(f"base__{k}"), F.col(f"bat__{k}")
        diffs.append(base - bat if b.calculation == "baseline - battery" else bat - base)
    total = diffs[0]
    for d in diffs[1:]:
        total = total + d        # NULL if any component is missing (composite rule)
    return total.alias(b.name)


def benefits(configs: DataFrame, kpis: DataFrame, runs: DataFrame | None = None,
             clients: DataFrame | None = None, book: BenefitBook | None = None,
             include_baseline: bool = False,
             strict_reference_order: bool = False, keep=(), how: str = "inner") -> DataFrame:
    """bn_all: benefits of every configuration of every run that has a baseline.

    Plan: KPI rows -> one wide row per configuration (partial aggregate on config_id), whose
    exchange serves two joins: with the configurations, and with the few ids that are some
    run's baseline (four long minima per run, a HashAggregate with map-side combine).
    Configurations then join their run's baseline row on run_id.  ``keep`` names further columns
    of the configurations to carry along; with ``how="left"`` those of runs without a baseline
    stay, their benefits null.
    """
    book = book or BenefitBook()
    names = book.kpis
    wide = kpi_wide(kpis, names)
    cfgk = grown(configs.select("config_id", "run_id", "config_name", "battery_capacity_kwh",
                                "battery_power_kw", "is_baseline", *keep), wide, "config_id", "left")
    picked = pick_baselines(configs, strict_reference_order).withColumn("config_id", F.col("baseline_config_id"))
    base = grown(picked, wide, "config_id", "left").select("run_id", "baseline_config_id", *[F.col(k).alias(f"base__{k}") for k in names])
    cfg = cfgk if include_baseline else cfgk.filter(~F.col("is_baseline"))
    cfg = cfg.select(*[F.col(c) for c in ("config_id", "run_id", "config_name", "battery_capacity_kwh",
                                          "battery_power_kw", "is_baseline", *keep)],
                     *[F.col(k).alias(f"bat__{k}") for k in names])
    j = grown(cfg, base, "run_id", how)
    zero = F.col("is_baseline") & F.col("baseline_config_id").isNotNull()
    vals = [F.when(zero, F.lit(0.0)).otherwise(_benefit_expr(b)).alias(b.name)
            for b in book.items]
    out = j.select("config_id", "run_id", "config_name", "battery_capacity_kwh",
                   "battery_power_kw", "is_baseline", *keep, "baseline_config_id", *vals)
    if runs is not None:
        r = runs.select("run_id", "run_name", "client_id")
        if clients is not None:                                # as in configs_full
            r = grown(r, clients.select("client_id", "client_name"), "client_id")
        out = grown(out, r, "run_id")
    return out


def benefits_long(ben: DataFrame, names) -> DataFrame:
    """Unpivot benefit columns to (config_id, benefit_name, value), NULL/NaN dropped."""
    names = list(names)
    return (ben.select("config_id", F.inline(F.array(*[
        F.struct(F.lit(n).alias("benefit_name"), F.col(n).alias("value")) for n in names])))
            .filter(F.col("value").isNotNull() & ~F.isnan("value")))


def benefit_summary(ben: DataFrame, book: BenefitBook | None = None) -> DataFrame:
    """agg_benefit_summary: count, mean, std (ddof 1), min, max per benefit."""
    book = book or BenefitBook()
    meta = ben.sparkSession.createDataFrame(
        [(b.name, b.description, b.unit) for b in book.items],
        "benefit_name string, description string, unit string")
    long = benefits_long(ben, book.names)
    agg = long.groupBy("benefit_name").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    # the definitions table is fixed-size (one row per benefit) -> broadcast is bounded
    return F.broadcast(meta).join(agg, "benefit_name", "left").select(
        "benefit_name", "description", "unit",
        F.coalesce("count", F.lit(0)).alias("count"), "mean", "std", "min", "max")


def benefits_as_kpis(ben: DataFrame, book: BenefitBook | None = None) -> DataFrame:
    """bn_save: benefit values as KPI rows (NaN/NULL skipped), ready for the KPI upsert."""
    book = book or BenefitBook()
    units = {b.name: b.unit for b in book.items}
    unit = F.lit(None).cast("string")
    for n, u in units.items():
        unit = F.when(F.col("benefit_name") == n, F.lit(u)).otherwise(unit)
    return benefits_long(ben, book.names).select(
        "config_id", F.col("benefit_name").alias("kpi_name"),
        F.col("value").alias("kpi_value"), unit.alias("kpi_unit"))
