"""Submission input derivations (SURVEY §2.2 sc_input_normalise, sc_battery_params,
sc_c_rate, sc_tariff_json) as column expressions over a submissions DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values used by the reference's input handling.
# ---------------------------------------------------------------------------
USABLE_SHARE = 0.92            # usable / gross capacity, also the battery efficiency
DEFAULT_PV_ANNUAL_TOTAL = 50   # used when neither PV figure is given
KWH_THRESHOLD = 10             # pv_annual_total <= 10 is read as kWh and divided by 1000
WORK_PRICE_SURCHARGE = 0.03547 # EUR/kWh added to the converted work price
DEFAULT_WORK_PRICE = 0.041     # EUR/kWh when no work price is known
DEFAULT_POWER_PRICE = 138.71   # EUR/kW when no power price is known
WORK_PRICE_TYPE = "ARBEITSPREIS_WIRKARBEIT"
POWER_PRICE_TYPE = "LEISTUNGSPREIS_WIRKLEISTUNG"


def normalise_pv(df: DataFrame) -> DataFrame:
    """PV target (MWh) and consumed share clamped to 0..1."""
    annual = F.coalesce(F.col("pv_annual_total"), F.lit(float(DEFAULT_PV_ANNUAL_TOTAL)))
    target = F.coalesce(F.col("pv_peak_power"),
                        F.when(annual > KWH_THRESHOLD, annual).otherwise(annual / 1000.0))
    c = F.coalesce(F.col("pv_consumed_percentage"), F.lit(1.0))
    c = F.when(c > 1.0, c / 100.0).otherwise(c)
    return df.withColumns({"pv_target_mwh": target,
                           "pv_consumed_share": F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))})


def ui_payload(df: DataFrame) -> DataFrame:
    """The form's derived values: C-rate, share, work/power price (0 counts as absent)."""
    cap = F.coalesce(F.col("battery_capacity"), F.lit(0.0))
    pw = F.coalesce(F.col("battery_power"), F.lit(0.0))
    ap, lp = F.col("arbeitspreis"), F.col("leistungspreis")
    return df.withColumns({
        "list_battery_usable_max_state": cap,
        "list_battery_proportion_hourly_max_load":
            F.when(cap > 0, F.round(F.try_divide(pw, cap), 3)).otherwise(F.lit(0.0)),
        "pv_consumed_decimal": F.col("pv_consumed_percentage") / 100,
        "static_grid_fees": F.when(ap.isNotNull() & (ap != 0), ap / 100 + WORK_PRICE_SURCHARGE)
                             .otherwise(F.lit(DEFAULT_WORK_PRICE)),
        "grid_fee_max_load_peak": F.when(lp.isNotNull() & (lp != 0), lp)
                                   .otherwise(F.lit(DEFAULT_POWER_PRICE)),
    })


def battery_params(df: DataFrame) -> DataFrame:
    """Server-side parameters stored with a submission."""
    u = F.col("list_battery_usable_max_state")
    return df.withColumns({
        "list_battery_max_state": u / USABLE_SHARE,
        "list_battery_efficiency": F.lit(USABLE_SHARE),
        "list_battery_usability": F.lit(USABLE_SHARE),
        "pv_annual_total_kwh": F.col("pv_peak_power") * 1000,
        "working_price_eur_per_kwh": F.col("static_grid_fees"),
        "power_price_eur_per_kw": F.col("grid_fee_max_load_peak"),
        "battery_power_kw": u * F.col("list_battery_proportion_hourly_max_load"),
        "config_name": F.concat(F.floor(u).cast("string"), F.lit("kWh")),
    })


TARIFF_SCHEMA = "struct<spezifischePreise: array<struct<typ: string, wert: string>>>"


def tariff_prices(json_col: str) -> list:
    """Work and power price from a tariff JSON document; absent entries give 0."""
    arr = F.from_json(F.col(json_col), TARIFF_SCHEMA).getField("spezifischePreise")

    def pick(t):
        hit = F.get(F.filter(arr, lambda p: p["typ"] == t), 0)
        return F.coalesce((hit["wert"]).try_cast("double"), F.lit(0.0))
    return [pick(WORK_PRICE_TYPE).alias("arbeitspreis"), pick(POWER_PRICE_TYPE).alias("leistungspreis")]
