"""Scalar column functions: name parsing, coercion, clean-up.

All are built from JVM-side expressions (regexp_extract, try_cast, when, ...), so
they stay inside whole-stage codegen and never leave the executor JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col_

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
# Configuration names that denote the no-battery baseline (exact, lower-cased):
BASELINE_NAMES = ["0kwh", "0_kwh", "no_battery", "0_battery", "baseline", "no battery", "0"]
# File-name prefixes stripped when no timestamp pattern is present, tried in order:
CONFIG_PREFIXES = ["kpi_summary_", "flex_timeseries_outputs_", "flex_timeseries_"]
# Client-folder suffixes removed in order:
CLIENT_SUFFIXES = [" (F)", " (Flex)", " - Batterie"]
# Whole-name KPI renames applied after cleaning:
KPI_RENAMES = {
    "peak_shaving": "peak_shaving_benefit",
    "energy_optimization": "energy_procurement_optimization",
    "trading": "trading_revenue",
}
# Parameter aliases, first present wins:
CAPACITY_ALIASES = ["battery_capacity", "capacity_kwh", "battery_kwh", "capacity"]
POWER_ALIASES = ["battery_power", "power_kw", "battery_kw", "power"]
EFFICIENCY_ALIASES = ["efficiency", "round_trip_efficiency", "rte"]
# Weekday labels for the 672-slot average week (Monday = 0):
DAY_LABELS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
# Direct model inputs read from a submission:
DIRECT_INPUT_NAMES = [
    "list_battery_max_state", "list_battery_usability", "list_battery_usable_max_state",
    "list_battery_efficiency", "list_battery_num_annual_cycles",
    "list_battery_proportion_hourly_max_load", "pv_annual_total", "pv_consumed_percentage",
]
# Folder-name fragments that exclude a client folder from import:
SKIP_PATTERNS = ["00_", "01_Template", "02_Template", "03_", "04_", "05_", "06_", "07_",
                 "Archive", "Cheatsheet", ".zip", ".xlsx", ".gsheet", ".gdoc", ".gslides",
                 ".py", ".txt"]
# Numeric text accepted as a KPI value (N11): optional sign, digits, decimal, exponent,
# and the special words Python's float() accepts.
NUMERIC_RE = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|nan|inf|infinity)\s*$"


def config_name_from_file(fname) -> Column:
    """File name -> configuration name (sc_config_name)."""
    c = col_(fname)
    stem = F.when(c.contains("."), F.substring(c, F.lit(1), F.char_length(c) - F.char_length(F.substring_index(c, ".", -1)) - 1)).otherwise(c)
    stamped = F.regexp_extract(stem, r"_\d{8}_\d{6}_(.+)$", 1)
    out = F.when(stamped != "", stamped)
    for p in CONFIG_PREFIXES:
        out = out.when(stem.startswith(p), F.substring(stem, len(p) + 1, 1 << 30))
    return out.otherwise(stem)


def capacity_kwh(name) -> Column:
    """``(\\d+(?:\\.\\d+)?)\\s*kWh`` case-insensitive -> capacity, NULL if absent."""
    v = F.regexp_extract(col_(name), r"(?i)(\d+(?:\.\d+)?)\s*kWh", 1)
    return F.when(v != "", v.cast("double"))


def power_kw(name) -> Column:
    """``...kW`` not followed by ``h`` -> power, NULL if absent."""
    v = F.regexp_extract(col_(name), r"(?i)(\d+(?:\.\d+)?)\s*kW(?!h)", 1)
    return F.when(v != "", v.cast("double"))


def is_baseline_name(name) -> Column:
    """Exact baseline set or a ``0kwh`` prefix (D3: not a substring test)."""
    n = F.lower(col_(name))
    return n.isin(*BASELINE_NAMES) | n.startswith("0kwh")


def sanitize_name(c) -> Column:
    """``[^\\w\\-]`` -> ``_`` with Unicode word characters (N12)."""
    return F.regexp_replace(col_(c), r"(?U)[^\w\-]", "_")


def clean_client(c) -> Column:
    out = col_(c)
    for s in CLIENT_SUFFIXES:
        out = F.when(out.endswith(s), F.substring(out, F.lit(1), F.char_length(out) - len(s))).otherwise(out)
    return F.trim(out)


def clean_kpi_name(c) -> Column:
    s = F.lower(F.trim(col_(c)))
    s = F.regexp_replace(s, r"\s+", "_")
    s = F.regexp_replace(s, r"(?U)[^\w_]", "")
    out = F.when(F.lit(False), s)
    for k, v in KPI_RENAMES.items():
        out = out.when(s == k, F.lit(v))
    return out.otherwise(s)


def folder_date(c) -> Column:
    """First valid date among D.M.YYYY, YYYY-MM-DD, YYYYMMDD (invalid -> next pattern)."""
    c = col_(c)
    dmy = F.regexp_extract(c, r"(\d{1,2})\.(\d{1,2})\.(\d{4})", 0)
    iso = F.regexp_extract(c, r"(\d{4})-(\d{2})-(\d{2})", 0)
    compact = F.regexp_extract(c, r"(\d{8})", 1)
    return F.coalesce(
        F.when(dmy != "", F.try_to_timestamp(dmy, F.lit("d.M.yyyy"))).cast("date"),
        F.when(iso != "", F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))).cast("date"),
        F.when(compact != "", F.try_to_timestamp(compact, F.lit("yyyyMMdd"))).cast("date"),
    )


def numeric_or_null(c) -> Column:
    """KPI text -> double; empty, booleans, literals and non-numeric text -> NULL (N11)."""
    s = F.lower(F.trim(col_(c).cast("string")))
    ok = s.rlike(NUMERIC_RE)
    v = F.when(ok, (s).try_cast("double"))
    return F.when(~F.isnan(v), v)   # 'nan' parses but is not a KPI value


def nonneg(c) -> Column:
    """``clip(lower=0)`` keeping NULL."""
    c = col_(c)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def output_kind(fname) -> Column:
    """kpi / timeseries / other by name and (case-sensitive) extension; NULL = ignored."""
    n = F.lower(col_(fname))
    ext = F.when(col_(fname).contains("."), F.substring_index(col_(fname), ".", -1))
    sheet = ext.isin("csv", "xlsx", "xls")
    return (F.when(n.contains("kpi") & sheet, F.lit("kpi"))
            .when(n.contains("timeseries") & (ext == "csv"), F.lit("timeseries"))
            .when(sheet, F.lit("other")))


def skipped_folder(name) -> Column:
    """True when a folder name contains a skip pattern or starts with a dot."""
    n = col_(name)
    hit = F.lit(False)
    for p in SKIP_PATTERNS:
        hit = hit | n.contains(p)
    return hit | n.startswith(".")


def json_first(json_col, aliases) -> Column:
    """First present alias in a JSON object, as double (sc_param_alias)."""
    j = col_(json_col)
    return F.coalesce(*[F.get_json_object(j, f"$.{a}").try_cast("double") for a in aliases])


def slot_of(ts) -> Column:
    """Quarter-hour slot in the week: weekday*96 + hour*4 + minute//15 (Mon = 0)."""
    t = col_(ts)
    return F.weekday(t) * 96 + F.hour(t) * 4 + F.floor(F.minute(t) / 15).cast("int")


def slot_label(slot) -> Column:
    s = col_(slot)
    day = F.element_at(F.array(*[F.lit(d) for d in DAY_LABELS]), (F.floor(s / 96) + 1).cast("int"))
    within = s % 96
    return F.concat_ws(" ", day, F.format_string("%02d:%02d", F.floor(within / 4).cast("int"),
                                                   ((within % 4) * 15).cast("int")))
