"""Column helpers and distributed statistics shared by the operators."""

from qforge.functions.columns import as_double, is_missing, ratio, pct, round_to
from qforge.functions.names import normalize_name, normalize_names, CANONICAL_SENSOR_NAMES
from qforge.functions.order_stats import order_statistics, exact_quantiles, column_profile
from qforge.functions.running import running_totals
from qforge.functions.stats import ColumnStats, column_stats

__all__ = [
    "as_double", "is_missing", "ratio", "pct", "round_to",
    "normalize_name", "normalize_names", "CANONICAL_SENSOR_NAMES",
    "order_statistics", "exact_quantiles", "column_profile", "running_totals",
    "ColumnStats", "column_stats",
]
