"""qforge - Spark-native process-sensor quality analytics.

Every operator takes and returns Spark DataFrames. Statistics that
parameterise a later step (means, deviations, quantiles, class quotas)
are "fitted" as one bounded row and applied as literals, so no operator
cross-joins, collects user rows, or funnels a whole table into one task.
"""

from qforge.session import get_session, checkpoint_dir, scratch_path

__all__ = ["get_session", "checkpoint_dir", "scratch_path"]
__version__ = "0.1.0"
