"""pricelab: cleaning, profiling and forecasting of price time series on Spark.

Every public function takes and returns Spark DataFrames (or fitted Spark ML
models) so it composes with ``df.transform(...)``. Nothing gathers a table on
the driver: whole-table statistics are one-row frames joined back by
broadcast, orderings use range partitioning, and windows over one long series
are split into overlapping blocks.
"""

from pricelab.session import build_session, ensure_checkpoint_dir, scratch_path

__all__ = ["build_session", "ensure_checkpoint_dir", "scratch_path"]
