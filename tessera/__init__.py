"""tessera — config-driven tabular analytics, data-quality and classification
operators expressed as Spark DataFrame / Spark ML / Structured Streaming jobs.

Every operator takes column names and thresholds as parameters and works on any
table.  Results that reach the driver are bounded by the number of columns,
bins, groups or rules — never by the number of rows.
"""

from tessera.session import checkpoint_dir, get_session, scratch_path

__all__ = ["get_session", "checkpoint_dir", "scratch_path"]
