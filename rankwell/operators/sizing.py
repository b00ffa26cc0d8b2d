"""Size checks made before a side of a join is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def fits_broadcast(df: DataFrame, *texts: str, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``size`` bytes in its ``texts`` columns (one aggregate job)."""
    width = sum((F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) for text in texts), F.lit(0))
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return n <= rows and total <= size
