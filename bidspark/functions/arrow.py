"""Arrow batches of bounded size for the per-document helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame

BATCH_BYTES = 4 << 20


def bounded(df: DataFrame, size: int = BATCH_BYTES) -> DataFrame:
    """`df`, after lowering the session's Arrow batches to `size` bytes; a smaller bound of the caller's stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(key).rstrip("b")) <= size:
        conf.set(key, str(size))
    return df
