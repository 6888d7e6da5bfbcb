"""Tables that cut lineage, in the shared folder named by spark.checkpoint.dir."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from calibra.session import scratch_path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet under the shared checkpoint folder and read it back.

    Column-pruned re-reads, no recomputation after a lost executor; unlike a local
    checkpoint no executor holds the only copy.  The folder belongs to the caller's
    checkpoint folder and goes with it.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
