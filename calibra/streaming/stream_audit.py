"""Audit of arriving master changes (I6) with Structured Streaming.

`readStream` over a folder of Parquet files -> `foreachBatch`: audit the
micro-batch, re-derive status, write it under `<target>/batch=<id>`.  Writing per
batch id with overwrite makes a replayed batch (after a failure) idempotent; the
checkpoint location records which files were consumed, so a second run over the
same input appends nothing.  Uniqueness sees the micro-batch plus, optionally,
the records already written (`widen_uniqueness=True`, quirk Q-8): each batch leaves the
distinct keys it saw under `<target>_keys/batch=<id>`, and later batches read those
narrow tables, never the target itself.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra.functions.text import norm_key, qcol
from calibra.operators.audit import audit, restate
from calibra.session import scratch_path
from calibra.sources.io import exists


def stream_audit(spark: SparkSession, source_dir: str, schema: T.StructType, target_dir: str,
                 rules, units=(), domain: str = "Maestro de Materiales", user: str | None = None,
                 checkpoint: str | None = None, prepare=None, widen_uniqueness: bool = False,
                 max_files_per_trigger: int | None = None):
    """Run the stream until the available input is consumed; return the query."""
    checkpoint = checkpoint or scratch_path(spark, "stream_audit_checkpoint")
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    changes = reader.parquet(source_dir)
    if prepare is not None:
        changes = prepare(changes)

    keys_dir = f"{target_dir.rstrip('/')}_keys"

    def handle(batch: DataFrame, batch_id: int) -> None:
        reference = None
        if widen_uniqueness and exists(spark, keys_dir):
            # earlier batches only: a replayed batch must not count its own keys twice
            reference = spark.read.parquet(keys_dir).where(F.col("batch") < F.lit(batch_id))
        result = audit(batch, rules, units, domain=domain, user=user, reference=reference, return_plan=True)
        written = os.path.join(target_dir, f"batch={batch_id}")
        restate(result.frame).write.mode("overwrite").parquet(written)
        keys = sorted({k for key_set in result.plan.key_sets for k in key_set})
        if widen_uniqueness and keys:
            seen = spark.read.parquet(written).select(*[norm_key(qcol(k)).alias(k) for k in keys]).distinct()
            seen.write.mode("overwrite").parquet(os.path.join(keys_dir, f"batch={batch_id}"))

    q = (changes.writeStream.foreachBatch(handle)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return q
