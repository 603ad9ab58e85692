"""Incremental sessions: documents that arrive in a stream extend their sessions' pools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veilspark.operators import pool as pools
from veilspark.operators.redact import anonymize


def extend_sessions(stream: DataFrame, pool_path: str, out_path: str, checkpoint: str, prefix: str = "", available_now: bool = True, **options) -> StreamingQuery:
    """Rewrites a stream of docs(session_id, doc_id, ord, text) batch by batch.

    Each batch reads the last pool, numbers its documents in order of ord and writes the new pool and
    the rewritten documents under its own batch number; a batch that is run again writes the same
    folders, so both are exact after a restart. Across batches, entities are numbered in order of arrival."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        previous = spark.read.schema(pools.POOL).parquet(f"{pool_path}/{number - 1}") if number else None
        docs = batch.persist()
        rewritten, _, new = anonymize(docs, previous, prefix, **options)
        new.write.mode("overwrite").parquet(f"{pool_path}/{number}")
        stored = spark.read.schema(pools.POOL).parquet(f"{pool_path}/{number}")
        anonymize(docs, stored, prefix, **options)[0].write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        docs.unpersist()

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query).start()
