"""New pages as a stream of files: each batch is deduplicated by content and appended with its postings.

A batch writes to folders named by its number and replaces what an earlier attempt left there, so a batch that is run
again after a failure changes nothing twice. Pages of known content are left out by an anti-join with the checksums that
earlier batches wrote. There is no streaming state, but each batch reads that one column of all stored pages: it is meant
for few large batches (``files_per_batch``), not for a trickle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.functions.keys import md5_key
from folioscan.functions.text import postings
from folioscan.operators.index import first_of


def ingest(spark: SparkSession, incoming: str, schema: T.StructType, out: str, checkpoint: str, files_per_batch: int = 1000):
    """Take all files that have arrived in ``incoming`` since the last call; returns when they are done."""
    root = out.rstrip("/")

    def append(batch: DataFrame, number: int) -> None:
        seen = _earlier(spark, root, number)
        keyed = batch.withColumn("md5_hash", md5_key(F.col("md5_hash"))).filter(F.col("md5_hash").isNotNull() & F.col("doc_id").isNotNull())
        fresh = first_of(keyed, ["md5_hash"], F.col("doc_id"))
        if seen is not None:
            fresh = fresh.join(seen, "md5_hash", "left_anti").select(*keyed.columns)
        fresh.write.mode("overwrite").parquet(f"{root}/pages/batch={number}")
        stored = spark.read.schema(fresh.schema).parquet(f"{root}/pages/batch={number}")
        postings(stored).write.mode("overwrite").parquet(f"{root}/postings/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(incoming)
    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _earlier(spark: SparkSession, root: str, number: int) -> DataFrame | None:
    """Checksums that batches before this one stored; the batch column prunes the folders that are read."""
    if number == 0:
        return None
    return spark.read.schema("md5_hash string, batch bigint").parquet(f"{root}/pages").filter(F.col("batch") < number).select("md5_hash")
