"""Annotation of a growing folder of abstracts with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termweave.functions.encode import Encoder
from termweave.plans.jobs import annotate, build_chunks
from termweave.runtime import cut
from termweave.schemas import ABSTRACTS
from termweave.sources.abstracts import existing


def _earlier(spark: SparkSession, ledger: str, batch_id: int) -> DataFrame | None:
    if not existing(spark, [f"{ledger}/batch=*"]):
        return None
    return spark.read.parquet(ledger).where(F.col("batch") < batch_id).select("doi")


def annotate_batch(
    abstracts: DataFrame,
    batch_id: int,
    tags: DataFrame,
    encoder: Encoder,
    out: str,
    threshold_chunk: float,
    threshold_tag: float,
    **options,
) -> None:
    """Annotate the documents of one micro-batch that no earlier batch has seen.

    Scores and the ledger of seen dois are written to the batch's own partition, so a repeated batch replaces itself.
    No stream state is kept: the ledger is the memory, and only its hits in the batch are joined.
    """
    spark = abstracts.sparkSession
    ledger = f"{out}/ledger"
    batch = abstracts.where(F.col("doi").isNotNull())
    earlier = _earlier(spark, ledger, batch_id)
    if earlier is not None:
        keys = batch.select("doi").distinct()
        seen = earlier.join(keys, "doi", "left_semi").distinct()
        batch = batch.join(seen, "doi", "left_anti")
    chunks = cut(build_chunks(batch, encoder))
    scores = annotate(chunks, tags, threshold_chunk, threshold_tag, **options)
    for rows, path in ((scores, f"{out}/scores"), (chunks.select("doi").distinct(), ledger)):
        rows = rows.withColumn("batch", F.lit(batch_id).cast("long"))
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("batch").parquet(path)


def annotate_stream(
    spark: SparkSession,
    source: str,
    tags: DataFrame,
    encoder: Encoder,
    out: str,
    checkpoint: str,
    threshold_chunk: float = 0.75,
    threshold_tag: float = 0.75,
    max_files: int = 1000,
    **options,
) -> StreamingQuery:
    """Process what is in the folder of JSON-lines abstracts, then stop; run again for what came later."""
    stream = spark.readStream.schema(ABSTRACTS).option("maxFilesPerTrigger", max_files).json(source)

    def handle(batch: DataFrame, batch_id: int) -> None:
        annotate_batch(batch, batch_id, tags, encoder, out, threshold_chunk, threshold_tag, **options)

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
