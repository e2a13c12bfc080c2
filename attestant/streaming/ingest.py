"""Transcripts as they arrive: a file stream, each batch parsed and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestant.plans.positioned import pages_of_fragments
from attestant.plans.transcript import Transcripts
from attestant.sources.pdf import fragments_of
from attestant.sources.tables import cut_lineage
from attestant.sources.text import decoded, pages_of

RELATIONS = ("lines", "blocks", "exchanges", "participants", "gate")


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Files of a folder as they come: doc_id (path), filename, content, source_sha256."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content", F.sha2("content", 256).alias("source_sha256"))


def write_batch(files: DataFrame, out: str, batch: int) -> None:
    """Parses the documents of a batch and writes each relation under its batch number; writing a batch again replaces it.

    Documents don't depend on each other, so no state goes from batch to batch. Files that can't be decoded go to ``errors``, and
    PDF files of which a page, or all, can't be read.
    """
    told = decoded(files)
    target = lambda name: f"{out}/{name}/batch={batch}"
    pieces = cut_lineage(fragments_of(told.filter("kind = 'pdf' and error is null")))
    unread = pieces.filter("error is not null").select("doc_id", "error").distinct().join(told.select("doc_id", "filename", "source_sha256"), "doc_id")
    columns = ("doc_id", "filename", "error", "source_sha256")
    told.filter("error is not null").select(*columns).unionByName(unread.select(*columns)).write.mode("overwrite").parquet(target("errors"))
    pages = pages_of(told.filter("text is not null")).join(told.select("doc_id", "kind"), "doc_id")
    shown = pieces.filter("error is null")
    if not shown.isEmpty():
        pages = pages.unionByName(pages_of_fragments(shown).select(*pages.columns))
    parsed = Transcripts(pages)
    for name in RELATIONS:
        getattr(parsed, name).write.mode("overwrite").parquet(target(name))


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Starts the stream; it ends when all files that are there have been read (availableNow)."""
    return file_stream(spark, folder, **options).writeStream.foreachBatch(lambda df, n: write_batch(df, out, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
