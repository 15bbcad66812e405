"""A file stream of structures: every stage up to features looks at one file at a time, so new files only are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.annotate import annotate
from ..operators.features import extract_features
from ..sources.structures import GLOB, parse_structures, residues

_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(_SCHEMA).option("pathGlobFilter", GLOB).option("maxFilesPerTrigger", files_a_batch).load(path).select("path", "content")


def stream_features(spark: SparkSession, path: str, out: str, checkpoint: str, files_a_batch: int = 1000, available_now: bool = True) -> StreamingQuery:
    """Writes ``out/features`` and ``out/errors`` as files arrive. A batch goes to a folder of its own number, which a retry
    replaces, so every file counts once."""
    def batch(files: DataFrame, number: int) -> None:
        files.persist()
        atoms, errors = parse_structures(files)
        extract_features(annotate(residues(atoms))).write.mode("overwrite").parquet(f"{out}/features/batch={number}")
        errors.write.mode("overwrite").parquet(f"{out}/errors/batch={number}")
        files.unpersist()

    writer = stream_files(spark, path, files_a_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
