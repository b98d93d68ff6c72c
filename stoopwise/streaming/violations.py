"""Tolerant, incremental ingest of violation files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stoopwise.operators.merge import insert_ignore, insert_new
from stoopwise.operators.slices import slices
from stoopwise.session import dropped, shuffles_go, written
from stoopwise.sources.readers import VIOLATION_OPTIONS, VIOLATION_RECORD, typed_violations
from stoopwise.sources.writers import split_dead_letters


def ingest_violations(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Batch ingest: rows with new ids are added, an id that is there already wins."""
    return insert_new(rows, existing, ["violation_id"])


def ingest_violations_stream(
    spark: SparkSession, source: str, target: str, dead: str, checkpoint: str,
    max_files: int = 1000, divisions: int = 1024,
) -> StreamingQuery:
    """Take in all files that landed since the last run, then stop.

    Unreadable rows go to ``dead`` and the rest carries on. A new id enters the target
    once. Each micro-batch writes its own folder, so a batch that runs again after a
    failure overwrites itself instead of adding its rows twice. The target is divided by
    a hash of the id, and a batch looks for its ids in the divisions it touches. A large
    batch is taken in by slices of divisions, so that the shuffle files of one lie there.
    """
    raw = (
        spark.readStream.schema(VIOLATION_RECORD)
        .options(**VIOLATION_OPTIONS)
        .option("maxFilesPerTrigger", max_files)
        .csv(source)
    )

    division = F.pmod(F.xxhash64("violation_id"), F.lit(divisions)).cast("int")

    def take_in(batch: DataFrame, batch_id: int) -> None:
        # The landed files are parsed once.
        parsed = typed_violations(batch, strict=False).withColumn("division", division)
        typed = written(parsed, "typed-violations", compression="zstd")
        split_dead_letters(typed)[1].drop("division").write.mode("overwrite").parquet(f"{dead}/batch={batch_id}")
        stored = read_if_there(spark, target)
        for k, part in enumerate(slices(typed, ["division"])):
            fresh = insert_ignore(split_dead_letters(part)[0], ["violation_id"])
            if stored is not None:
                # At most ``divisions`` numbers, so that the scan skips all other folders.
                touched = [row["division"] for row in part.select("division").distinct().collect()]
                known = stored.where((F.col("batch") != batch_id) & F.col("division").isin(touched))
                fresh = fresh.join(known.select("violation_id"), "violation_id", "left_anti")
            # One file per division.
            fresh = fresh.repartition("division").write.mode("append" if k else "overwrite").partitionBy("division")
            with shuffles_go(batch.sparkSession):
                fresh.parquet(f"{target}/batch={batch_id}")
        dropped(typed)

    with shuffles_go(spark):
        return (
            raw.writeStream.foreachBatch(take_in)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at the path, or None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
