"""Ingest of violation files that keeps the ids it has seen in a state store."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stoopwise.operators.slices import slices
from stoopwise.session import drop_path, dropped, shuffles_go, there, written
from stoopwise.sources.readers import VIOLATION_OPTIONS, VIOLATION_RECORD, typed_violations
from stoopwise.sources.writers import split_dead_letters

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest_unseen(
    spark: SparkSession, source: str, existing: DataFrame, target: str, dead: str, checkpoint: str, max_files: int = 1000
) -> Iterator[StreamingQuery]:
    """Take in all files that landed since the last run; the queries that do so, one after the other.

    The next query begins when the one before it has ended, and is not begun if that failed.

    Ids of ``existing`` (violation_id) are read when the stream first starts and never
    again: from then on the state store knows them, and no batch reads the target. Rows
    with a new id are added to ``target``, an id once; of its rows in one batch the first
    by the texts of all columns, a null being an empty one. Unreadable rows go to ``dead``.
    Both are written so that a batch that runs again adds nothing twice: in a folder of
    their batch. Files are parsed once. The number of shuffle partitions at the first start stays.

    The first query writes the readable rows of a batch, one per id, into a folder of the
    checkpoint. The second passes their ids through the state store and takes the rows of
    the new ones; what it took in is deleted. State is an aggregate per id, which Spark
    adds up in the map tasks, and holds no row: the times of the first and of the last
    batch of the second query that had it, and the first batch of files. An id is new to a
    batch exactly if both times are that of this batch, which a batch that runs again keeps.
    """
    if spark.conf.get(STORE, None) != ROCKS:
        spark.conf.set(STORE, ROCKS)
    raw = spark.readStream.schema(VIOLATION_RECORD).options(**VIOLATION_OPTIONS).option("maxFilesPerTrigger", max_files).csv(source)
    rows = typed_violations(raw, strict=False)
    kinds = rows.drop("error").schema
    landed = f"{checkpoint}/landed"

    def land(batch: DataFrame, batch_id: int) -> None:
        typed = written(batch, "typed-violations", compression="zstd")
        good, bad = split_dead_letters(typed)
        bad.write.mode("overwrite").parquet(f"{dead}/batch={batch_id}")
        order = F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in good.columns]))
        row = F.struct(order.alias("order"), *good.columns)
        for k, part in enumerate(slices(typed, ["violation_id"])):
            first = split_dead_letters(part)[0].groupBy("violation_id").agg(F.min(row).alias("row"))
            with shuffles_go(batch.sparkSession):
                found = first.select("row.*").drop("order").withColumn("landed", F.lit(batch_id).cast("long"))
                found.write.mode("append" if k else "overwrite").parquet(f"{landed}/{batch_id}", compression="zstd")
        dropped(typed)

    with shuffles_go(spark):
        begun = rows.writeStream.foreachBatch(land).option("checkpointLocation", f"{checkpoint}/files")
        begun = begun.trigger(availableNow=True).start()
    yield begun
    begun.awaitTermination()

    # The ids that are there already come as rows of the first batch.
    stored = f"{checkpoint}/known"
    if not there(spark, f"{stored}/_SUCCESS"):
        with shuffles_go(spark):
            existing.select("violation_id").where("violation_id IS NOT NULL").distinct().write.mode("overwrite").parquet(stored)
    known = spark.readStream.schema(existing.select("violation_id").schema).parquet(stored)
    # The folder is there even if no file ever landed.
    spark.createDataFrame([], "violation_id string, landed long").write.mode("ignore").parquet(landed)
    ids = spark.readStream.schema("violation_id string, landed long").option("recursiveFileLookup", "true").parquet(landed)
    both = ids.unionByName(known.withColumn("landed", F.lit(-1).cast("long")))
    seen = both.withColumn("now", F.current_timestamp()).groupBy("violation_id").agg(
        F.min("now").alias("first"), F.max("now").alias("last"), F.min("landed").alias("landed")
    )

    def take_in(batch: DataFrame, batch_id: int) -> None:
        here = batch.sparkSession
        new = written(batch.where("first = last AND landed >= 0").select("violation_id", "landed"), "new-ids")
        here.createDataFrame([], kinds).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        for n in sorted(r["landed"] for r in new.select("landed").distinct().collect()):
            whole = here.read.schema(kinds).parquet(f"{landed}/{n}")
            wanted = new.where(F.col("landed") == n).select("violation_id")
            for part in slices(whole, ["violation_id"]):
                with shuffles_go(here):
                    part.join(wanted, "violation_id", "left_semi").write.mode("append").parquet(f"{target}/batch={batch_id}")
        dropped(new)

    with shuffles_go(spark):
        taken = seen.writeStream.outputMode("update").foreachBatch(take_in).option("checkpointLocation", f"{checkpoint}/ids")
        taken = taken.trigger(availableNow=True).start()
    yield taken
    taken.awaitTermination()
    place = spark._jvm.org.apache.hadoop.fs.Path(landed)
    for found in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place):
        if found.isDirectory():
            drop_path(spark, found.getPath().toString())
