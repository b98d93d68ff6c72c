"""A keyed table in buckets, of which a synchronisation reads and writes only those that change."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stoopwise.operators import merge
from stoopwise.session import dropped, written
from stoopwise.sources.versions import Versions

BUCKETS = 1024
MANIFEST = "bucket int, path string, rows bigint, first decimal(38,0), second decimal(38,0)"


class BucketedTable:
    """Rows by a hash of their key, with the digest of every bucket in a manifest.

    A bucket is a folder that is never changed. A synchronisation takes the digests of
    the new state per bucket, reads the buckets whose digest differs, writes them to new
    folders and publishes a manifest that names new folders and old ones; so what it
    reads and writes of the table follows the change, also where rows are gone. The
    manifest has a row per bucket. ``scope`` says which rows a synchronisation is about;
    others are carried along. Rows whose key has a null are never compared and stay.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        keys: Sequence[str],
        values: Sequence[str],
        scope: Column | None = None,
        buckets: int = BUCKETS,
    ):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.keys, self.values = list(keys), list(values)
        self.scope = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
        self.versions = Versions(spark, f"{self.root}/manifests")

    @property
    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    @property
    def _whole(self) -> Column:
        whole = F.lit(True)
        for key in self.keys:
            whole &= F.col(key).isNotNull()
        return whole

    def _digests(self, rows: DataFrame) -> DataFrame:
        """Number of rows and two sums of hashes per bucket; sums do not depend on the order."""
        columns = [*self.keys, *self.values]
        # A hash passes nulls over, so they are said.
        said = [F.col(c) for c in columns] + [F.col(c).isNull() for c in columns]
        sums = [F.sum(F.xxhash64(F.lit(n), *said).cast("decimal(38,0)")) for n in (1, 2)]
        inside = rows.where(self.scope & self._whole)
        return inside.groupBy(self._bucket.alias("bucket")).agg(
            F.count("*").alias("rows"), sums[0].cast("decimal(38,0)").alias("first"), sums[1].cast("decimal(38,0)").alias("second")
        )

    def _write(self, rows: DataFrame) -> DataFrame:
        """Write rows to folders of their buckets; their part of the manifest."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        dealt = rows.select(*self.keys, *self.values).withColumn("bucket", self._bucket)
        dealt.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        there = self.spark.read.schema(dealt.schema).parquet(folder)
        counts = there.select("bucket").distinct()
        digests = self._digests(there.drop("bucket"))
        path = F.concat(F.lit(f"{folder}/bucket="), F.col("bucket").cast("string"))
        return counts.join(digests, "bucket", "left").select("bucket", path.alias("path"), "rows", "first", "second")

    def create(self, rows: DataFrame) -> None:
        """The table's first state."""
        self.versions.publish({"manifest": self._write(rows)})
        self._schema(rows)

    def _schema(self, rows: DataFrame) -> None:
        rows.select(*self.keys, *self.values).limit(0).write.mode("overwrite").parquet(f"{self.root}/shape")

    def _manifest(self, number: int | None = None) -> DataFrame:
        return self.versions.read("manifest", number=number)["manifest"]

    def _rows(self, manifest: DataFrame) -> DataFrame:
        # A path per bucket at most.
        paths = [r["path"] for r in manifest.select("path").collect()]
        shape = self.spark.read.parquet(f"{self.root}/shape")
        return self.spark.read.schema(shape.schema).parquet(*paths) if paths else shape

    def read(self, number: int | None = None) -> DataFrame:
        return self._rows(self._manifest(number))

    def sync(self, staging: DataFrame, delete: bool = True) -> DataFrame:
        """Bring the rows in scope to the state of ``staging``, unique by key; the change log.

        The log has keys, values and action of every row of the buckets that differ, but
        for those that did not change.
        """
        last = self.versions.latest()
        manifest = self._manifest(last)
        new = written(staging.select(*self.keys, *self.values), "sync-staging")
        old_marks = manifest.select("bucket", F.struct("rows", "first", "second").alias("old"))
        new_marks = self._digests(new).select("bucket", F.struct("rows", "first", "second").alias("new"))
        nothing = F.coalesce(F.col("old.rows"), F.lit(0)) + F.coalesce(F.col("new.rows"), F.lit(0)) == 0
        differ = old_marks.join(new_marks, "bucket", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")) & ~nothing)
        # At most ``buckets`` numbers.
        touched = [r["bucket"] for r in differ.select("bucket").collect()]
        before = self._rows(manifest.where(F.col("bucket").isin(touched)))
        merged = merge.sync(
            before.where(self.scope), new.where(self._bucket.isin(touched)), self.keys, self.values, delete
        )
        others = before.where(~self.scope).withColumn("action", F.lit("unchanged"))
        log = written(merged.unionByName(others), "sync-merged")
        part = self._write(merge.snapshot(log))
        kept = manifest.where(~F.col("bucket").isin(touched))
        self.versions.publish({"manifest": kept.unionByName(part)}, after=last)
        dropped(new)
        return merge.changes(log)
