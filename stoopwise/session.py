"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_MADE: list[str] = []


def local_session(app: str = "stoopwise", cpus: int = 8, partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.extraJavaOptions", "-XX:+UseParallelGC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a session inside one process may fall back to a temporary folder, and only
    there may the folder be a local one that no one named: on a cluster a machine-local
    path is lost with its machine.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
    made = tempfile.mkdtemp(prefix="stoopwise-")
    spark.conf.set(CHECKPOINT_DIR, made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses, deleted when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(drop_all, spark)
    _MADE.append(path)
    return path


def there(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder of that name is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if path in _MADE:
        _MADE.remove(path)


def drop_all(spark: SparkSession) -> None:
    """Delete what this program has left in the shared folder; a stopped session leaves it."""
    for path in list(_MADE):
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Inside, a write deletes its shuffle files once it has ended.

    Otherwise they stay until the driver happens to collect its garbage, those of every
    earlier step along with them. A streaming query that starts inside does so per batch.
    """
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The same rows, written to the shared folder once; ``options`` are those of the Parquet writer.

    For a result that several later steps read: it is computed a single time, and a
    lost executor costs a read instead of a recomputation. Its shuffle files are gone then.
    """
    path = new_path(df.sparkSession, name)
    with shuffles_go(df.sparkSession):
        df.write.options(**options).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing lazy reads them any more."""
    for table in tables:
        drop_path(table.sparkSession, table.written_path)
