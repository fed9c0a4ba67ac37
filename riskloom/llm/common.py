"""What the training-data operators share: shared-folder tables, tokens, range buckets."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="riskloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    Shuffle files of the write go with its end, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.stored_at = path
    return kept


def discard(df: DataFrame) -> None:
    """Deletes a `stored` table that nothing reads any more, because what came of it is stored, too."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """`df.mapInArrow`, with batches of about `BATCH_BYTES` at most, however long the texts are.

    Spark's own limits are 64 MB and 10,000 rows, and a task's JVM and its worker hold several times a batch.
    The limit is read when the frame runs, so it stays in the session, unless that has one of its own.
    """
    spark = df.sparkSession
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def crc_of_id(c: str | Column) -> Column:
    """crc32 of an id's decimal text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.crc32(c.cast("string").cast("binary"))


def words(text: str | None) -> list[bytes]:
    r"""Words `[^\x20\x09-\x0D]+` with A-Z lower-cased, as UTF-8 (bytes.split and bytes.lower are ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def range_bounds(df: DataFrame, key: str, n: int) -> list[float]:
    """At most n - 1 ascending cut points of `key`, about equally many rows apart."""
    if n < 2:
        return []
    cuts = df.stat.approxQuantile(key, [i / n for i in range(1, n)], 0.2 / n)
    return sorted(set(cuts))


def range_bucket(key: str, bounds: list[float]) -> Column:
    """The number of cut points at or below `key`: ascending with the key, the same in every run.

    The cut points stand in groups, so a row looks at two square roots of them.
    """
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    value = F.col(key).cast("double")
    below = lambda cuts: F.size(F.filter(cuts, lambda b: b <= value))
    at = below(F.lit([float(g[0]) for g in groups]))
    inside = F.get(F.lit([[float(b) for b in g] for g in groups]), at - 1)
    return F.coalesce((at - 1) * width + below(inside), F.lit(0)).cast("int")


def partitions_for(df: DataFrame, mb: int = 8) -> int:
    """Shuffle partitions for a table of this estimated size."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # Spark doesn't know the size of frames that aren't read from files
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(100_000, size // (mb << 20) + 1))


def column(batch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
