"""Session settings, table reading and lineage cuts shared by the whole package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Columns of the `documents` table; missing files or columns are an error, not an empty result.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "tallyforge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; the caller's settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below `sf_dir`; TIMESTAMP_NTZ columns become UTC timestamps."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in frame.schema.fields:
        if isinstance(field.dataType, T.TimestampNTZType):
            frame = frame.withColumn(field.name, frame[field.name].cast("timestamp"))
    return frame


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in `spark.checkpoint.dir`; only where that is unset and the master is local
    (tests, a laptop) is a local temporary folder used.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def materialise(frame: DataFrame, label: str, small: bool = False) -> DataFrame:
    """Writes `frame` as Parquet below the shared folder and reads it back.

    This cuts the lineage like `checkpoint()`, in columnar and compressed files, so a lost
    executor costs a reread and not a recomputation. The files go when the JVM ends. `small`: a
    narrow table made by a shuffle, a small part of the input; it gets fewer files, in number
    a sixteenth of the shuffle partitions (8 at least).
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/tallyforge/{label}-{uuid.uuid4().hex}"
    if small:
        frame = frame.coalesce(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    frame.write.parquet(path)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    found = spark.read.schema(frame.schema).parquet(path)
    found.materialised_at = path
    return found


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name."""
    place, files = _place(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    place, files = _place(spark, path)
    files.delete(place, True)


def discard(frame: DataFrame) -> None:
    """Deletes the files of a materialised frame that nothing will read any more."""
    place, files = _place(frame.sparkSession, frame.materialised_at)
    files.delete(place, True)
