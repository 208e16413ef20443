"""Session helpers: reading tables, and cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process made, with the settings of their file system.
_made: dict[str, object] = {}


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The parquet table ``name`` below the folder ``base``."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A session that names none gets a temporary folder of this machine if its
    executors are threads of this machine (tests); on a cluster it is an error,
    as executors could not read each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not _is_local(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="thicket-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", made)
    _clean_later(spark, made)
    return made


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let checkpoints go to :func:`shared_folder`, unless the context has a folder already."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files.

    The files go when the session's cleaner finds them out of use (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed columnar table in the shared folder, for results that are read several times, by different columns.

    The table goes with :func:`clean`, at the latest at the end of the process.
    """
    spark = df.sparkSession
    home = f"{shared_folder(spark).rstrip('/')}/thicket-{spark.sparkContext.applicationId}"
    _clean_later(spark, home)
    at = f"{home}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def _clean_later(spark: SparkSession, folder: str) -> None:
    if not _made:
        atexit.register(clean)
    _made.setdefault(folder, spark.sparkContext._jsc.hadoopConfiguration())


def clean() -> None:
    """Delete the folders that this process made; results that read them can't be used any more."""
    from pyspark import SparkContext

    while _made:
        folder, conf = _made.popitem()
        try:
            path = SparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # the JVM may be gone already
            pass
