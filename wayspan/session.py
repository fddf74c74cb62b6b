"""Session set-up and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: A side is broadcast only after its rows, and the bytes of its strings and arrays, were counted and found to be at most so many.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Whether the files of a query's shuffles go when it has ended.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wayspan")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only where the setting is missing and the master is local is a temporary folder made;
    on a cluster a missing setting is an error, since a machine's own folder isn't seen by others.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    at = tempfile.mkdtemp(prefix="wayspan-")
    spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Write df once into the shared folder and read it back.

    Unlike checkpoint(), which computes its input twice, this is one pass, keeps
    column pruning and filters on the files, and survives the loss of executors.
    The shuffles that made it are removed when it is written, not when the driver happens
    to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(_CLEAN_UP, before)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_cut_path"] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove cut tables that nothing reads any more, as the states of a fixpoint before its last."""
    for df in tables:
        path = df.__dict__.pop("_cut_path", None)
        if path:
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended already
        pass


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to hold at most so many rows and BROADCAST_BYTES in columns of no fixed width, else df as it is.

    df should be a cut table, whose count reads file footers only.
    """
    if df.limit(rows + 1).count() > rows:
        return df
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (StringType, BinaryType, ArrayType, MapType, StructType))]
    if wide:
        held = [F.octet_length(F.col(c) if isinstance(df.schema[c].dataType, (StringType, BinaryType)) else F.to_json(F.struct(c))) for c in wide]
        if (df.agg(*[F.sum(h).alias(str(k)) for k, h in enumerate(held)]).select(sum((F.coalesce(F.col(str(k)), F.lit(0)) for k in range(len(held))), F.lit(0))).first()[0]) > BROADCAST_BYTES:
            return df
    return F.broadcast(df)


def stamp(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Length, number of files and time of change of what is at a path, to tell whether it is still the same."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = files.getContentSummary(at)
    return held.getLength(), held.getFileCount(), files.getFileStatus(at).getModificationTime()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
