"""Session settings and the shared folder for intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quillspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE on and UTC time; on a cluster the master and sizes come from spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A local one is made only where the setting is absent, as in tests."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if told:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(told)
        return told
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder, which outlives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder as Parquet and read it back; columnar, compressed, and re-readable with column pruning."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)  # with the application, which is the last to read it
    return spark.read.parquet(path)


def file_stamp(spark: SparkSession, path: str) -> str:
    """Names, lengths and times of the files of a table: what an index of it is good for."""
    out = []
    for f in sorted(spark.read.parquet(path).inputFiles()):
        at = spark._jvm.org.apache.hadoop.fs.Path(f)
        st = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        out.append(f"{f}:{st.getLen()}:{st.getModificationTime()}")
    return "|".join(out)


@contextmanager
def session_setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting for what is planned or started inside; the session's own comes back afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal out rows that come in fewer partitions than there are cores, before costly work on each. Larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package's code, once per application, where it isn't installed on them."""
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='quillspark-code-')}/quillspark", "zip", root.parent, root.name)
    sc.addPyFile(made)
