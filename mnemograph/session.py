"""Session settings and stage boundaries."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName("mnemograph")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_roots: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    """Shared folder for stage tables: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder; on a
    cluster the setting is required, because a machine-local folder is lost
    with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = "file://" + tempfile.mkdtemp(prefix="mnemograph-stages-")
    return _local_roots[app]


def stage_folder(spark: SparkSession) -> str:
    """The folder of this application's stage tables."""
    return f"{stage_root(spark)}/{spark.sparkContext.applicationId}"


def clear_stages(spark: SparkSession) -> None:
    """Delete this application's stage tables, once no DataFrame needs them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared stage folder and read it back.

    Cuts the lineage of a plan used more than once. The files outlive lost
    executors, and the read-back scan prunes columns and pushes filters.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_all(**frames: DataFrame) -> list[DataFrame]:
    """Stage independent tables at the same time, so their jobs share the cluster."""
    with ThreadPoolExecutor(max_workers=len(frames)) as pool:
        jobs = [pool.submit(stage, df, name) for name, df in frames.items()]
        return [job.result() for job in jobs]
