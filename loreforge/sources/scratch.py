"""Cutting lineage with tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset (a local
    session, as in tests) a temporary folder is made and set; a cluster without
    the setting is refused, since no folder of one machine would do."""
    where = spark.conf.get(SETTING, None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{SETTING} must name a folder that the cluster shares")
        where = tempfile.mkdtemp(prefix="loreforge-")
        spark.conf.set(SETTING, where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/loreforge/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "step") -> DataFrame:
    """The rows of `df`, written once as Parquet to the shared folder and read
    from there: nothing above is computed again, and a lost executor costs only
    the tasks that ran on it."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt over all cores where its files give fewer tasks than that (a
    file of one row group is one task); larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sweep(spark: SparkSession, hours: float = 24) -> int:
    """Deletes scratch tables of over `hours` ago; returns how many. Stored text
    indexes (text-...) stay: they are found again by name. To be run where no
    query of that age is still going on."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/loreforge")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    now = spark._jvm.System.currentTimeMillis()
    old = [f.getPath() for f in (fs.listStatus(root) if fs.exists(root) else []) if not f.getPath().getName().startswith("text-") and f.getModificationTime() < now - hours * 3_600_000]
    for p in old:
        fs.delete(p, True)
    return len(old)
