"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one is set only where that is unset."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='pairglass-')}"
    sc.setCheckpointDir(root)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_root(spark)}/pairglass/{name}-{uuid.uuid4().hex}"


#: Has Spark delete a query's shuffle files once it has ended; otherwise they stay until the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _cleanup(spark: SparkSession):
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def settle(df: DataFrame, name: str, cleanup: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts the lineage, survives lost executors. With
    ``cleanup``, shuffle files made for it are deleted then."""
    spark = df.sparkSession
    path = fresh(spark, name)
    with _cleanup(spark) if cleanup else contextlib.nullcontext():
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.settled_path = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``settle``, once every table made from them is settled itself."""
    for table in tables:
        if (path := getattr(table, "settled_path", None)) is not None:
            sc = table.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
