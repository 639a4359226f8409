"""Where intermediate tables go: the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from earlywarn.session import new_dir, shared_dir

__all__ = ["input_bytes", "materialize", "owned", "release", "shared_dir"]


def materialize(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there, so that its lineage ends and lost executors cost nothing.

    Within ``owned`` the table belongs to whoever opened that, unless ``keep`` is set; else it stays, as lazy results may still read it."""
    spark = df.sparkSession
    path = new_dir(spark)
    df.write.parquet(path)
    owners = _owners(spark)
    if owners and not keep:
        owners[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _owners(spark: SparkSession) -> list[list[str]]:
    sc = spark.sparkContext
    if not hasattr(sc, "_earlywarn_owners"):
        sc._earlywarn_owners = []
    return sc._earlywarn_owners


@contextmanager
def owned(spark: SparkSession) -> Iterator[list[str]]:
    """The paths of the tables that the body writes. Tables of other results are none of them."""
    mine: list[str] = []
    _owners(spark).append(mine)
    try:
        yield mine
    finally:
        _owners(spark).pop()


def release(spark: SparkSession, tables: list[str]) -> None:
    """Remove tables that ``owned`` has listed, once what reads them is written."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while tables:
        path = jvm.org.apache.hadoop.fs.Path(tables.pop())
        path.getFileSystem(conf).delete(path, True)


def input_bytes(df: DataFrame, text: str) -> int:
    """Total UTF-8 bytes of a text column: one aggregate over that column alone."""
    from pyspark.sql import functions as F

    return int(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])
