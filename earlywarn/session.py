"""Making this package importable on executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors of this session once, as ``spark-submit --py-files`` would."""
    sc = spark.sparkContext
    if not getattr(sc, "_earlywarn_sent", False):
        top = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="earlywarn-py-")) / "earlywarn.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent).as_posix())
        sc.addPyFile(str(target))
        sc._earlywarn_sent = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where it is empty on one machine (tests), a temporary one is made; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="earlywarn-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_dir(spark: SparkSession) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/earlywarn-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there: its lineage ends, and lost executors cost nothing."""
    path = new_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
