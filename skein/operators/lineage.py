"""Lineage cuts of iterative operators: tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a local one of our own only where none is configured on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="skein-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut_in(spark: SparkSession, name: str) -> Callable[[str, DataFrame], DataFrame]:
    """Writes frames under a folder of its own and reads them again, so that a lost executor costs a re-read."""
    base = f"{shared_dir(spark)}/skein-{name}-{uuid.uuid4().hex[:12]}"

    def cut(table: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{base}/{table}")
        return spark.read.schema(df.schema).parquet(f"{base}/{table}")

    return cut
